"""Semantic detectors: each is a set of Column predicates over a stripped, non-blank value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DATE_SHAPE, EMAIL_SHAPE, matches


@dataclass(frozen=True)
class Detector:
    """``strong`` tells which columns a detector identifies for sure: never, by validity, or also only without doubt."""

    type: str
    shape: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    ambiguous: Callable[[Column], Column] = lambda v: F.lit(False)
    strong: str = "never"  # "valid", "certain"

    def is_strong(self, validity: float, reliability: float, ambiguous: int) -> bool:
        sure = validity >= 0.8 and reliability >= 0.5
        return sure and (self.strong == "valid" or self.strong == "certain" and ambiguous == 0)


def iso_date(value: Column) -> Column:
    return F.when(matches(value, r"\d{4}-\d{2}-\d{2}"), F.try_to_date(value, "yyyy-MM-dd"))


def slash_date(value: Column, order: str) -> Column:
    return F.when(matches(value, r"\d{2}/\d{2}/\d{4}"), F.try_to_date(value, order))


def _date_valid(value: Column) -> Column:
    return F.coalesce(iso_date(value), slash_date(value, "dd/MM/yyyy"), slash_date(value, "MM/dd/yyyy")).isNotNull()


def _date_ambiguous(value: Column) -> Column:
    both = slash_date(value, "dd/MM/yyyy").isNotNull() & slash_date(value, "MM/dd/yyyy").isNotNull()
    return both & (F.substring(value, 1, 2) != F.substring(value, 4, 2))


def cpf_digits(value: Column) -> Column:
    return F.translate(value, ".-", "")


def cpf_valid_digits(digits: Column) -> Column:
    """Eleven digits, not all equal, both check digits right; false for any other text."""

    def right(d: Column) -> Column:
        number = [F.substring(d, k + 1, 1).cast("int") for k in range(11)]
        check = lambda n: sum((number[k] * (n + 1 - k) for k in range(n)), F.lit(0)) * 10 % 11 % 10 == number[n]
        return check(9) & check(10)

    # the lambda names the digits once; the sums are not built for texts of another shape
    ok = matches(digits, r"\d{11}") & ~matches(digits, r"(\d)\1{10}")
    return F.coalesce(F.when(ok, F.element_at(F.transform(F.array(digits), right), 1)), F.lit(False))


def phone_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _phone_shape(value: Column) -> Column:
    return F.length(phone_digits(value)).between(10, 11)


EMAIL = Detector("core:email", lambda v: matches(v, EMAIL_SHAPE), lambda v: matches(v, r"[^\s@]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), strong="valid")
DATE = Detector("core:date", lambda v: matches(v, DATE_SHAPE), _date_valid, _date_ambiguous)
CPF = Detector("br:cpf", lambda v: matches(v, r"\d{11}|\d{3}\.\d{3}\.\d{3}-\d{2}"), lambda v: cpf_valid_digits(cpf_digits(v)), strong="valid")
PHONE = Detector(
    "br:phone",
    _phone_shape,
    lambda v: F.when(_phone_shape(v), F.coalesce(F.substring(phone_digits(v), 1, 2).try_cast("int") >= 11, F.lit(False))).otherwise(False),
    lambda v: matches(v, r"\d{11}"),
    strong="certain",
)
CORE = (EMAIL, DATE)
BRAZIL = (CPF, PHONE)
