"""Transformers and validators as Column factories, and projections compiled to Columns.

A transformer turns the text before it into (value, code, failed); a value stays canonical text with a type known at
compile time. A validator turns (raw, value) into the code of its failure or null.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import detectors as det
from ..functions import text as t
from ..functions.decimals import arithmetic
from ..model import EngineError
from .plan import Projection, Step

#: Types that a target's physical type accepts after its transformers.
ACCEPTS = {"INTEGER": ("integer", "long"), "DECIMAL": ("decimal", "integer", "long"), "DATE": ("date",), "BOOLEAN": ("boolean",)}
DECIMAL_GRAMMAR = {
    "pt-br": r"[+-]?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?",
    "en-us": r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?",
}


@dataclass(frozen=True)
class Outcome:
    value: Column
    code: Column
    failed: Column


def _result(value: Column, failure: Column) -> Outcome:
    return Outcome(F.when(failure.isNull(), value), failure, failure.isNotNull())


def _no_code() -> Column:
    return F.lit(None).cast("string")


def string_normalize(raw: Column, step: Step, locale: str) -> Outcome:
    value = F.regexp_replace(t.strip(raw), r"[ \t\n\x0B\f\r]+", " ")
    mode = step.option("case", "preserve")
    if mode not in ("preserve", "lower", "upper"):
        return _result(value, F.lit("INVALID_TRANSFORMER_OPTION"))
    value = {"preserve": value, "lower": F.lower(value), "upper": F.upper(value)}[mode]
    return Outcome(value, F.when(value != raw, "STRING_NORMALIZED"), F.lit(False))


def _whole(code: str, kind: str) -> Callable[[Column, Step, str], Outcome]:
    def run(raw: Column, step: Step, locale: str) -> Outcome:
        value = t.strip(raw)
        number = F.when(t.matches(value, r"[+-]?\d+"), value.try_cast(kind))
        failure = F.when(number.isNull(), code)
        if step.option("allowLeadingZeros", "false").lower() != "true":
            failure = F.when(t.matches(value, r"[+-]?0.+"), "IDENTIFIER_LIKE_NUMBER").otherwise(failure)
        return _result(number.cast("string"), failure)

    return run


def exponent_text(value: Column) -> Column:
    """``digits E exponent`` as a decimal number writes itself: plain with up to six zeros after the point, else scientific.

    Null where the exponent is beyond an integer.
    """
    part = lambda k: F.regexp_extract(value, r"\A([+-]?)0*(\d+?)(?:[eE]([+-]?\d+))?\z", k)
    digits, e = part(2), F.when(part(3) == "", 0).otherwise(part(3).try_cast("int"))
    n = F.length(digits)
    high = n - 1 + e
    point = F.concat(F.left(digits, n + e), F.lit("."), F.right(digits, -e))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - n), digits)
    mantissa = F.when(n == 1, digits).otherwise(F.concat(F.left(digits, F.lit(1)), F.lit("."), F.right(digits, n - 1)))
    scientific = F.concat(mantissa, F.when(high < 0, "E").otherwise("E+"), high.cast("string"))
    text = F.when(e == 0, digits).when((e < 0) & (high >= 0), point).when((e < 0) & (high >= -6), small).otherwise(scientific)
    return F.when(e.isNotNull(), F.concat(F.when(part(1) == "-", F.when(digits == "0", "").otherwise("-")).otherwise(""), text))


def big_decimal(raw: Column, step: Step, locale: str) -> Outcome:
    value = F.regexp_replace(t.strip(raw), " ", "")
    locale = (step.option("locale", locale) or "").strip()
    number = {"pt-br": F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), "en-us": F.replace(value, F.lit(","), F.lit(""))}
    if not locale:
        plain = F.when(t.matches(value, r"[+-]?\d+"), value).when(t.matches(value, r"[+-]?\d+[eE][+-]?\d+"), exponent_text(value))
        failure = F.when(value.rlike("[.,]"), "AMBIGUOUS_DECIMAL").when(plain.isNull(), "INVALID_DECIMAL")
        return _result(plain, failure)
    if locale.lower() not in DECIMAL_GRAMMAR:
        return _result(value, F.lit("UNSUPPORTED_LOCALE"))
    return _result(number[locale.lower()], F.when(~t.matches(value, DECIMAL_GRAMMAR[locale.lower()]), "INVALID_DECIMAL"))


#: Fields of a date pattern: what a value has in their place. A year of era needs an era in strict parsing; it is read as a year.
DATE_FIELDS = {"uuuu": r"(\d{4})", "yyyy": r"(\d{4})", "uu": r"(\d{2})", "yy": r"(\d{2})", "MM": r"(\d{2})", "M": r"(\d{1,2})", "dd": r"(\d{2})", "d": r"(\d{1,2})"}


def _dated(value: Column, pattern: str) -> Column | None:
    """The date of a value in a strict pattern of a year, a month and a day, in digits; None for any other pattern."""
    shape, order = "", []
    for literal, letters, other in _pattern_parts(pattern):
        if letters:
            if letters not in DATE_FIELDS:
                return None
            shape += DATE_FIELDS[letters]
            order.append(letters[0].replace("y", "u"))
        else:
            shape += re.escape(literal or other)
    if sorted(order) != ["M", "d", "u"]:
        return None
    if not {"uu", "yy", "M", "d"} & {letters for _, letters, _ in _pattern_parts(pattern)}:
        return F.when(t.matches(value, shape), F.try_to_date(value, pattern.replace("uuuu", "yyyy")))
    year, month, day = (F.regexp_extract(value, rf"\A{shape}\z", order.index(x) + 1) for x in "uMd")
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(t.matches(value, shape), F.try_to_date(text, "yyyy-MM-dd"))


def _pattern_parts(pattern: str) -> list[tuple[str, str, str]]:
    """(quoted text, run of one letter, other character) of a date pattern, one of the three filled each time."""
    found = []
    for m in re.finditer(r"'((?:[^']|'')*)'|((?:([A-Za-z])\3*))|(.)", pattern, re.DOTALL):
        quoted = m[1]
        found.append((("'" if quoted == "" else quoted.replace("''", "'")) if quoted is not None else "", m[2] or "", m[4] or ""))
    return found


def local_date(raw: Column, step: Step, locale: str) -> Outcome:
    value = t.strip(raw)
    formats = (step.option("formats", "") or "").strip()
    if not formats:
        date = det.iso_date(value)
        failure = F.when(date.isNull(), F.when(t.matches(value, r"\d{2}/\d{2}/\d{4}"), "AMBIGUOUS_DATE").otherwise("INVALID_DATE"))
        return _result(date.cast("string"), failure)
    dates = [d for d in (_dated(value, p) for p in formats.split("|")) if d is not None]
    found = F.array_distinct(F.array_compact(F.array(*dates))) if dates else F.array().cast("array<date>")
    failure = F.when(F.size(found) == 0, "INVALID_DATE").when(F.size(found) > 1, "AMBIGUOUS_DATE")
    return _result(F.get(found, F.lit(0)).cast("string"), failure)


def boolean(raw: Column, step: Step, locale: str) -> Outcome:
    value, locale = F.lower(t.strip(raw)), (step.option("locale", locale) or "").lower()
    yes, no = ["true"], ["false"]
    yes += {"pt-br": ["sim"], "en-us": ["yes"]}.get(locale, [])
    no += {"pt-br": ["não", "nao"], "en-us": ["no"]}.get(locale, [])
    out = F.when(value.isin(yes), "true").when(value.isin(no), "false")
    return _result(out, F.when(out.isNull(), "INVALID_BOOLEAN"))


def _digits(allowed: str, count: int, code: str) -> Callable[[Column, Step, str], Outcome]:
    def run(raw: Column, step: Step, locale: str) -> Outcome:
        digits = F.regexp_replace(raw, r"[^0-9]", "")
        return _result(digits, F.when(~t.matches(raw, f"[{allowed}]+") | (F.length(digits) != count), code))

    return run


def phone(raw: Column, step: Step, locale: str) -> Outcome:
    digits = F.regexp_replace(raw, r"[^0-9]", "")
    local = F.when(F.length(digits).between(12, 13) & digits.startswith("55"), F.substr(digits, F.lit(3))).otherwise(digits)
    return _result(local, F.when(~t.matches(raw, r"[0-9+()\-\s]+") | ~F.length(local).between(10, 11), "INVALID_PHONE_FORMAT"))


#: id -> (factory, type of the value)
TRANSFORMERS: dict[str, tuple[Callable[[Column, Step, str], Outcome], str]] = {
    "core:string-normalize": (string_normalize, "string"),
    "core:integer": (_whole("INVALID_INTEGER", "int"), "integer"),
    "core:long": (_whole("INVALID_LONG", "long"), "long"),
    "core:big-decimal": (big_decimal, "decimal"),
    "core:local-date": (local_date, "date"),
    "core:boolean": (boolean, "boolean"),
    "br:cpf-canonical": (_digits(r"0-9.\-\s", 11, "INVALID_CPF_FORMAT"), "string"),
    "br:cep-canonical": (_digits(r"0-9\-\s", 8, "INVALID_CEP_FORMAT"), "string"),
    "br:phone-canonical": (phone, "string"),
}


def required(raw: Column, value: Column, step: Step) -> Column:
    return F.when(t.blank(raw), "REQUIRED_VALUE_MISSING")


def _compiles(pattern: str) -> bool:
    """Whether the JVM, which runs the pattern, accepts it."""
    jvm = SparkSession.getActiveSession()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def regex(raw: Column, value: Column, step: Step) -> Column:
    pattern = step.option("pattern")
    if pattern is None or not _compiles(pattern):
        return F.lit("INVALID_VALIDATOR_OPTION")
    return F.when(~t.matches(value, pattern), "REGEX_MISMATCH")


def length(raw: Column, value: Column, step: Step) -> Column:
    try:
        low, high = int(step.option("min", "0")), int(step.option("max", str(2**31 - 1)))
    except ValueError:
        return F.lit("INVALID_VALIDATOR_OPTION")
    return F.when(~t.utf16_length(value).between(low, high), "LENGTH_OUT_OF_RANGE")


def enum(raw: Column, value: Column, step: Step) -> Column:
    return F.when(~value.isin(step.option("values", "").split("|")), "VALUE_NOT_IN_ENUM")


NUMBER = r"([+-]?)(?:(\d+)\.?(\d*)|\.(\d+))(?:[eE]([+-]?\d+))?"


@dataclass(frozen=True)
class Magnitude:
    """A number of any size for comparison: its sign, the power of its first digit and its digits without outer zeros."""

    sign: Column | int
    power: Column | int
    digits: Column | str


def _magnitude(value: Column) -> Magnitude:
    part = lambda k: F.regexp_extract(value, rf"\A{NUMBER}\z", k)
    digits = F.concat(part(2), part(3), part(4))
    solid = F.ltrim(digits, F.lit("0"))
    power = F.length(part(2)) - (F.length(digits) - F.length(solid)) - 1 + F.when(part(5) == "", 0).otherwise(part(5).try_cast("int"))
    return Magnitude(F.when(solid == "", 0).when(part(1) == "-", -1).otherwise(1), power, F.rtrim(solid, F.lit("0")))


def _bound(text: str) -> Magnitude | None:
    if not re.fullmatch(NUMBER, text, re.ASCII):
        return None
    sign, digits, exponent = Decimal(text).as_tuple()
    solid = "".join(map(str, digits)).lstrip("0")
    return Magnitude((-1 if sign else 1) if solid else 0, len(solid) - 1 + exponent, solid.rstrip("0"))


def _beyond(x: Magnitude, b: Magnitude, side: int) -> Column:
    """Whether x lies above (side 1) or below (side -1) the bound."""
    if b.sign == 0:
        return x.sign == side
    outside = (x.power > b.power) | ((x.power == b.power) & (x.digits > b.digits))
    inside = (x.power < b.power) | ((x.power == b.power) & (x.digits < b.digits))
    same = x.sign == b.sign
    return same & outside if b.sign == side else (~same) | inside


def numeric_range(raw: Column, value: Column, step: Step) -> Column:
    number, out = _magnitude(value), F.lit(False)
    bad = ~t.matches(value, NUMBER) | number.power.isNull()
    for name, side in (("min", -1), ("max", 1)):
        text = step.option(name)
        if text is not None:
            bound = _bound(text)
            if bound is None:
                return F.lit("INVALID_NUMERIC_VALUE")
            out = out | _beyond(number, bound, side)
    return F.when(F.coalesce(bad, F.lit(True)), "INVALID_NUMERIC_VALUE").when(out, "NUMERIC_OUT_OF_RANGE")


def date_range(raw: Column, value: Column, step: Step) -> Column:
    date, out = det.iso_date(value), F.lit(False)
    for name in ("min", "max"):
        bound = step.option(name)
        if bound is not None:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", bound):
                return F.lit("INVALID_DATE_VALUE")
            out = out | ((date < F.lit(bound).cast("date")) if name == "min" else (date > F.lit(bound).cast("date")))
    return F.when(date.isNull(), "INVALID_DATE_VALUE").when(out, "DATE_OUT_OF_RANGE")


def cpf_checksum(raw: Column, value: Column, step: Step) -> Column:
    """A value that is not eleven digits long fails like a wrong check digit."""
    return F.when(~det.cpf_valid_digits(value), "INVALID_CPF_CHECKSUM")


VALIDATORS: dict[str, Callable[[Column, Column, Step], Column]] = {
    "core:required": required,
    "core:regex": regex,
    "core:length": length,
    "core:enum": enum,
    "core:numeric-range": numeric_range,
    "core:date-range": date_range,
    "br:cpf-checksum": cpf_checksum,
}


def register_transformer(id_: str, factory: Callable[[Column, Step, str], Outcome], kind: str = "string") -> None:
    """An own transformer; ids are namespaced and cannot be taken twice."""
    if id_ in TRANSFORMERS:
        raise EngineError("DUPLICATE_TRANSFORMER", "the id is taken")
    TRANSFORMERS[id_] = (factory, kind)


def register_validator(id_: str, factory: Callable[[Column, Column, Step], Column]) -> None:
    if id_ in VALIDATORS:
        raise EngineError("DUPLICATE_VALIDATOR", "the id is taken")
    VALIDATORS[id_] = factory


@dataclass(frozen=True)
class Projected:
    raw: Column
    code: Column
    operations: int


def project(p: Projection, locale: str) -> Projected:
    if p.kind == "UNMAPPED":
        raise EngineError("UNMAPPED_TARGET", "an unmapped target has no value")
    if p.kind == "SOURCE_COLUMN":
        return Projected(F.col(p.column), _no_code(), 0)
    if p.kind == "CONSTANT":
        return Projected(F.lit(p.text), _no_code(), 0)
    operands = [t.cell(F.col(o.column)) if o.kind == "SOURCE_COLUMN" else F.lit(o.text) for o in p.operands]
    if p.operation == "CONCAT":
        return Projected(F.concat(*operands), _no_code(), 1)
    if p.operation == "COALESCE":
        return Projected(F.coalesce(*[F.when(~t.blank(o), o) for o in operands], F.lit("")), _no_code(), 1)
    out = arithmetic(p.operation, operands, locale)
    return Projected(out["value"], out["code"], 1)


def check_steps(transformations: tuple[Step, ...], validations: tuple[Step, ...], physical: str) -> str:
    """The type of the value after all transformers; raises for unknown steps and types that do not fit."""
    kind = "string"
    for s in transformations:
        if s.id not in TRANSFORMERS or s.version != "1":
            raise EngineError("UNKNOWN_TRANSFORMER", "the plan names an unavailable transformer")
        if kind != "string":
            raise EngineError("TRANSFORMER_TYPE_MISMATCH", "a transformer gets another type than text")
        kind = TRANSFORMERS[s.id][1]
    for s in validations:
        if s.id not in VALIDATORS or s.version != "1":
            raise EngineError("UNKNOWN_VALIDATOR", "the plan names an unavailable validator")
        if s.id == "br:cpf-checksum" and kind != "string":
            raise EngineError("VALIDATOR_TYPE_MISMATCH", "a validator gets another type than text")
    return kind
