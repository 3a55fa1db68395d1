"""Exact decimal arithmetic on text, in Arrow batches: unbounded sums and products, quotients of 34 digits."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTIENT = Context(prec=34, rounding=ROUND_HALF_EVEN, Emin=-6143, Emax=6144)
#: Number grammars by locale: fixed values.
GRAMMARS = {"pt-BR": r"[-+]?(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?", "en-US": r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"}
OTHER = r"[-+]?\d+(?:\.\d+)?"
RESULT = "value string, code string"


def parse(value: str, locale: str) -> Decimal:
    """A number in the locale's grammar; spaces inside are dropped. Raises InvalidOperation for any other text."""
    value = re.sub(r"\s", "", value)
    if not re.fullmatch(GRAMMARS.get(locale, OTHER), value, re.ASCII):
        raise InvalidOperation
    if locale == "pt-BR":
        value = value.replace(".", "").replace(",", ".")
    elif locale == "en-US":
        value = value.replace(",", "")
    return Decimal(value)


def plain(number: Decimal) -> str:
    """Without exponent and trailing zeros."""
    if number == 0:
        return "0"
    text = format(number, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def fold(operation: str, values: list[str], locale: str) -> tuple[str | None, str | None]:
    try:
        numbers = [parse(v or "", locale) for v in values]
    except InvalidOperation:
        return None, "DERIVED_INVALID_NUMBER"
    digits = sum(len(n.as_tuple().digits) + abs(n.as_tuple().exponent) for n in numbers) + len(numbers) + 2
    exact = Context(prec=max(28, digits))
    try:
        out = numbers[0]
        for n in numbers[1:]:
            if operation == "ADD":
                out = exact.add(out, n)
            elif operation == "SUBTRACT":
                out = exact.subtract(out, n)
            elif operation == "MULTIPLY":
                out = exact.multiply(out, n)
            elif n == 0:
                return None, "DERIVED_DIVISION_BY_ZERO"
            else:
                out = QUOTIENT.divide(out, n)
        return plain(out), None
    except ArithmeticError:
        return None, "DERIVED_ARITHMETIC_ERROR"


def arithmetic(operation: str, operands: list[Column], locale: str) -> Column:
    """struct(value, code): the folded operands as plain text, or the code of what went wrong."""

    @F.pandas_udf(RESULT)
    def run(values: pd.Series) -> pd.DataFrame:
        out = [fold(operation, list(v), locale) for v in values]
        return pd.DataFrame(out, columns=["value", "code"]).astype(object)

    return run(F.array(*operands))
