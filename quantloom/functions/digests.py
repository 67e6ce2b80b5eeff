"""Canonical JSON and row digests in the JVM, equal to those of any program that writes JSON with sorted keys, no spaces, ASCII only
and shortest floats: the digits are the fewest that give the same double again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, FloatType, IntegralType, StringType


def _parts(text: Column) -> tuple[Column, Column]:
    """The digits of a number in scientific or plain notation, without sign, point and zeros at both ends, and the power of ten
    of the first of them."""
    plain = F.regexp_replace(F.lower(text), "^-", "")
    mantissa, power = F.split_part(plain, F.lit("e"), F.lit(1)), F.coalesce(F.nullif(F.split_part(plain, F.lit("e"), F.lit(2)), F.lit("")), F.lit("0")).cast("int")
    whole, after = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    every = F.concat(whole, after)
    lead = F.length(every) - F.length(F.ltrim(every, F.lit("0")))
    digits = F.trim(every, F.lit("0"))
    return digits, power + F.length(whole) - 1 - lead


def shortest(x: Column) -> Column:
    """The shortest text of a double that reads as the same double: plain between 1e-4 and 1e16, else with an exponent of two
    digits at least. Null for NaN and infinities, which JSON lacks.

    The JVM may write a digit too many, so texts of 16 digits and more are tried with 15 to 17. Numbers below the
    least normal one, which have fewer digits to begin with, are tried with every number of them."""
    x = x.cast("double")
    text = x.cast("string")
    digits, _ = _parts(text)
    written = lambda n: F.format_string(f"%.{n - 1}e", x)
    few = F.coalesce(*(F.when(written(n).cast("double") == x, written(n)) for n in range(1, 18)), text)
    long = F.coalesce(*(F.when(written(n).cast("double") == x, written(n)) for n in (15, 16, 17)), text)
    tried = F.when(F.abs(x) < 2.2250738585072014e-308, few).when(F.length(digits) > 15, long).otherwise(text)
    return F.element_at(F.transform(F.array(tried), lambda t: _laid_out(t, x)), 1)


def _laid_out(text: Column, x: Column) -> Column:
    digits, power = _parts(text)
    n = F.length(digits)
    tail = F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power >= n - 1, F.concat(digits, F.repeat(F.lit("0"), power - n + 1), F.lit(".0")))
        .otherwise(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2)))
    )
    body = F.when((power < -4) | (power >= 16), F.concat(F.substr(digits, F.lit(1), F.lit(1)), tail, F.lit("e"), exponent)).otherwise(plain)
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("string")).when(x == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, body))


def _escaped(c: Column) -> Column:
    """One character of a text as JSON writes it; beyond the basic plane as two halves."""
    code = F.ascii(c)
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))
    rest = code - 0x10000
    pair = F.concat(four(0xD800 + F.shiftright(rest, 10)), four(0xDC00 + rest.bitwiseAND(0x3FF)))
    short = F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f")
    return F.coalesce(short, F.when((code >= 32) & (code < 127), c), F.when(code < 0x10000, four(code)), pair)


def quoted(text: Column) -> Column:
    """A text as a JSON string in ASCII."""
    odd = text.rlike("[^\\x20-\\x21\\x23-\\x5B\\x5D-\\x7E]")
    inner = F.when(odd, F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), 1), _escaped), "")).otherwise(text)
    return F.concat(F.lit('"'), inner, F.lit('"'))


def json_value(c: Column, kind: DataType) -> Column:
    """A value as JSON; null is null, dates are their text. NaN and infinities make the whole text null, as JSON has none."""
    if isinstance(kind, (DoubleType, FloatType)):
        text = shortest(c)
    elif isinstance(kind, (IntegralType, BooleanType)):
        text = c.cast("string")
    elif isinstance(kind, (StringType, DateType)):
        text = quoted(c.cast("string"))
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """These columns of a row as JSON: keys sorted, no spaces, ASCII only. Null where a number is NaN or infinite."""
    items = []
    for k, name in enumerate(sorted(columns)):
        items += [F.concat(F.lit("," if k else ""), quoted(F.lit(name)), F.lit(":")), json_value(F.col(name), df.schema[name].dataType)]
    return F.concat(F.lit("{"), *items, F.lit("}"))


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """The SHA-256 of canonical_json."""
    return F.sha2(canonical_json(df, columns), 256)
