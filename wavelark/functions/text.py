"""Parsers for the textual oddities of the raw captures."""

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def number(value: Column) -> Column:
    """Numeric coercion: unreadable text and NaN both become NULL."""
    parsed = value.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def whole(value: Column) -> Column:
    return number(value).try_cast("long")


def flag(value: Column) -> Column:
    return number(value).cast("boolean")


@F.pandas_udf(T.StringType())
def _decode_escaped(texts: pd.Series) -> pd.Series:
    def decode(text):
        if text is None:
            return None
        try:
            parsed = ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text
        if not isinstance(parsed, bytes):
            return text
        return parsed.decode("utf-8", errors="replace") or None

    return texts.map(decode, na_action="ignore")


def decode_byte_literal(value: Column) -> Column:
    """Text of a printed bytes value such as ``b'NAME'``; other text stays as it is.

    Plain literals are cut out inside the JVM. Only those with escapes are sent to Python.
    """
    text = F.nullif(strip(value), F.lit(""))
    plain = text.rlike(r"""^[bB]('[\x20-\x7e&&[^'\\]]*'|"[\x20-\x7e&&[^"\\]]*")$""")
    escaped = text.rlike(r"""^[bBrR]{1,2}['"]""") & text.contains("\\")
    return (
        F.when(plain, F.nullif(text.substr(F.lit(3), F.length(text) - 3), F.lit("")))
        .when(escaped, _decode_escaped(F.when(escaped, text)))
        .otherwise(text)
    )


def parse_token_map(line: Column) -> Column:
    """``ap:int,ap:int`` as a map; malformed tokens are dropped and the last key wins."""
    tokens = F.transform(F.split(strip(line), ","), strip)
    pairs = F.transform(tokens, lambda t: F.struct(
        F.substring_index(t, ":", 1).alias("ap"),
        F.when(F.instr(t, ":") > 1, t.substr(F.instr(t, ":") + 1, F.length(t))).alias("text"),
    ))
    good = F.transform(
        F.filter(pairs, lambda p: p["text"].rlike(r"^\s*[+-]?\d+\s*$")),
        lambda p: F.struct(p["ap"].alias("ap"), strip(p["text"]).cast("long").alias("value")),
    )
    keys = F.transform(good, lambda p: p["ap"])
    last_only = F.filter(good, lambda p, i: ~F.array_contains(
        F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["ap"]))
    unique = F.when(F.size(F.array_distinct(keys)) == F.size(keys), good).otherwise(last_only)
    return F.map_from_entries(unique)


def parse_compact_timestamp(value: Column) -> Column:
    """``yyyyMMddHHmmss`` followed by one to six fraction digits; blank gives NULL."""
    text = F.nullif(strip(value), F.lit(""))
    seconds = F.to_timestamp(F.substring(text, 1, 14), "yyyyMMddHHmmss")
    micros = F.rpad(text.substr(F.lit(15), F.lit(6)), 6, "0").cast("long")
    return F.timestamp_micros(F.unix_micros(seconds) + micros)


def parse_coordinates(value: Column) -> Column:
    """Struct x, y, z; parts that are blank or absent are NULL."""
    parts = F.split(strip(value), ",")

    def part(i):
        return F.nullif(strip(F.try_element_at(parts, F.lit(i))), F.lit("")).cast("double")

    return F.struct(part(1).alias("x"), part(2).alias("y"), part(3).alias("z"))


def position_key(x: Column, y: Column, z: Column | None = None) -> Column:
    """Rounded coordinates usable as a join key; NULL as soon as one is missing."""
    parts = [F.bround(x, 6), F.bround(y, 6)]
    if z is not None:
        parts.append(F.bround(z, 2))
    # Adding zero turns -0.0 into 0.0, which otherwise prints differently.
    texts = [(p + F.lit(0.0)).cast("string") for p in parts]
    return F.concat(*[piece for t in texts for piece in (t, F.lit(";"))])


def tolerant_true(value: Column) -> Column:
    """True for 1, true, yes, y in any case; everything else, NULL included, is false."""
    text = F.lower(strip(value))
    return F.coalesce(text.isin("1", "1.0", "true", "yes", "y"), F.lit(False))


def strict_boolean(value: Column) -> Column:
    """1/true/yes and 0/false/no; anything else is NULL."""
    text = F.lower(strip(value))
    return F.when(text.isin("1", "true", "yes"), True).when(text.isin("0", "false", "no"), False)


def anomaly_score(raw: Column, higher_is_more_anomalous: bool) -> Column:
    return raw if higher_is_more_anomalous else -raw
