"""Column helpers: time, ratios, versions, text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends and strippable characters of the text files that are checked (fixed values).
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
BLANKS = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone (sessions run in UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    """Hours as a fraction, from microseconds, so that no boundary is counted twice."""
    return (micros(end) - micros(start)) / F.lit(3_600_000_000.0)


def day(ts: Column) -> Column:
    return F.to_date(ts)


def month(ts: Column) -> Column:
    """First day of the month."""
    return F.trunc(ts.cast("date"), "month")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def exact_sum(value: Column, places: int = 6) -> Column:
    """Sum of a double's decimals, as a double: the same for every order of the rows, unlike a sum of doubles. Values have 12 digits before the point at most."""
    return F.sum(value.cast(f"decimal(18,{places})")).cast("double")


def strip(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` knows spaces only)."""
    return F.regexp_replace(text, f"(?U)^{BLANKS}+|{BLANKS}+$", "")


def lines(text: Column) -> Column:
    """Array of lines; a final line end adds no empty line, and the empty text has none."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def signature(text: Column) -> Column:
    """A template of a message: quoted parts, long hex, addresses and numbers become placeholders."""
    out = F.lower(text)
    for pattern, to in (("\"[^\"]*\"", "<str>"), ("\\b[0-9a-f]{16,}\\b", "<hex>"), ("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "<ip>"), ("[0-9]+", "<n>")):
        out = F.regexp_replace(out, pattern, to)
    return out


def version_key(version: Column) -> Column:
    """'1.10.2' as [1, 10, 2]; arrays compare part by part."""
    return F.transform(F.split(version, "\\."), lambda p: p.cast("int"))


def bucket(value: Column, low: float, high: float, bins: int) -> Column:
    """1..bins between low and high, 0 below, bins + 1 from high on."""
    return F.width_bucket(value, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int")
