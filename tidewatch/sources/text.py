"""Text documents as lines and frontmatter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lines, strip


def explode_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line, numbered from 1. Null texts and texts without lines give no row."""
    return df.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def extract_frontmatter(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, frontmatter (map, null if missing or unterminated), body and body_start_line of every document.

    The first line must be ``---`` and a later line closes the block. Lines without
    a colon are skipped, the first colon separates, the last of equal keys wins.
    Without a closed block the whole text is the body. Everything is computed
    inside the row, so documents aren't shuffled.
    """
    rows = df.select(key, text, lines(F.col(text)).alias("ls"))
    closing = F.array_position(F.transform(F.slice("ls", 2, F.greatest(F.size("ls") - 1, F.lit(0))), lambda x: strip(x) == "---"), F.lit(True))
    opened = (F.size("ls") > 0) & (strip(F.try_element_at("ls", F.lit(1))) == "---")
    rows = rows.withColumn("end", F.when(opened & (closing > 0), closing + 1).cast("int"))
    fields = F.filter(F.slice("ls", F.lit(2), F.greatest(F.col("end") - 2, F.lit(0))), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(fields, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    body = F.when(F.col("end").isNotNull(), F.array_join(F.slice("ls", F.col("end") + 1, F.greatest(F.size("ls") - F.col("end"), F.lit(0))), "\n")).otherwise(F.col(text))
    return rows.select(key, F.when(F.col("end").isNotNull(), F.map_from_entries(last)).alias("frontmatter"), body.alias("body"), F.coalesce(F.col("end") + 1, F.lit(1)).alias("body_start_line"))
