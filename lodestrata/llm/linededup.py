"""Removal of repeated three-line windows, in DataFrame operations alone.

Every three consecutive lines of a text are a window, known by a 128-bit hash. For each window the first
place where it occurs anywhere, in order of (id, text hash, line), is found by an aggregation that
combines before the shuffle; windows that occur at one place only are dropped there. Every later occurrence
covers its three lines; covered positions of a text are merged and those lines removed. A place that
keeps a window's first occurrence loses it only where another repeated window covers it.

The windows of a text within itself count too. A window that a third of all texts share is one row of
each map task before the shuffle. The two joins are sort-merge joins at every size: they can be split by
the adaptive planner, and no table here has a proven bound for broadcasting.

Defined results: a null text stays null, and a text of fewer than three lines stays as it is. Rows of
equal id and text are one document: they get the same result, and none repeats the other. A null id
comes first. A text whose lines are all removed becomes empty. An empty table gives no rows. Input
columns named like a result column (n_lines, n_removed) are replaced; the text column is rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import work_dir


def line_windows(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row a window: key (two 64-bit hashes), id, the text's hash, line number."""
    spread = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.split(text_col, "\n", -1).alias("lines"))
    long_enough = spread.filter(F.size("lines") >= size)
    hashed = long_enough.select("id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"))).alias("h"))
    each = hashed.select("id", "th", "h", F.explode(F.sequence(F.lit(0), F.size("h") - size)).alias("line"))
    at = [F.col("h")[F.col("line") + k] for k in range(size)]
    return each.select(F.xxhash64(*[x["a"] for x in at]).alias("ka"), F.xxhash64(*[x["b"] for x in at]).alias("kb"), "id", "th", "line")


def drop_repeated_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The input columns, with repeated windows removed from the text, and n_lines, n_removed (null for a null text)."""
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")]
    windows = line_windows(documents, id_col, text_col, size)
    place = F.struct("id", "th", "line")
    first = windows.groupBy("ka", "kb").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("ka", "kb", "first")
    later = windows.join(first.hint("merge"), ["ka", "kb"]).filter(place != F.col("first"))
    covered = later.groupBy("id", "th").agg(F.collect_set("line").alias("starts"))
    folder = work_dir(spark, "repeated-windows")
    covered.write.parquet(folder)
    covered = spark.read.schema(covered.schema).parquet(folder).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("starts").alias("__starts"))
    joined = documents.select(*kept, F.xxhash64(text_col).alias("__h")).join(covered.hint("merge"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("__starts", lambda s: F.sequence(s, s + (size - 1)))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    text = F.when(F.col("__starts").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col(text_col).isNotNull(), F.size(lines).cast("long"))
    n_gone = F.when(F.col(text_col).isNotNull(), F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    shown = [text.alias(c) if c == text_col else F.col(c) for c in kept]
    return joined.select(*shown, n_lines.alias("n_lines"), n_gone.alias("n_removed"))
