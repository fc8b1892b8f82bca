"""Reading tables with a declared schema: names and types must match exactly, as a typed open does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class TableTypeMismatch(ValueError):
    """The stored table has another schema than the declared one."""


class TableDoesNotExist(KeyError):
    pass


def check_schema(df: DataFrame, declared: T.StructType) -> DataFrame:
    """The frame itself, if each declared column is there with the declared type, and no other; nullability aside."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in declared]
    if have != want:
        raise TableTypeMismatch(f"declared {want}, found {have}")
    return df


def open_table(spark: SparkSession, path: str, declared: T.StructType | None = None) -> DataFrame:
    """A parquet table; with a declared schema it is checked from the footers, before any data is read."""
    df = spark.read.parquet(path)
    return check_schema(df, declared) if declared is not None else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_untyped(spark: SparkSession, path: str, key: list[str], value: list[str]) -> DataFrame:
    """(key, value) as bytes, whatever the types: the text of each column, joined by NUL."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(path)
    raw = lambda cs: F.encode(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs]), "utf-8")
    return df.select(raw(key).alias("key"), raw(value).alias("value"))


def salvage(spark: SparkSession, path: str, declared: T.StructType) -> DataFrame:
    """What can still be read of a table some of whose files are damaged or gone."""
    return spark.read.schema(declared).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path)


def table_stats(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(table, rows, files): rows come from the footers, for no column is read."""
    from pyspark.sql import functions as F

    out = None
    for name, path in paths.items():
        df = spark.read.parquet(path)
        one = df.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files"))
        one = one.select(F.lit(name).alias("table"), "rows", "files")
        out = one if out is None else out.unionByName(one)
    return out
