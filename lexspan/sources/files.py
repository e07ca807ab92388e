"""Readers and writers of text formats, as thin settings over Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; quoted fields may span lines. Without a schema types are inferred, which costs a pass. A byte-order mark is no part of the first name."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(paths) if schema is not None else reader.option("inferSchema", True).csv(paths)
    return df.toDF(*[c.removeprefix(BOM) for c in df.columns])


def read_json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """A row a line; blank and broken lines are left out. Paths may be globs."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_json_array(spark: SparkSession, paths: str | Sequence[str], schema: str | T.StructType) -> DataFrame:
    """Files that each hold one array of objects: a row an object."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def read_json_tuples(spark: SparkSession, paths: str | Sequence[str], names: Sequence[str]) -> DataFrame:
    """Files that each hold one array of arrays of strings, such as [[query, act, section], ...]: a row an inner array, by position."""
    whole = spark.read.text(paths, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    return rows.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_json_map(spark: SparkSession, paths: str | Sequence[str], value: str) -> DataFrame:
    """Files that each hold one object used as a map: a row (key, value) an entry; ``value`` is the values' type."""
    whole = spark.read.text(paths, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def read_texts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, text) a file."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(folder).select("path", "length", "modificationTime")


def read_by_year(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """Parquet laid out as ``year=YYYY`` folders: only the years asked for are listed and read."""
    return spark.read.option("mergeSchema", True).parquet(folder).where(F.col("year").between(first, last))


#: Number types by width; a column that two files have in different ones takes the wider.
_WIDTHS = ("tinyint", "smallint", "int", "bigint", "decimal", "float", "double")


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: equal types stay, whole numbers widen, a mix with fractions is double, dates are timestamps, everything else text."""
    x, y = a.simpleString().split("(")[0], b.simpleString().split("(")[0]
    if a == b:
        return a
    if x in _WIDTHS and y in _WIDTHS:
        wide = max(x, y, key=_WIDTHS.index)
        return T.DoubleType() if wide in ("decimal", "float", "double") else (a if wide == x else b)
    return T.TimestampType() if {x, y} == {"date", "timestamp"} else T.StringType()


def read_drifting(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet files whose columns changed over the years, as one table.

    Columns go by name, in the order in which they first come; one that a file lacks is null there, and one
    that files have in different types takes a type that holds all. Only footers are read to tell; files
    of one schema are one scan.
    """
    by_schema: dict[str, tuple[T.StructType, list[str]]] = {}
    for path in paths:
        schema = spark.read.parquet(path).schema
        by_schema.setdefault(schema.json(), (schema, []))[1].append(path)
    wide: dict[str, T.DataType] = {}
    for schema, _ in by_schema.values():
        for f in schema:
            wide[f.name] = _wider(wide[f.name], f.dataType) if f.name in wide else f.dataType

    def read(schema: T.StructType, own: list[str]) -> DataFrame:
        df = spark.read.schema(schema).parquet(*own)
        has = set(schema.fieldNames())
        return df.select(*[(F.col(f"`{c}`") if c in has else F.lit(None)).cast(kind).alias(c) for c, kind in wide.items()])

    return reduce(DataFrame.union, [read(schema, own) for schema, own in by_schema.values()])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Adds rows to a folder of JSON lines; each write is committed whole."""
    df.write.mode("append").json(path)


def write_by_year(df: DataFrame, path: str, day: str) -> None:
    """Parquet in ``year=YYYY`` folders; rows are dealt by year first, so a year has few files."""
    df.withColumn("year", F.year(day)).repartition("year").write.partitionBy("year").parquet(path)
