"""Shared pieces: the shared scratch folder, written intermediate tables, and the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a longest run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes the shuffle files of a query when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of a batch that goes to Python, and the bound taken where a session sets none.
BATCH_BYTES, SMALL_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: The characters between words, as a list for ``translate``.
BLANKS = " \t\n\x0b\x0c\r"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, but only for a local master, whose
    tasks run on this machine; a cluster without the setting is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-lexspan-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/lexspan/{uuid.uuid4().hex}/{name}"


def small_batches(spark: SparkSession) -> None:
    """Bounds what goes to Python at once by bytes, for the session, unless it has a bound of its own.

    Batches are otherwise cut by rows alone: 10,000 texts or pairs of shingle sets, held by the executor outside its heap
    and by the worker. It stays set, because a stage's result is computed when its caller writes it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(SMALL_BATCH))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files behind it are freed as soon as the table is written, not when the driver next
    collects garbage.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def private(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased, as UTF-8; ``bytes.split`` splits at exactly BLANKS."""
    return text.encode("utf-8").lower().split() if text else []
