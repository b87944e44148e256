"""What several text operators share: word pattern, null rules, shared folders."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.storage import Storage

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words in order. White space is folded first, so that the split needs no regular expression engine."""
    folded = F.trim(F.translate(text, WHITE, " " * len(WHITE)))
    return F.filter(F.split(folded, " "), lambda w: w != "")


def count_words(text: Column) -> Column:
    """The number of words: a split at words has one piece more."""
    return (F.size(F.split(text, WORD, -1)) - 1).cast("long")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set, else one of our own (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
    if not root:
        root = tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut, and a lost executor costs no recomputation.

    few_files: for narrow tables that are written again and again, no more tasks and files than four for each core.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if few_files else df).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


#: Folders of this process that have not been deleted yet.
_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one."""
    _made.append(f"{checkpoint_root(spark)}/marlstone-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no plan reads any more."""
    for t in tables:
        Storage(t.sparkSession, t.written_to).delete()
        _made.remove(t.written_to)


def clean(spark: SparkSession) -> None:
    """Deletes all folders that operators have made in this process. For when their results have been written: results
    are read lazily, so an operator can't know when its tables are done with."""
    while _made:
        Storage(spark, _made.pop()).delete()


def fresh(prefix: str, taken: list[str]) -> str:
    """A column name that clashes with none of those taken, whatever their case."""
    low = {c.lower() for c in taken}
    name = prefix
    while name.lower() in low:
        name = f"_{name}"
    return name


def kept_where(df: DataFrame, condition: str) -> DataFrame:
    """df.filter(condition) for conditions on columns that cost much to compute.

    The optimiser moves a filter below the projection that computes its columns, by putting their expressions in their
    place; an array that a lambda then names is computed again for each element. It doesn't move one across a column
    that differs from row to row.
    """
    still = fresh("still", df.columns)
    return df.withColumn(still, F.monotonically_increasing_id()).filter(f"({condition}) AND {still} >= 0").drop(still)


def give_back() -> None:
    """Returns freed memory to the system: workers wait for their next task, and those that wait share an executor's memory."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


BATCH_BYTES = 6_000_000


def _bound_batches() -> None:
    """Batches of rows on their way to Python have a bounded number of bytes, unless the session has a smaller bound of its own."""
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark is None:
        return
    now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
    if not 0 < now < BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shipped(function, *broadcasts):
    """A function for mapInArrow that also works where workers don't find this package by themselves.

    They find it if it was sent along with the job or is on their path; otherwise they look where the driver has it.
    Broadcast variables that the function uses are named, so that Spark sends them with it.
    """
    payload, root = cloudpickle.dumps(function), str(Path(__file__).resolve().parents[2])
    _bound_batches()

    def run(batches):
        import importlib.util
        import pickle
        import sys

        if importlib.util.find_spec("marlstone") is None:
            sys.path.append(root)
        from marlstone.llm.common import give_back

        try:
            yield from pickle.loads(payload)(batches)
        finally:
            give_back()

    run.needs = broadcasts
    return run
