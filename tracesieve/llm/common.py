"""What several operators share: stored intermediate results, Arrow loops, names without clashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value of the contracts: a word is a run of bytes other than ASCII white space, which is
# also what bytes.split() makes of UTF-8 text.
WORD = r"[^\x20\x09-\x0D]+"

SLICE = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where it is unset and the session runs in one process, as in tests, a new folder
    is taken: one in the warehouse. On a cluster that would lose data, so it is refused."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints-{uuid.uuid4().hex}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept where lost executors do not take it along."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: like ``stored``, but columnar, so that wide rows take
    less room and readers only read the columns they use."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def map_batches(
    df: DataFrame,
    work: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    rows: int = SLICE,
) -> DataFrame:
    """Apply ``work`` to slices of ``rows`` rows; rows stay in their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield work(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, named alike whatever else ``docs`` has."""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id: 64 bits of the text, 0 for null."""
    return F.coalesce(F.xxhash64(text, F.length(text)), F.lit(0))
