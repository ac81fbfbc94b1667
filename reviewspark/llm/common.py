"""Small helpers of this subpackage: stored intermediate tables and word patterns."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewspark.scale import small
from reviewspark.session import free_shuffles, scratch_path

#: Words as the contracts define them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but columnar and compressed. Shuffles of what was stored before are given back.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that the engine hands to Python at once, and bytes that a task works on at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def mapped(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in bounded memory.

    Batches are kept small on both sides (the session's Arrow batch size is lowered, never raised), and what
    the allocators of a worker hold free is given back at the end of a task, so that stages that follow each
    other in one worker do not add up.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, int(b.num_rows * BATCH_BYTES / max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, step):
                yield b.slice(lo, step)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches))
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return df.mapInArrow(whole, schema)


#: Keys up to this number are broadcast to a scan; more are joined by a shuffle.
SMALL_KEYS = 1_000_000


def drop_rows(docs: DataFrame, drop: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``docs`` without those whose ``keys`` are in ``drop``; of the ``repeated`` keys one row each.

    Texts stay where they are as long as the keys are few; only repeated rows meet in an aggregate.
    """
    def match(side, how):
        cond = None
        for k in keys:
            term = F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}"))
            cond = term if cond is None else cond & term
        return docs.alias("d").join(small(side, SMALL_KEYS).alias("k"), cond, how)

    repeated = stored(repeated.select(*keys), "repeated-keys")
    if repeated.isEmpty():
        return match(drop.select(*keys), "left_anti")
    once = match(drop.select(*keys).union(repeated), "left_anti")
    return once.unionByName(match(repeated, "left_semi").dropDuplicates(keys))
