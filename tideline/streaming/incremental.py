"""The incremental run as a stream: micro-batches against saved state in ``foreachBatch``, or one key within a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.ledger import Ledger
from tideline.operators.state import checkpoint as cut
from tideline.operators.state import split_new


def shared_folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-stream-')}/stream-{uuid.uuid4().hex}"


def run(stream: DataFrame, shape, seen: DataFrame, groups: DataFrame, out: str, checkpoint: str):
    """Start the query: new rows (id, silent) of each batch are appended to ``out``.

    ``shape`` makes postings of a batch's raw rows.  State is the given ``seen`` and what
    ``out`` holds already, so a batch that is tried again emits nothing twice; rows are
    recorded by the very write that emits them.
    """
    kept = ["ord", "id", "ats_key", "seed_group", "silent"]

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = seen.select("id", "ats_key")
        path = session._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            known = known.union(session.read.parquet(out).where(F.col("batch") < number).select("id", "ats_key"))
        new = split_new(shape(batch), known, groups)
        new.select(kept).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(stream: DataFrame, shape, seen: DataFrame, groups: DataFrame) -> DataFrame:
    """Process what has landed and return the new rows: id and silent."""
    folder = shared_folder(stream.sparkSession)
    run(stream, shape, seen, groups, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out").select("id", "silent")


def run_on_ledger(stream: DataFrame, shape, ledger: Ledger, groups: DataFrame, out: str, checkpoint: str):
    """Start the query with a ledger as its state: nothing that was emitted before is read again.

    A batch is written to ``out`` first and then recorded with its number, so that one tried
    again is made anew from the same version or, once recorded, left as it is.
    """
    columns = [f.split()[0] for f in ledger.schema.split(", ")]

    def step(batch: DataFrame, number: int) -> None:
        version, listed = ledger.newest()
        if listed.get("note", {}).get("batch", -1) >= number:
            return
        new = cut(split_new(shape(batch), ledger, groups))
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")
        ledger.append(new.select(*columns), version, {"batch": number})

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_stream(stream: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """The first row of each id, as a stream; an id is forgotten ``delay`` after its time, and rows later than that go.

    State is kept by Spark, partitioned by id, and bounded by the ids within the delay.
    """
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
