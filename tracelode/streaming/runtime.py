"""Where streams keep state and how a bounded stream is run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import to_ts
from ..session import shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk next to the executor, with change logs in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def replay(df: DataFrame, ts: str = "ts_us", slices: int = 3, files: int = 2, until_us: int = 4_102_444_800_000_000) -> DataFrame:
    """A table as a stream of ``slices`` micro-batches, the newest rows first, with ``event_time``.

    The last batch is a mark of time: a row with all columns null but ``event_time``, ``until_us``. It lets the watermark pass
    everything before it, as a source that has gone quiet must. Rows without a time come first.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, "replay")
    timed = df.withColumn("event_time", to_ts(F.col(ts)))
    cuts = df.approxQuantile(ts, [i / slices for i in range(1, slices)], 0.01)
    at = F.lit(0)
    for cut in cuts:
        at = at + F.coalesce((F.col(ts) > cut).cast("int"), F.lit(1))
    for i in reversed(range(slices)):
        timed.where(at == i).repartition(files).write.mode("append").parquet(path)
    mark = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    spark.range(1).select(*mark, to_ts(F.lit(until_us)).alias("event_time")).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and return what it wrote.

    In ``complete`` mode every batch replaces the result; in ``append`` and ``update`` mode each
    batch has its own folder, so a repeated batch changes nothing.
    """
    from .detect import alert_sink

    spark = stream.sparkSession
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")
    if mode == "complete":
        def write(batch: DataFrame, _batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch_id=0")
    else:
        write = alert_sink(out)
    query = (
        stream.writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .outputMode(mode)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)
