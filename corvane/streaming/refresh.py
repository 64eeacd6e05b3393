"""Continuous refresh: arriving JSON documents become chunks, each document version once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import structure

SCHEMA = "id string, title string, text string"


def _land(path: str, rows: DataFrame, batch: int) -> None:
    """A batch has a folder of its own, so a batch that is done again replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch:012d}")


def refresh(spark: SparkSession, inbox: str, out: str, checkpoint: str, healthy: Callable[[], bool] = lambda: True, full_every: int = 0, once: bool = True, seconds: int = 60) -> StreamingQuery:
    """Chunks of the documents in ``inbox`` (JSON lines) to ``out``/batch=N; what was read is kept at
    ``checkpoint``. ``once`` works off what is there, else a batch starts every ``seconds`` seconds. A
    batch raises, and is retried at the next start, while ``healthy`` says no. Every
    ``full_every``-th batch rebuilds ``out``/full from all chunks so far."""

    def step(batch: DataFrame, number: int) -> None:
        if not healthy():
            raise RuntimeError("not healthy: the batch stays for the next start")
        _land(out, structure.chunk(batch.dropDuplicates(["id"])), number)
        if full_every and (number + 1) % full_every == 0:
            spark.read.option("basePath", out).parquet(f"{out}/batch=*").dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{out}/full")

    stream = spark.readStream.schema(SCHEMA).json(inbox).where(F.col("id").isNotNull())
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(seconds, 60)} seconds")).start()
