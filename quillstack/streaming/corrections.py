"""An extension: corrections arrive as a stream of saves and are folded into a snapshot, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillstack.operators.corpus import upsert_corrections

CHANGES = "seq long, line_id long, text string, kind string, note string"
STATE = "line_id long, id long, text string, kind string, note string"


def follow_corrections(spark: SparkSession, log: str, snapshots: str, checkpoint: str) -> StreamingQuery:
    """Fold the JSON change log in a folder into snapshots; each batch writes the next version and reads the last.

    A batch that is run again reads the same predecessor and writes the same version, so it has no effect."""

    def fold(changes: DataFrame, batch: int) -> None:
        session = changes.sparkSession
        before = session.read.schema(STATE).parquet(f"{snapshots}/v{batch - 1}") if batch else session.createDataFrame([], STATE)
        upsert_corrections(before, changes).select("line_id", "id", "text", "kind", "note").write.mode("overwrite").parquet(f"{snapshots}/v{batch}")

    stream = spark.readStream.schema(CHANGES).json(log)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
