"""Import runs as a stream: every new export root is one batch of the same pipeline.

Identical posts are legitimate, so the stream doesn't drop duplicates; the run's own cascade decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.plans.inventory import import_collection


def watch(spark: SparkSession, arrivals: str, store_folder: str, checkpoint: str, profile: str = "default", **trigger) -> StreamingQuery:
    """Imports each export root that a line of a text file in ``arrivals`` names, once, in order of their names.

    ``trigger`` as for ``DataStreamWriter.trigger``; by default all that has arrived, then stop.
    """

    def run(batch: DataFrame, _: int) -> None:
        # A batch lists folders, not records.
        for row in batch.where(F.trim("value") != "").select(F.trim("value").alias("root")).distinct().orderBy("root").collect():
            import_collection(spark, [row.root], store_folder, profile)

    stream = spark.readStream.text(arrivals)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
