"""Stance flips kept by entity and topic (T3): what comes late changes what it must, and no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.verify import stance_flips
from tracewell.params import KNOBS
from tracewell.streaming.ingest import FLIP, STANCE, _bucket, _buckets_of, _names

KEY = ["head", "ts", "entity", "topic", "role"]
SAID = ["stance", "confidence", "prior_head", "flip"]


def flip_changes(spark: SparkSession, source: str, flips: str, state: str, least: float = KNOBS.stance_confidence, most_files: int = 64, buckets: int = 16) -> None:
    """Stances in files of `source` that were not read yet, in any order of time, to the table `flips` (FLIP, by
    batch and by bucket of entity and topic): each batch writes the rows that are new and those whose prior or flip
    changed; see latest_flips.  A stance that comes again replaces itself.  `state` has what was read.

    A batch reads the buckets that it meets, and decides the stances of its own entities and topics anew, by joins
    and windows: no call is made for each entity and topic, of which there may be millions.  A batch that is tried
    again replaces its own rows."""
    pair = ["entity", "topic"]

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.where("entity is not null and topic is not null and ts is not null and head is not null").persist()
        met = _buckets_of(batch, pair, buckets)
        if met:
            here = batch.sparkSession
            # Before the first batch there is no table; one that is tried again has its own rows there.
            before = [f"{flips}/{n}" for n in _names(here, flips) if n.startswith("batch=") and n != f"batch={number}"]
            if before:
                held = _latest(here.read.option("basePath", flips).schema(FLIP + ", batch int, bucket int").parquet(*before).where(F.col("bucket").isin(met)))
                held = held.join(batch.select(*pair).distinct(), pair, "left_semi").select(*KEY, *SAID)
            else:
                held = here.createDataFrame([], FLIP).select(*KEY, *SAID)
            came = F.struct("came", "stance", "confidence")
            rows = held.select(*KEY, "stance", "confidence", F.lit(0).alias("came")).union(batch.select(*KEY, "stance", "confidence", F.lit(1).alias("came")))
            rows = rows.groupBy(*KEY).agg(F.max(came).alias("last")).select(*KEY, "last.stance", "last.confidence")
            now = stance_flips(rows, least).select(*KEY, *SAID, F.lit(True).alias("new"))
            both = now.union(held.withColumn("new", F.lit(False))).groupBy(*KEY).agg(F.max(F.when(F.col("new"), F.struct(*SAID))).alias("now"), F.max(F.when(~F.col("new"), F.struct(*SAID))).alias("was"))
            changed = both.where(~F.col("now").eqNullSafe(F.col("was"))).select(*KEY, "now.*", F.lit(number).alias("batch"), _bucket(pair, buckets).alias("bucket"))
            # Few files a bucket, whatever the number of shuffle partitions.
            changed.repartition("bucket", F.pmod("head", F.lit(4))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(flips)
        batch.unpersist()

    stream = spark.readStream.schema(STANCE).option("maxFilesPerTrigger", most_files).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _latest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("stance", F.when(F.col("confidence") >= 0, F.col("confidence")).alias("confidence"), "prior_head", "flip"), "batch")
    return rows.groupBy(*KEY).agg(last.alias("last")).select(*KEY, "last.*")


def latest_flips(spark: SparkSession, flips: str) -> DataFrame:
    """The flips as the last batch that said anything of each left them."""
    return _latest(spark.read.schema(FLIP + ", batch int").parquet(flips))
