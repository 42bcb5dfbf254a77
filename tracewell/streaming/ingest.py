"""Structured Streaming jobs.

Stored tables are Parquet by batch and by bucket of the key.  A batch reads only the buckets that its
keys fall into, and a batch that is tried again replaces its own partitions.  Folders of batches are merged
into new generations of the table, so that a store that is fed without end has few of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import epoch_us
from tracewell.operators.cluster import placements
from tracewell.operators.rows import first_per_key
from tracewell.operators.verify import stance_flips
from tracewell.params import KNOBS

PARTS = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("bucket", T.IntegerType())])


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _files(spark: SparkSession, folder: str):
    """(file system, path) of a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def _generation(spark: SparkSession, store: str) -> int:
    """The number of the newest whole generation of a store, -1 before there is one."""
    return max([int(n.rpartition("-")[2]) for n in _names(spark, store) if n.startswith("_whole-")], default=-1)


def _place(store: str, generation: int) -> str:
    return f"{store}/generation-{generation}"


def _whole(spark: SparkSession, store: str, generation: int) -> None:
    """From here on the generation is what readers read."""
    files, path = _files(spark, f"{store}/_whole-{generation}")
    files.create(path, True).close()


def _begin(spark: SparkSession, store: str, schema: T.StructType) -> None:
    """An empty table, if there is none yet."""
    if _generation(spark, store) < 0:
        spark.createDataFrame([], T.StructType([*schema, *PARTS])).write.mode("overwrite").partitionBy(*PARTS.names).parquet(_place(store, 0))
        _whole(spark, store, 0)


def _put(rows: DataFrame, store: str, number: int, keys: Sequence[str], buckets: int) -> None:
    dealt = rows.withColumns({"batch": F.lit(number), "bucket": _bucket(keys, buckets)})
    place = _place(store, _generation(rows.sparkSession, store))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS.names).parquet(place)


def _table(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema, *PARTS])).parquet(_place(store, _generation(spark, store)))


def _compact(spark: SparkSession, store: str, schema: T.StructType, number: int, most: int) -> None:
    """Before batch `number`: if there are more than `most` folders of batches, all batches before it, which have ended
    and are not tried again, become one, in a new generation of the store.  That counts from the moment it is
    whole; the one before stays for readers that have begun, and older ones go."""
    now = _generation(spark, store)
    if sum(n.startswith("batch=") for n in _names(spark, _place(store, now))) <= most:
        return
    rows = _table(spark, store, schema).where(F.col("batch") < number).withColumn("batch", F.lit(number - 1))
    # Few files a bucket: large buckets are split, small ones are one file.
    rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy(*PARTS.names).parquet(_place(store, now + 1))
    _whole(spark, store, now + 1)
    for old in range(now):
        for name in (f"_whole-{old}", f"generation-{old}"):
            files, path = _files(spark, f"{store}/{name}")
            files.delete(path, True)


def _buckets_of(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    """The buckets of rows, at most as many as there are."""
    return [r.b for r in rows.select(_bucket(keys, buckets).alias("b")).distinct().collect()]


def _run(spark: SparkSession, source: str, schema: str, state: str, each: Callable[[DataFrame, int], None]) -> None:
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def ingest_once(spark: SparkSession, source: str, schema: str, keys: list[str], order: str, store: str, state: str, counters: str | None = None, kind: str | None = None, buckets: int = 64, most_batches: int = 64) -> None:
    """Append to the table `store` the files of `source` that were not read yet, each key once, the first by
    order and then by its other columns (T1, T2).  One batch at a time; the stored table is what decides,
    so state does not grow.  With counters, a table of that name gets fetched, inserted and skipped rows of
    each batch by `kind` (T4)."""
    columns = T.StructType.fromDDL(schema)
    _begin(spark, store, columns)

    def append(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        _compact(here, store, columns, number, most_batches)
        batch = batch.persist()
        fresh = first_per_key(batch, keys, F.col(order), F.xxhash64(*batch.columns))
        have = _table(here, store, columns).where(F.col("bucket").isin(_buckets_of(batch, keys, buckets)) & (F.col("batch") != number))
        _put(fresh.join(have.select(*keys), keys, "left_anti"), store, number, keys, buckets)
        if counters:
            new = _table(here, store, columns).where(F.col("batch") == number).groupBy(kind).agg(F.count(F.lit(1)).alias("inserted"))
            counts = batch.groupBy(kind).agg(F.count(F.lit(1)).alias("fetched")).join(new, kind, "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
            counts.withColumn("skipped", F.col("fetched") - F.col("inserted")).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(counters)
        batch.unpersist()

    _run(spark, source, schema, state, append)


def stored(spark: SparkSession, store: str, schema: str) -> DataFrame:
    return _table(spark, store, T.StructType.fromDDL(schema)).drop(*PARTS.names)


EVENT = "id bigint, ts timestamp, embedding array<double>, entities array<bigint>"


def cluster_as_they_come(spark: SparkSession, source: str, schema: str, store: str, members: str, state: str, folder: str, hours: int = KNOBS.window_hours, buckets: int = 64, most_batches: int = 64, **knobs) -> None:
    """Events (EVENT: id, ts, embedding, entities) in files of `source` that were not read yet, placed among the
    clusters of the table `store` (id, ts, embedding, head, by stretch of time) and `members` (head, entity,
    by bucket of head) (T2, C9).  An event that is stored already stays where it is.  A batch reads the
    stretches of time and the buckets of heads that it meets, and replaces its own rows when it is tried
    again."""
    kept = T.StructType.fromDDL("id bigint, ts timestamp, embedding array<double>, head bigint")
    parts = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("stretch", T.LongType())])
    pair = T.StructType.fromDDL("head bigint, entity bigint")
    width = hours * 3_600_000_000
    stretch = F.floor(epoch_us("ts") / width)
    spark.createDataFrame([], T.StructType([*kept, *parts])).write.mode("ignore").partitionBy("batch", "stretch").parquet(store)
    _begin(spark, members, pair)

    def place(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        _compact(here, members, pair, number, most_batches)
        batch = batch.where("embedding is not null and ts is not null").dropDuplicates(["id"]).persist()
        have = here.read.schema(T.StructType([*kept, *parts])).parquet(store).where(F.col("batch") != number)
        near = batch.select(F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch")).distinct()
        fresh = batch.join(have.select("id"), "id", "left_anti")
        heads = _table(here, members, pair).where(F.col("batch") != number)
        placed = placements(fresh, have.join(near, "stretch", "left_semi").select("id", "ts", "embedding", "head"), heads, folder, hours=hours, **knobs)
        full = fresh.join(placed.select("id", "head"), "id").withColumn("batch", F.lit(number)).withColumn("stretch", stretch)
        full = full.persist()
        _put(full.select("head", F.explode("entities").alias("entity")).distinct(), members, number, ["head"], buckets)
        full.select(*kept.names, *parts.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "stretch").parquet(store)
        full.unpersist()
        batch.unpersist()

    _run(spark, source, schema, state, place)


STANCE = "head bigint, ts timestamp, entity bigint, topic int, role string, stance string, confidence double"
FLIP = STANCE + ", prior_head bigint, flip boolean"


def flips_as_they_come(spark: SparkSession, source: str, store: str, flips: str, state: str, buckets: int = 16, most_batches: int = 64) -> None:
    """Stances in files of `source`, in any order of time, kept in the table `store`, and their flips in the
    table `flips` (T3): what comes late changes what later stances of its entity and topic are compared
    with, so the flips of all keys in the buckets of a batch are computed anew and replaced."""
    columns, key = T.StructType.fromDDL(STANCE), ["entity", "topic"]
    _begin(spark, store, columns)

    def update(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        _compact(here, store, columns, number, most_batches)
        _put(batch, store, number, key, buckets)
        touched = _table(here, store, columns).where(F.col("bucket").isin(_buckets_of(batch, key, buckets)))
        fresh = stance_flips(touched.drop(*PARTS.names)).withColumn("bucket", _bucket(key, buckets))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(flips)

    _run(spark, source, STANCE, state, update)


def daily_counts(events: DataFrame, ts: str, kind: str, late: str = "1 day") -> DataFrame:
    """Rows of a stream (or table) per UTC day and kind; rows later than `late` are dropped from a stream
    (T4, T5)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), kind, "n", "total")


def new_folder(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
