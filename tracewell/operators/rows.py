"""First-per-key, upsert and selection operators over keyed rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df written to a new table of the folder and read again: lineage ends there."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_per_key(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order given, which should end in a unique column."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dealt(rows: DataFrame, keys: Sequence[str], per: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """rows by hash of keys, in `parts` partitions or about `per` rows in each, so that what a task holds does not grow
    with the input; in as many as Spark takes where those do for that.  Counts rows first unless parts is given."""
    parts = rows.count() // per + 1 if parts is None else parts
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def content_hash(source: Column, url: Column, payload: Column) -> Column:
    """SHA-256 of the parts, each ended by NUL."""
    end = F.decode(F.unhex(F.lit("00")), "UTF-8")
    return F.sha2(F.concat(source, end, url, end, payload, end), 256)


def canonical_json(payload: Column) -> Column:
    """JSON text with keys sorted at every depth and no spaces; numbers as Spark writes them."""
    return F.to_json(F.parse_json(payload))


def new_rows(rows: DataFrame, stored: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key that is not stored yet."""
    return first_per_key(rows, [key], *order).join(stored.select(key), key, "left_anti")


def changed_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of new that are not in old, or whose values are distinct there (D5-D7): keys, values, change
    ('insert' or 'update')."""
    was = old.select(*keys, F.struct(*values).alias("was"))
    both = new.join(was, list(keys), "left")
    change = F.when(F.col("was").isNull(), "insert").when(~F.struct(*values).eqNullSafe(F.col("was")), "update")
    return both.withColumn("change", change).where("change is not null").select(*keys, *values, "change")


def raw_rows(records: DataFrame) -> DataFrame:
    """records (..., entity_ids, unresolved) as stored: resolved and unresolved, without repeats and in
    order (D3)."""
    sorted_set = lambda c: F.sort_array(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    return records.withColumns({"resolved": sorted_set(F.col("entity_ids")), "unresolved": sorted_set(F.col("unresolved"))}).drop("entity_ids")


def rebuilt(stored: DataFrame, fresh: DataFrame, owner: str, refreshed: DataFrame) -> DataFrame:
    """stored with all rows of the owners in refreshed replaced by their fresh ones (D12): what an owner no
    longer has goes, and a second run changes nothing."""
    own = fresh.join(refreshed.select(owner).distinct(), owner, "left_semi")
    return stored.join(refreshed.select(owner).distinct(), owner, "left_anti").unionByName(own.select(*stored.columns))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """old with new's values where new has the key, and new's other rows."""
    columns = [*keys, *values]
    return old.select(*columns).join(new.select(*keys), list(keys), "left_anti").unionByName(new.select(*columns))


def pending(items: DataFrame, ledger: DataFrame, key: str, done: Column) -> DataFrame:
    """Items without a finished ledger row."""
    return items.join(ledger.where(done).select(key), key, "left_anti")


def capped(rows: DataFrame, day: str, used: DataFrame, cap: int, *order: Column) -> DataFrame:
    """The first rows of each day, as many as the cap leaves after those used (D15).  used: day, n."""
    rank = F.row_number().over(Window.partitionBy(day).orderBy(*order))
    left = F.greatest(F.lit(cap) - F.coalesce("n", F.lit(0)), F.lit(0))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= cap).join(used, day, "left").where(F.col("_rank") <= left).drop("_rank", "n")


def membership_hash(members: DataFrame, head: str, member: str, version: int = 1) -> DataFrame:
    """head, hash of its sorted members (D13): a head is refreshed when it differs from the stored one."""
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(member)), lambda x: x.cast("string")))
    return members.groupBy(head).agg(F.sha2(F.concat(F.lit(f"{version}:"), ids), 256).alias("member_hash"))


def stale_heads(hashes: DataFrame, stored: DataFrame, head: str) -> DataFrame:
    """Heads of hashes (head, member_hash) that stored does not have, or with another hash."""
    had = stored.select(head, F.col("member_hash").alias("_had"))
    return hashes.join(had, head, "left").where(~F.col("_had").eqNullSafe(F.col("member_hash"))).drop("_had")


def stale_vectors(members: DataFrame, vectors: DataFrame, key: str, model: str, check_text: bool = False) -> DataFrame:
    """Members without a vector of this model (D14); with check_text also those whose text hash moved."""
    have = vectors.select(key, F.col("model").alias("_model"), *([F.col("text_hash").alias("_hash")] if check_text else []))
    stale = ~F.col("_model").eqNullSafe(F.lit(model))
    if check_text:
        stale = stale | ~F.col("_hash").eqNullSafe(F.col("text_hash"))
    return members.join(have, key, "left").where(stale).drop("_model", "_hash")


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check with the number of rows that break it."""
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def archive(rows: DataFrame, path: str) -> None:
    """Write rows (source, event_date, ...) as JSON by source and day (D4); only the days that rows
    have are replaced."""
    days = rows.withColumns({"yyyy": F.date_format("event_date", "yyyy"), "mm": F.date_format("event_date", "MM"), "dd": F.date_format("event_date", "dd")})
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "yyyy", "mm", "dd").json(path)
