"""Helpers shared by the training-data operators: table access, the shared scratch folder,
and vectorised hashing of text held in Arrow buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, for Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir.  Where that is unset, a
    session on one machine (tests) gets a temporary folder; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/tracewell-{spark.sparkContext.applicationId}"
    return where.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id as long, text, keep, and version: 0, or a hash of the text in rows that share a doc_id with
    others.  Rows are told apart by (doc_id, version); those with equal texts too are one document."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    shared = stash(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count >= 2").select("doc_id"), "shared-ids")
    if not shared.limit(1).count():
        release(shared)
        return docs.withColumn("version", F.lit(0).cast("long"))
    # Few ids are shared as a rule; Spark broadcasts them while they are below its own limit.
    shared = shared.withColumn("shared", F.lit(True))
    return docs.join(shared, "doc_id", "left").withColumn("version", F.when(F.col("shared"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0)).cast("long")).drop("shared")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that occurs in a lambda is evaluated
    for each element, a lambda variable is not."""
    return F.transform(F.array(value), body).getItem(0)


def words(text: Column) -> Column:
    """Array of the words between ASCII white space; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters unchanged; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ------------------------------------------------------------------ hashing over Arrow buffers


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64) if have is None else have
        with np.errstate(over="ignore"):
            while len(have) < n:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


class Rolling:
    """Fingerprints of any stretch [s, e) of a sequence of 64-bit symbols in constant time:
    prefix sums of symbol * base**i, shifted back by the inverse power."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.back[s])

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k])


#: 2**31 - 1, and two bases for each of two fingerprints.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = ((1_103_515_245, 1_566_083_941), (1_812_433_253, 1_664_525_013))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo _PRIME, for x below 2**62."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _prime_powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(-base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64) if have is None else have
        while len(have) < n:
            have = np.concatenate([have, _reduced(have * np.uint64(pow(base, len(have), int(_PRIME))))])
        _powers[-base] = have
    return have[:n]


class PrimeRolling:
    """Fingerprints of any stretch [s, e) of a sequence of 64-bit symbols in constant time: polynomials over the
    two halves of the symbols modulo a prime, in two bases.  `which` chooses one of two independent pairs of
    bases."""

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        self.sums, self.back = [], []
        for base, half in zip(_BASES[which], (symbols >> np.uint64(32), symbols & np.uint64(0xFFFFFFFF))):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_reduced(_reduced(half) * _prime_powers(base, n)), out=sums[1:])
            self.sums.append(_reduced(sums))
            self.back.append(_prime_powers(pow(base, -1, int(_PRIME)), n + 1))

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_reduced(sums[e] + _PRIME - sums[s]) * back[s]) for sums, back in zip(self.sums, self.back))
        return mix(one << np.uint64(31) | two)

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums[0]) - k)
        at = np.arange(n)
        return self.of(at, at + k)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each stretch [start, end), which takes in eight bytes after the other."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    n = end - start
    out = mix(n.astype(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15))
    rows, at, left = np.arange(len(start)), start, n
    step = np.uint64(0x632BE59BD9B4E019 + 2 * seed)
    while len(rows):
        chunk = eight[at] & _MASKS[np.minimum(left, 8)]
        out[rows] = mix((out[rows] ^ chunk) * np.uint64(0xD6E8FEB86659FD93) + step)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return out


_rng = np.random.default_rng(20240131)
#: Two independent tables that turn a byte into a 64-bit symbol.
BYTES_A = _rng.integers(1, M64, 256, dtype=np.uint64)
BYTES_B = _rng.integers(1, M64, 256, dtype=np.uint64)
#: Bytes that are part of words when words are split at ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffers(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about `most` bytes, whole texts only;
    null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) of the words of all texts in data: maximal runs of
    bytes for which `inside` holds, cut at the ends of texts."""
    flag = np.zeros(len(data) + 1, dtype=bool)
    flag[:-1] = inside[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = flag[:-1]
    edge = offsets[offsets < len(data)]
    starts_at = flag & ~before
    ends_at = before & ~flag
    starts_at[edge] = flag[edge]
    cut = edge[edge > 0]
    ends_at[cut] = before[cut]
    start, end = np.flatnonzero(starts_at), np.flatnonzero(ends_at)
    return start, end, np.searchsorted(start, offsets)
