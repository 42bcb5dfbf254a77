"""Secret scans: certain patterns stand alone, weak candidates count only when complementary parts
of one credential (identifier, secret, endpoint) stand close together.  The scope of a part is what lies
within `reach` characters of it.

One Arrow pass over whole texts finds all parts, in time linear in the text: no pattern is tried twice
from within one run of its characters.  An interval join in Spark on (document, stretch of `reach`
characters) links them.  The text itself is never shuffled, only the few parts.

Cases: a null text is empty; a text without parts gives zero counts, the digest of the empty string
and empty spans; rows are judged one by one, so repeated rows and null or repeated doc_ids each give
their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, stash

# The base patterns, with their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Weak parts.
WEAK_ID = re.compile(r"(?<![A-Z0-9])(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,}|(?:client|account|user)[_-]?(?:id|name)?[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}", re.ASCII | re.IGNORECASE)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=.-])")
ENDPOINT = re.compile(r"(?:https?|s3|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(?<![a-z0-9.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}\b")
#: Order of kinds where spans start together.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
#: What each kind is within a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_-=")]] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(":"), ord("=")]] = True

_PARTS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
PARTS = "array<struct<kind:string,start:int,end:int>>"
SCANNED = f"row long, doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base {PARTS}, weak {PARTS}"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns, in order."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _opaque(token: str) -> bool:
    """Letters and digits mixed, at 3 bits a character or more."""
    n = len(token)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
    return bits >= 3 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the stretches that the spans cover, in order and apart."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e, _ in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that overlap no base span; an earlier kind keeps its characters."""
    found: list[tuple[int, int, str]] = []
    for kind, pattern in (("endpoint", ENDPOINT), ("id", WEAK_ID), ("secret", WEAK_SECRET)):
        starts, ends = merged(base + found)
        for m in pattern.finditer(text):
            # The last taken stretch that begins before this one ends.
            at = bisect_left(starts, m.end()) - 1
            if at >= 0 and ends[at] > m.start() or kind == "secret" and not _opaque(m[0]):
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text, whether any pattern can match: it holds ':' or '=', or a run of 8 token characters
    with a digit or of 24 hex digits.  All patterns need one of these."""
    n = len(offsets) - 1
    flags = np.zeros(n, dtype=bool)
    where = np.flatnonzero(_MARK[data])
    flags[np.searchsorted(offsets, where, side="right") - 1] = True
    step = np.diff(np.concatenate([[False], _TOKEN[data], [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= 8
    start, end = start[long], end[long]
    if len(start):
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
        telling = (digits[end] > digits[start]) | (end - start >= 16)
        flags[np.searchsorted(offsets, start[telling], side="right") - 1] = True
        # A run may go on into the next texts.
        for s, e in zip(start[telling], end[telling]):
            a, b = np.searchsorted(offsets, [s, e - 1], side="right") - 1
            flags[a : b + 1] = True
    for at in _finds(data.tobytes(), b"AKIA"):
        flags[np.searchsorted(offsets, at, side="right") - 1] = True
    return flags


def _finds(data: bytes, what: bytes) -> Iterator[int]:
    at = data.find(what)
    while at >= 0:
        yield at
        at = data.find(what, at + 1)


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        n = len(texts)
        counts = {k: np.zeros(n, dtype=np.int64) for k in LEAST}
        digest, base_of, weak_of = [nothing] * n, [[]] * n, [[]] * n
        for lo, _, data, offsets in buffers(texts):
            for i in np.flatnonzero(_suspects(data, offsets)):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                base = base_spans(text)
                for _, _, kind in base:
                    counts[kind][lo + i] += 1
                if base:
                    digest[lo + i] = hashlib.sha256(joined(base).encode()).hexdigest()
                base_of[lo + i] = [{"kind": k, "start": s, "end": e} for s, e, k in base]
                weak_of[lo + i] = [{"kind": k, "start": s, "end": e} for s, e, k in weak_spans(text, base)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(row, row + n)), ids.cast(pa.int64()), *(pa.array(counts[k]) for k in LEAST), pa.array(digest, pa.string()), pa.array(base_of, _PARTS), pa.array(weak_of, _PARTS)],
            ["row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "weak"],
        )
        row += n


def _role(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])[kind]


def linked_parts(scanned: DataFrame, reach: int) -> DataFrame:
    """(row, linked): the weak parts that complementary parts within `reach` characters support.
    A weak secret or identifier needs an identifier or a secret or endpoint near by, an endpoint
    needs both others.  Interval join: equal (row, stretch), then the exact distance.  A weak part has
    the stretches it touches, others those within `reach` of them, so parts that near share one."""
    weak = scanned.select("row", F.inline("weak"))
    weak = weak.withColumn("stretch", F.explode(F.sequence(F.expr(f"start div {reach}"), F.expr(f"end div {reach}"))))
    parts = scanned.select("row", F.inline(F.concat("base", "weak")))
    near = parts.select("row", _role(F.col("kind")).alias("role"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.expr(f"start div {reach} - 1"), F.expr(f"end div {reach} + 1"))).alias("stretch"))
    # Pairs that share several stretches meet in each; roles are a set.
    weak = weak.withColumn("role", _role(F.col("kind")))
    hits = (
        weak.alias("w").join(near.alias("n"), ["row", "stretch"])
        .where((F.col("w.role") != F.col("n.role")) & (F.greatest(F.col("n.s") - F.col("w.end"), F.col("w.start") - F.col("n.e")) <= reach))
        .groupBy("row", "w.kind", "w.start", "w.end").agg(F.collect_set("n.role").alias("roles"))
    )
    enough = F.when(F.col("kind") == "endpoint", F.size("roles") >= 2).when(F.col("kind") == "id", F.array_contains("roles", "secret")).otherwise(F.size("roles") >= 1)
    return hits.where(enough).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))


def scan_secrets(docs: DataFrame, reach: int = 256) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_linked.  Offsets are code points, ends exclusive; spans holds base and linked spans as
    kind:start:end by start, then kind."""
    scanned = stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan_batches, SCANNED), "secret-parts")
    out = scanned.join(linked_parts(scanned, reach), "row", "left")
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    linked = F.coalesce("linked", F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    ordered = F.sort_array(F.transform(F.concat(base, linked), lambda x: F.struct(x["start"].alias("a"), rank[x["kind"]].alias("b"), x["end"].alias("c"), x["kind"].alias("d"))))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["d"], x["a"].cast("string"), x["c"].cast("string"))), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(linked).cast("long").alias("n_linked"))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in angle brackets; spans that overlap leave one mark
    each, but for those inside an earlier one."""
    at, out = 0, []
    for start, end, kind in sorted(spans):
        if end > at:
            out += [text[at : max(at, start)], f"<{kind}>"]
            at = end
    return "".join(out) + text[at:]


def _spotted(batches: Iterator[pa.RecordBatch], with_parts: bool) -> Iterator[pa.RecordBatch]:
    """The rows (own: all columns, text) with parts, numbered and with their parts; or else own of the
    rows without parts."""
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        texts, n = batch.column("text"), batch.num_rows
        parts: dict[int, tuple[list, list]] = {}
        for lo, _, data, offsets in buffers(texts):
            for i in np.flatnonzero(_suspects(data, offsets)):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                base = base_spans(text)
                weak = weak_spans(text, base)
                if base or weak:
                    parts[lo + int(i)] = (base, weak)
        mask = np.zeros(n, dtype=bool)
        mask[list(parts)] = True
        if not with_parts:
            yield batch.select(["own"]).filter(pa.array(~mask))
        elif parts:
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in parts[i][j]] for i in sorted(parts)], _PARTS) for j in (0, 1)]
            own = batch.filter(pa.array(mask))
            yield pa.RecordBatch.from_arrays([own.column("own"), own.column("text"), pa.array(np.arange(row, row + n)[mask]), *lists], names=["own", "text", "row", "base", "weak"])
        row += n


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series, marks: pd.Series) -> pd.Series:
    return pd.Series([redacted(t, [(m["start"], m["end"], m["kind"]) for m in ms]) for t, ms in zip(texts, marks)])


def redact(docs: DataFrame, reach: int = 256) -> DataFrame:
    """docs (text, ...) with base and linked spans of the texts replaced by their kinds.  Only rows that
    hold parts are written aside and joined; all others pass through one scan.  Columns of any other
    name are kept."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), "text")
    just = T.StructType([own.schema["own"]])
    found = T.StructType.fromDDL(f"text string, row long, base {PARTS}, weak {PARTS}")
    few = stash(own.mapInArrow(partial(_spotted, with_parts=True), T.StructType([*just, *found])), "secret-texts")
    linked = linked_parts(few.select("row", "base", "weak"), reach)
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    marked = few.join(linked, "row", "left").select("own", _redacted("text", F.concat(base, F.coalesce("linked", none))).alias("text"))
    clean = own.mapInArrow(partial(_spotted, with_parts=False), just).select("own", F.col("own.text").alias("text"))
    columns = [F.col("text") if c == "text" else F.col(f"own.`{c}`") for c in docs.columns]
    return clean.unionByName(marked).select(*columns)
