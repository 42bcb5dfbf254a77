"""Suffix-array dedup over bytes: of equal strings of a given length all but the first go.

Suffixes are dealt into shards by the anchors of their windows (see paths.py), so that equal windows
always meet: whatever is plainly unique is left out, of stretches whose bytes have equal digests (128
bits of BLAKE2) one stands for all, and the rest, stretches where different texts fork at a shared anchor, is sorted.  A shard is sorted by induced
sorting: suffixes are classified as smaller or larger than their successor, leftmost-smaller substrings
are sorted recursively, and all others are induced from them in linear time.  Permuted common prefixes
then tell runs of suffixes that agree in `length` bytes, and within a run all but the earliest
(document, offset) go.

Anchors with more forks than a shard holds are dealt deeper, by the longer cores that classes of their
windows share (a fixed number of rows for each stretch); a core that is still too frequent is dealt to
several shards, and the earliest of each shard's runs are merged by their bytes across shards.

Cases: a null text is empty; texts shorter than the length lose nothing; rows with the same doc_id
and text count as one document, so neither repeats the other; rows that share a doc_id but not the text
are documents of their own, in the order of a hash of their texts; rows without a doc_id are compared
with nothing and lose nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, keyed, release, stash
from .paths import byte_symbols, class_key, classes, covered, forked, repeated_paths

#: Classes of windows by the offset of their anchor; each has a core that all its windows hold.
CORES = 8


# ------------------------------------------------------------------ induced sorting


def _deal(chars: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by char, rank within the char, number of each char) of chars, stable."""
    order = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=top + 1)
    return order, np.arange(len(chars)) - np.repeat(np.cumsum(count) - count, count), count


def _induce_buckets(s: np.ndarray, order: np.ndarray, heads: np.ndarray, ends: np.ndarray, larger_before: np.ndarray, smaller_before: np.ndarray) -> np.ndarray:
    """Induce all suffixes from the leftmost-smaller ones in order, for a small alphabet: bucket by
    bucket, all suffixes of a bucket that are known at a time."""
    top = len(heads) - 1
    out = np.full(len(s), -1, dtype=np.int64)
    by, rank, count = _deal(s[order], top)
    out[np.repeat(ends - count, count) + rank] = order[by]
    tails = ends - count

    def place(found: np.ndarray, before: np.ndarray, edge: np.ndarray, sign: int) -> None:
        chars = before[found]
        chosen = chars >= 0
        chars, found = chars[chosen], found[chosen]
        if len(found):
            by, rank, count = _deal(chars, top)
            at = np.repeat(edge, count)
            out[at + rank if sign > 0 else at - 1 - rank] = found[by] - 1
            edge += sign * count

    head = heads.copy()
    for c in range(top + 1):
        at = heads[c]
        while at < head[c]:
            at, part = head[c], out[at : head[c]]
            place(part, larger_before, head, 1)
        if tails[c] < ends[c]:
            place(out[tails[c] : ends[c]], larger_before, head, 1)
    tail = ends.copy()
    for c in range(top, -1, -1):
        at = ends[c]
        while at > tail[c]:
            at, part = tail[c], out[tail[c] : at][::-1]
            place(part, smaller_before, tail, -1)
        if heads[c] < head[c]:
            place(out[heads[c] : head[c]][::-1], smaller_before, tail, -1)
    return out


def _induce_names(s: np.ndarray, order: np.ndarray, heads: np.ndarray, ends: np.ndarray, larger_before: np.ndarray, smaller_before: np.ndarray) -> np.ndarray:
    """The same, suffix by suffix, for the many names of a reduced text."""
    s, out = s.tolist(), [-1] * len(s)
    # A last entry answers for empty places.
    larger, smaller = larger_before.tolist() + [-1], smaller_before.tolist() + [-1]
    tail = ends.tolist()
    for i in order[::-1].tolist():
        c = s[i]
        tail[c] = at = tail[c] - 1
        out[at] = i
    head = heads.tolist()
    for i in out:
        c = larger[i]
        if c >= 0:
            at = head[c]
            out[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for i in reversed(out):
        c = smaller[i]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            out[at] = i - 1
    return np.array(out, dtype=np.int64)


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """Suffix array of s by induced sorting.  s ends with 0, which occurs nowhere else; its symbols
    are at most top."""
    n = len(s)
    if n < 3:
        return np.arange(n - 1, -1, -1)
    # A suffix is smaller than its successor if its first unequal symbol is; equal ones follow suit.
    sign = np.sign(np.diff(s))
    known = np.flatnonzero(sign)
    follow = known[np.searchsorted(known, np.arange(n - 1))]
    smaller = np.append(sign[follow] > 0, True)
    left = np.zeros(n, dtype=bool)
    left[1:] = smaller[1:] & ~smaller[:-1]
    leftmost = np.flatnonzero(left)
    ends = np.cumsum(np.bincount(s, minlength=top + 1))
    heads = np.append(0, ends[:-1])
    # The symbol before each suffix if that is of the larger or the smaller type, else -1.
    before, kind = np.append(-1, s[:-1]), np.append(False, smaller[:-1])
    larger_before, smaller_before = np.where(kind, -1, before), np.where(kind, before, -1)
    induce = partial(_induce_buckets if top < 1024 else _induce_names, s, heads=heads, ends=ends, larger_before=larger_before, smaller_before=smaller_before)

    order = induce(order=leftmost)
    order = order[left[order]]
    # Name the leftmost-smaller substrings in their order; equal ones share a name.
    until = np.zeros(n, dtype=np.int64)
    until[leftmost] = np.append(leftmost[1:], n - 1)
    size = until[order] - order + 1
    new = np.ones(len(order), dtype=bool)
    new[1:] = size[1:] != size[:-1]
    same, at = np.flatnonzero(~new), 0
    while len(same):
        new[same[s[order[same] + at] != s[order[same - 1] + at]]] = True
        at += 1
        same = same[~new[same] & (at < size[same])]
    names = np.zeros(n, dtype=np.int64)
    names[order] = np.cumsum(new) - 1
    last = int(new.sum()) - 1
    if last + 1 < len(leftmost):
        order = leftmost[suffix_array(names[leftmost], last)]
    return induce(order=order)


def permuted_prefixes(s: np.ndarray, suffixes: np.ndarray, most: int, pack: int = 7) -> np.ndarray:
    """For each position the length, up to most, that its suffix shares with the one before it in the
    suffix array: all positions a step at a time, as long as they agree, `pack` symbols below 512 a
    step and then one by one.  The last symbol occurs once, so nothing agrees beyond it."""
    n = len(s)
    padded = np.append(s, np.zeros(pack, dtype=np.int64))
    packed = np.zeros(n, dtype=np.int64)
    for i in range(pack):
        packed |= padded[i : n + i] << (9 * i)
    before = np.full(n, -1, dtype=np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    out = np.zeros(n, dtype=np.int64)
    on = np.flatnonzero(before >= 0)
    ended = []
    for h in range(0, most - pack + 1, pack):
        same = packed[on + h] == packed[before[on] + h]
        ended.append(on[~same])
        on = on[same]
        out[on] = h + pack
    on = np.concatenate([*ended, on])
    for _ in range(pack):
        on = on[out[on] < most]
        on = on[padded[on + out[on]] == padded[before[on] + out[on]]]
        out[on] += 1
    return out


def equal_windows(pieces: list[bytes], documents: list[np.ndarray], starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, run, whether earlier than all others of its run) of the windows of `length` bytes
    in the pieces.  Piece i stands in the document (documents[0][i], documents[1][i], ...) at starts[i];
    windows at one place of one document count once."""
    if not pieces:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(bool)
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    first = np.cumsum(sizes + 1) - (sizes + 1)
    s = np.append(joined.astype(np.int64) + 2, 0)
    s[first + sizes] = 1
    order = suffix_array(s, 257)
    run = np.cumsum(permuted_prefixes(s, order, length)[order] < length)
    piece = np.searchsorted(first, order, side="right") - 1
    inside = order + length <= (first + sizes)[piece]
    run, piece, order = run[inside], piece[inside], order[inside]
    start = starts[piece] + order - first[piece]
    where = [d[piece] for d in documents]
    by = np.lexsort((start, *reversed(where), run))
    run, piece, start, where = run[by], piece[by], start[by], [d[by] for d in where]
    begins = np.ones(len(run), dtype=bool)
    begins[1:] = run[1:] != run[:-1]
    again = np.zeros(len(run), dtype=bool)
    again[1:] = ~begins[1:] & (start[1:] == start[:-1])
    for d in where:
        again[1:] &= d[1:] == d[:-1]
    return piece[~again], start[~again], run[~again], begins[~again]


# ------------------------------------------------------------------ dealing


def core_stretches(piece: bytes, mid: int, length: int, k: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(class, core, from, to) of the stretches of a piece whose windows hold the k bytes at mid at an
    offset of one class; all of them hold the core."""
    room = length - k
    cuts = [room * g // CORES for g in range(CORES)] + [room + 1]
    for g in range(CORES):
        lo, hi = cuts[g], cuts[g + 1] - 1
        if max(lo, mid + length - len(piece)) <= min(hi, mid):
            yield g, piece[mid - lo : mid + length - hi], max(0, mid - hi), min(len(piece), mid - lo + length)


def shared_stretches(pieces: list[bytes], mids: list[int], length: int, k: int) -> list[tuple[int, int, int]]:
    """(piece, from, to) of the stretches whose core another piece has too; neighbours are joined."""
    seen: dict[tuple[int, bytes], int] = {}
    for piece, mid in zip(pieces, mids):
        for g, core, _, _ in core_stretches(piece, mid, length, k):
            seen[g, core] = seen.get((g, core), 0) + 1
    out: list[tuple[int, int, int]] = []
    for n, (piece, mid) in enumerate(zip(pieces, mids)):
        last = None
        for g, core, start, stop in core_stretches(piece, mid, length, k):
            if seen[g, core] < 2:
                continue
            if last == g - 1:
                out[-1] = (n, min(start, out[-1][1]), max(stop, out[-1][2]))
            else:
                out.append((n, start, stop))
            last = g
    return out


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The stretches asked for, whole; shard is -1 for those of frequent anchors."""
    names = ["shard", "doc_id", "version", "at", "mid", "piece"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        ids, versions, ask = (batch.column(c).to_pylist() for c in ("doc_id", "version", "ask"))
        rows: list[tuple] = []
        for lo, hi, data, offsets in buffers(batch.column("text")):
            for i in range(hi - lo):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                for x in ask[lo + i]:
                    at, mid = x["span"] >> 16, x["span"] >> 8 & 255
                    rows.append((x["tag"], ids[lo + i], versions[lo + i], at, mid, own[at : at + (x["span"] & 255) + length]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, types)], names)


def _cores(batches: Iterator[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """The parts of pieces by core, named by a hash."""
    names = ["core", "doc_id", "version", "at", "mid", "piece"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        for doc, version, at, mid, piece in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "at", "mid", "piece"))):
            for g, core, start, stop in core_stretches(piece, mid, length, k):
                name = int.from_bytes(hashlib.blake2b(core, digest_size=8, salt=bytes([g])).digest(), "little", signed=True)
                rows.append((name, doc, version, at + start, -1, piece[start:stop]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 6, types)], names)


def _sort_shard(length: int, k: int):
    def sort_one(shard: pa.Table) -> pa.Table:
        pieces, mids = shard.column("piece").to_pylist(), shard.column("mid").to_pylist()
        parts = shared_stretches(pieces, mids, length, k) if mids[0] >= 0 else [(n, 0, len(p)) for n, p in enumerate(pieces)]
        n, begin = np.array([p[0] for p in parts], dtype=np.int64), np.array([p[1] for p in parts], dtype=np.int64)
        doc, version, at, split = (shard.column(c).to_numpy()[n] for c in ("doc_id", "version", "at", "split"))
        pieces = [pieces[i][a:b] for i, a, b in parts]
        piece, start, _, first = equal_windows(pieces, [doc, version], at + begin, length)
        # Later ones as stretches of neighbouring windows; the earliest of a run goes on, with its bytes, to
        # be merged where its core is dealt to several shards.
        by = np.lexsort((start[~first], piece[~first]))
        where, later = piece[~first][by], start[~first][by]
        new = np.ones(len(later), dtype=bool)
        new[1:] = (np.diff(where) != 0) | (np.diff(later) != 1)
        windows = np.diff(np.append(np.flatnonzero(new), len(later)))
        ahead = first & split[piece]
        where, at_all = np.concatenate([where[new], piece[ahead]]), np.concatenate([later[new], start[ahead]])
        own = start[ahead] - (at + begin)[piece[ahead]]
        bytes_of = [None] * len(windows) + [pieces[i][a : a + length] for i, a in zip(piece[ahead].tolist(), own.tolist())]
        return pa.table({"doc_id": doc[where], "version": version[where], "at": at_all, "windows": np.append(windows, np.ones(int(ahead.sum()), dtype=np.int64)), "window": pa.array(bytes_of, pa.binary())})

    return sort_one


def sorted_repeats(asking: DataFrame, length: int, k: int, shard_pieces: int, hot_pieces: int) -> DataFrame:
    """(doc_id, version, at, windows) of the windows in the stretches asked for that equal an earlier one,
    as stretches of `windows` neighbours."""
    pieces = asking.mapInArrow(partial(_pieces, length=length), "shard long, doc_id long, version long, at long, mid long, piece binary")
    if hot_pieces:
        # Read three times from here on; the texts, which are far larger, are joined and cut once.
        cut = pieces = stash(pieces, "pieces")
        # Of the stretches of frequent anchors those whose core is shared, in shards by core; a core
        # that one shard cannot hold has several.  A table of its own, so that Spark can split the join.
        cores = pieces.where("shard < 0").drop("shard").mapInArrow(partial(_cores, length=length, k=k), "core long, doc_id long, version long, at long, mid long, piece binary")
        often = stash(cores.groupBy("core").count().where("count >= 2").select("core", F.expr(f"cast(ceil(count / {shard_pieces}) as int)").alias("parts")), "cores")
        part = F.pmod(F.xxhash64("doc_id", "version", "at"), F.col("parts"))
        shards = hot_pieces * CORES // shard_pieces + 1
        dealt = cores.join(often, "core").select((-1 - F.pmod(F.xxhash64("core", part), F.lit(shards))).alias("shard"), "doc_id", "version", "at", "mid", "piece", (F.col("parts") > 1).alias("split"))
        dealt = stash(dealt, "core-stretches")
        pieces = pieces.where("shard >= 0").withColumn("split", F.lit(False)).unionByName(dealt)
    else:
        pieces = pieces.withColumn("split", F.lit(False))
    found = pieces.groupBy("shard").applyInArrow(_sort_shard(length, k), "doc_id long, version long, at long, windows long, window binary")
    if not hot_pieces:
        return found.drop("window")
    found = stash(found, "sorted")
    release(cut, often, dealt)
    firsts = found.where("window is not null")
    merged = firsts.groupBy("window").agg(F.min(F.struct("doc_id", "version", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    later = firsts.join(merged, "window").where(F.struct("doc_id", "version", "at") != F.col("first"))
    return found.where("window is null").drop("window").unionByName(later.select("doc_id", "version", "at", "windows"))


def _finish(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sure, single = batch.column("sure").to_pylist(), batch.column("single").to_pylist()
        n = batch.num_rows
        n_bytes, n_removed, n_spans, digest, kept = *(np.zeros(n, dtype=np.int64) for _ in range(3)), [""] * n, [b""] * n
        for lo, hi, data, offsets in buffers(batch.column("text")):
            for i in range(hi - lo):
                own = data[offsets[i] : offsets[i + 1]]
                n_bytes[lo + i] = len(own)
                if sure[lo + i] or single[lo + i]:
                    alone, spans = single[lo + i] or [], np.array(sure[lo + i] or [], dtype=np.int64)
                    start = np.concatenate([np.array([x["at"] for x in alone], dtype=np.int64), spans >> 16])
                    more = np.concatenate([np.array([x["windows"] - 1 for x in alone], dtype=np.int64), spans & 255])
                    gone = covered(start, start + length + more, len(own))
                    n_removed[lo + i], n_spans[lo + i] = gone.sum(), np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)
                    own = own[~gone]
                body = own.tobytes()
                digest[lo + i] = hashlib.sha256(body).hexdigest()
                if texts:
                    kept[lo + i] = body
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(digest), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup_bytes(docs: DataFrame, length: int = 100, k: int = 32, shard_pieces: int = 6000, texts: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    bytes left; empty with texts=False).  Removed is each byte covered by a string of `length` bytes
    that also starts earlier, in a smaller doc_id or before it in the same document.  shard_pieces is
    about the number of stretches that one task sorts at a time."""
    docs = keyed(docs)
    found = repeated_paths(docs.where(F.col("doc_id").isNotNull()), byte_symbols, length, k, exact=True)
    each = classes(found)
    forks = stash(forked(each), "forks")
    asked = stash(each.join(forks, "anchor").select("first.*", "anchor", "forks"), "fork-paths")
    copies = found.join(each.where("n >= 2").select(*class_key(found), "first"), class_key(found)).where(F.struct("doc_id", "version", "span") != F.col("first"))
    copies = stash(copies.select("doc_id", "version", "span"), "copies")
    release(found, each, forks)
    counts = asked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("forks") > shard_pieces).alias("hot")).first()
    shards = (counts.n - counts.hot) // shard_pieces + 1
    tag = F.when(F.col("forks") > shard_pieces, F.lit(-1)).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards))).cast("long")
    marks = copies.withColumn("tag", F.lit(None).cast("long")).unionByName(asked.select("doc_id", "version", "span", tag.alias("tag")))
    lists = marks.groupBy("doc_id", "version").agg(F.collect_list(F.when(F.col("tag").isNull(), F.col("span"))).alias("sure"), F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("span", "tag"))).alias("ask"))
    marked = docs.join(lists, ["doc_id", "version"], "left")
    gone = sorted_repeats(marked.where(F.size("ask") > 0).select("doc_id", "version", "text", "ask"), length, k, shard_pieces, counts.hot)
    gone = gone.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "windows")).alias("single"))
    return marked.join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "sure", "single").mapInArrow(partial(_finish, length=length, texts=texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
