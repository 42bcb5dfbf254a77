"""Windows of a fixed length that may occur more than once, dealt out without moving every window.

The anchor of a window is its smallest k-gram (by hash, leftmost first), so equal windows have equal
anchors at equal distances and meet where their anchor is dealt.  Neighbouring windows of a text share
their anchor and make one path, a stretch of at most 2 * length - k symbols.  An anchor that occurs
once rules out all windows of its path; paths with equal contents are one class, however often it
occurs; only where different classes fork at one anchor have their windows to be compared.

Documents are told apart by (doc_id, version), see common.keyed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTES_A, BYTES_B, Rolling, buffers, mix, release, stash, word_hashes, word_spans

Symbols = tuple[np.ndarray, np.ndarray, np.ndarray]


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Two independent symbols for each byte, and where texts begin."""
    return BYTES_A[data], BYTES_B[data], offsets


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Two independent hashes of each word, and where texts begin."""
    start, end, first = word_spans(data, offsets)
    return word_hashes(data, start, end, 0), word_hashes(data, start, end, 1), first


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, in log(width) passes."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def paths(symbols: Symbols, length: int, k: int, rolling: type = Rolling) -> tuple[np.ndarray, ...]:
    """(text, first window, anchor's offset from it, further windows, anchor, content) of each path."""
    a, b, first = symbols
    counts = np.maximum(np.diff(first) - length + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none, none
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(total) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    grams = Rolling(a).grams(k)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_least(order, length - k + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(total, dtype=bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(at) != 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], total) - 1
    start, end, mid, text = at[lo], at[hi], anchor[lo], text[lo]
    content = mix(rolling(b).of(start, end + length) ^ ((mid - start).astype(np.uint64) << np.uint64(32)) ^ (end - start).astype(np.uint64))
    return text, start - first[text], mid - start, end - start, grams[mid].view(np.int64), content.view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], symbols: Callable, length: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in buffers(batch.column("text")):
            found = paths(symbols(data, offsets), length, k)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(found[4])], ["anchor"])


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes of each stretch and of its shape, in two halves."""
    raw, blake = data.tobytes(), hashlib.blake2b
    both = b"".join([blake(raw[s:e], digest_size=16).digest() for s, e in zip(start.tolist(), end.tolist())])
    halves = np.frombuffer(both, dtype=np.uint64).reshape(-1, 2)
    return (halves[:, 0] ^ mix(shape.astype(np.uint64))).view(np.int64), np.ascontiguousarray(halves[:, 1]).view(np.int64)


def _paths(batches: Iterator[pa.RecordBatch], symbols: Callable, length: int, k: int, follow: bool, exact: bool, rolling: type) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, versions = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
        for lo, _, data, offsets in buffers(batch.column("text")):
            text, start, mid, more, anchor, content = paths(symbols(data, offsets), length, k, rolling)
            if len(text):
                columns = {"anchor": anchor, "content": content, "doc_id": ids[lo + text].astype(np.int64), "version": versions[lo + text].astype(np.int64), "span": start << 16 | mid << 8 | more}
                if follow:
                    columns["next"] = np.where(np.append(text[1:], -1) == text, np.append(content[1:], 0), 0)
                if exact:
                    at = start + offsets[text]
                    columns["content"], columns["check"] = _digests(data, at, at + more + length, mid << 8 | more)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def repeated_paths(docs: DataFrame, symbols: Callable, length: int, k: int, follow: bool = False, exact: bool = False, rolling: type = Rolling) -> DataFrame:
    """The paths (anchor, content, doc_id, version, span) whose anchor occurs twice or more in docs
    (doc_id, version, text).  span packs first window << 16 | anchor's offset << 8 | further windows.
    With follow there is also next, the content of the path that follows in the text, 0 at its end.  With
    exact, for symbols that are bytes, content and check are a BLAKE2 digest of the path's bytes; else content is a
    fingerprint by `rolling`."""
    if length - k >= 256:
        raise ValueError("length - k must be below 256")
    again = docs.select("text").mapInArrow(partial(_anchors, symbols=symbols, length=length, k=k), "anchor long").groupBy("anchor").count().where("count >= 2").select("anchor")
    # A table of its own, so that Spark can split the tasks of frequent anchors in the join.
    again = stash(again, "anchors")
    schema = "anchor long, content long, doc_id long, version long, span long" + (", next long" if follow else "") + (", check long" if exact else "")
    every = docs.mapInArrow(partial(_paths, symbols=symbols, length=length, k=k, follow=follow, exact=exact, rolling=rolling), schema)
    found = stash(every.join(again, "anchor", "left_semi"), "paths")
    release(again)
    return found


def class_key(found: DataFrame) -> list[str]:
    """The columns that tell classes of paths apart."""
    return [c for c in ("anchor", "content", "check") if c in found.columns]


def classes(found: DataFrame, *more) -> DataFrame:
    """Per class of equal paths (anchor, content, check if there is one): n, its occurrences, the first of them (doc_id,
    version, span), and more aggregates."""
    return stash(found.groupBy(*class_key(found)).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "version", "span")).alias("first"), *more), "path-classes")


def forked(each: DataFrame) -> DataFrame:
    """Anchors at which several classes fork, and their number."""
    return each.groupBy("anchor").agg(F.count(F.lit(1)).alias("forks")).where("forks >= 2")


def windows_in(spans: np.ndarray, length: int, n: int) -> np.ndarray:
    """Starts of the windows of packed spans in a text of n symbols."""
    more = (spans & 255) + 1
    at = np.repeat((spans >> 16) - (np.cumsum(more) - more), more) + np.arange(int(more.sum()))
    return np.unique(at[at + length <= n])


def covered(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n symbols lie in any of the stretches [start, end)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]) > 0
