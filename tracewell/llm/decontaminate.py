"""Benchmark decontamination by pigeonhole edit matching.

Text and items are compared with A-Z lower-cased and white space runs as one space.  An item of n
bytes may differ by k = error_rate * n edits; it is split into k + 1 pieces, so each occurrence within
the budget holds some piece unchanged.  Piece hits are found by their first eight bytes over whole
Arrow batches, and Myers' bit-parallel distance verifies the surroundings of a hit.  The items are a
stated query set: they go to the tasks in blocks of bounded bytes, one pass over the documents for
each block, whose results are written before the next block is fetched.  Documents are never shuffled.

Cases: null or empty texts and items match nothing; items shorter than 1 / error_rate bytes must occur
exactly; repeated rows give a match each; an empty table on either side gives no match; edits are
counted in bytes of UTF-8; further columns are ignored by find_items and kept by flag_items, which
replaces one that has the name of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, buffers, stash

HEAD = 8
_TO_SPACE = LOWER.copy()
_TO_SPACE[~NOT_SPACE] = 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, original position of each byte) with case and white space evened out."""
    out = _TO_SPACE[data]
    blank = out == 32
    again = np.zeros(len(out), dtype=bool)
    again[1:] = blank[1:] & blank[:-1]
    again[offsets[offsets < len(out)]] = False
    kept = np.flatnonzero(~again)
    return out[kept], np.searchsorted(kept, offsets), kept


def even(text: str) -> bytes:
    data = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    return normalised(data, np.array([0, len(data)]))[0].tobytes().strip(b" ")


def edit_search(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of pattern in text, anywhere, if within most; Myers' bit
    vectors, one step for each byte of text."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
        if score < best[0]:
            best = (score, at + 1)
    return best if best[0] <= most else None


def edit_start(pattern: bytes, text: bytes, end: int, most: int) -> int:
    """Start of the match that ends at `end`: the same search backwards."""
    found = edit_search(pattern[::-1], text[:end][::-1], most)
    return max(0, end - found[1]) if found else max(0, end - len(pattern))


class PieceIndex:
    """Pieces of a block of items, looked up by their first bytes."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items: dict[int, tuple[int, bytes, int]] = {}
        self.pieces: dict[bytes, list[tuple[int, int]]] = {}
        for n, (item_id, text) in enumerate(items):
            body = even(text or "")
            if not body:
                continue
            most = int(error_rate * len(body))
            self.items[n] = (item_id, body, most)
            cut = [len(body) * j // (most + 1) for j in range(most + 2)]
            for a, b in zip(cut, cut[1:]):
                self.pieces.setdefault(body[a:b], []).append((n, a))
        long = [p for p in self.pieces if len(p) >= HEAD]
        self.short = [p for p in self.pieces if len(p) < HEAD]
        self.by_head: dict[int, list[bytes]] = {}
        for p in long:
            self.by_head.setdefault(int.from_bytes(p[:HEAD], "little"), []).append(p)
        self.heads = np.array(sorted(self.by_head), dtype=np.uint64)
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[self._slot(self.heads)] = True

    @staticmethod
    def _slot(x: np.ndarray) -> np.ndarray:
        return (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def hits(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, piece's offset in it) of each piece in data."""
        whole = data.tobytes()
        if len(data) >= HEAD and len(self.heads):
            x = data.astype(np.uint64)
            x = x[:-1] | x[1:] << np.uint64(8)
            x = x[:-2] | x[2:] << np.uint64(16)
            x = x[:-4] | x[4:] << np.uint64(32)
            at = np.flatnonzero(self.table[self._slot(x)])
            near = np.searchsorted(self.heads, x[at])
            at = at[self.heads[np.minimum(near, len(self.heads) - 1)] == x[at]]
            for p in at.tolist():
                for piece in self.by_head[int(x[p])]:
                    if whole.startswith(piece, p):
                        for n, a in self.pieces[piece]:
                            yield p, n, a
        for piece in self.short:
            p = whole.find(piece)
            while p >= 0:
                for n, a in self.pieces[piece]:
                    yield p, n, a
                p = whole.find(piece, p + 1)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """{(text, item): (distance, start, end)}: the best match of each item in each text, the first
        of equal ones."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for p, n, a in self.hits(data):
            i = int(np.searchsorted(offsets, p, side="right")) - 1
            _, body, most = self.items[n]
            if (i, n, p - a) in tried:
                continue
            tried.add((i, n, p - a))
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            start, stop = max(lo, p - a), min(hi, p - a + len(body))
            if data[start:stop].tobytes() == body:
                new = (0, start - lo, stop - lo)
            else:
                start = max(lo, p - a - most)
                text = data[start : min(hi, p - a + len(body) + most)].tobytes()
                found = edit_search(body, text, most)
                if not found:
                    continue
                new = (found[0], start - lo + edit_start(body, text, found[1], found[0]), start - lo + found[1])
            best[i, n] = min(best.get((i, n), new), new)
        return best


def _find(batches: Iterator[pa.RecordBatch], items: list, error_rate: float) -> Iterator[pa.RecordBatch]:
    index = PieceIndex(items, error_rate)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for lo, _, data, offsets in buffers(batch.column("text")):
            even_data, even_offsets, origin = normalised(data, offsets)
            rows = []
            for (i, n), (distance, s, e) in sorted(index.matches(even_data, even_offsets).items()):
                base = even_offsets[i]
                rows.append((ids[lo + i], index.items[n][0], distance, int(origin[base + s] - offsets[i]), int(origin[base + e - 1] + 1 - offsets[i])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "distance", "start", "end"])


def _flag(batches: Iterator[pa.RecordBatch], items: list, error_rate: float, name: str) -> Iterator[pa.RecordBatch]:
    index = PieceIndex(items, error_rate)
    for batch in batches:
        flags = np.array(batch.column(name).to_pylist(), dtype=bool)
        for lo, _, data, offsets in buffers(batch.column("text")):
            even_data, even_offsets, _ = normalised(data, offsets)
            for i, _ in index.matches(even_data, even_offsets):
                flags[lo + i] = True
        at = batch.schema.get_field_index(name)
        yield pa.RecordBatch.from_arrays([pa.array(flags) if j == at else batch.column(j) for j in range(batch.num_columns)], names=batch.schema.names)


def item_blocks(items: DataFrame, block_bytes: int = 8 << 20) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """(items (item_id, text) of a block of about block_bytes, whether more blocks follow).  A block is
    fetched when it is asked for; that bounds what the driver and the tasks hold at once."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield [(r.item_id, r.text) for r in part.select("item_id", "text").collect()], b + 1 < blocks


def find_items(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, block_bytes: int = 8 << 20) -> DataFrame:
    """Matches of items (item_id, text) in docs (doc_id, text): doc_id, item_id, distance, start, end,
    one row for each document and item; offsets in bytes of the text, end exclusive."""
    schema = "doc_id long, item_id long, distance long, start long, end long"
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block, more in item_blocks(items, block_bytes):
        found = docs.mapInArrow(partial(_find, items=block, error_rate=error_rate), schema)
        if more or out is not None:
            found = stash(found, "item-matches")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def flag_items(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, name: str = "contaminated", block_bytes: int = 8 << 20) -> DataFrame:
    """docs with one more column: whether the text holds any item."""
    out = docs.withColumn(name, F.lit(False))
    for block, more in item_blocks(items, block_bytes):
        out = out.mapInArrow(partial(_flag, items=block, error_rate=error_rate, name=name), out.schema)
        if more:
            out = stash(out, "item-flags")
    return out
