"""Substring dedup over words: long passages that occur more than once are removed wherever they stand.

De Bruijn compaction.  Edges are windows of `length` words, nodes the length - 1 words that neighbouring
windows share.  Edges are dealt out by anchors (see paths.py), where neighbours in a text make short
paths, and equal paths one class with its number of occurrences.  A node between two classes does not
branch if one class is always followed by the other (one edge leaves it) and both occur equally often
(one edge enters it); a join on the coordinates of their first occurrences finds such nodes, and classes
along them compact to unitigs.  A join with the occurrences of the first class of each unitig gives all
its source coordinates.  Where classes fork at an anchor, their windows are edges of their own.

Source coordinates then verify what repeats: a digest of the words that stand there must occur twice or
more.  The texts are moved once; what is moved before are paths, one for about twelve words, and
coordinates.

Cases: a null text has no words; texts shorter than the window lose nothing; the same window twice in
one text counts as a repeat; a repeated row repeats the passages of the other; rows that share a doc_id
but not the text are documents of their own; rows without a doc_id are compared with nothing and lose
nothing; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PrimeRolling, buffers, keyed, release, stash, word_spans
from .paths import classes, covered, forked, repeated_paths, windows_in, word_symbols

ROW = ("doc_id", "version")
#: Most parts of the edges of one content.
SALTS = 1024


def unitigs(each: DataFrame) -> DataFrame:
    """Compacted non-branching paths of the classes (anchor, content, n, first, low, high: least and
    greatest class that follows) that repeat: anchor and content of the first class of each, and windows,
    their number along the whole path."""
    again = each.where("n >= 2").select("anchor", "content", "n", "first.*", "low", "high")
    again = again.select("*", F.expr("span >> 16").alias("start"), F.expr("(span & 255) + 1").alias("windows")).drop("span")
    # Nodes that do not branch; the classes before and after one stand side by side in their first document.
    after = again.select(*ROW, "start", F.col("content").alias("low"), "n", F.lit(True).alias("inner"))
    before = again.where("low = high").select(*ROW, (F.col("start") + F.col("windows")).alias("start"), "low", "n")
    nodes = after.join(before, [*ROW, "start", "low", "n"]).select(*ROW, "start", "inner")
    place = again.join(nodes, [*ROW, "start"], "left")
    number = F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(Window.partitionBy(*ROW).orderBy("start"))
    chains = place.withColumn("chain", number).groupBy(*ROW, "chain")
    return chains.agg(F.min_by(F.struct("anchor", "content"), "start").alias("head"), F.sum("windows").alias("windows")).select("head.*", "windows")


def occurrences(found: DataFrame, each: DataFrame) -> DataFrame:
    """(doc_id, version, start, windows, unitig) of every repeated unitig in every text."""
    heads = unitigs(each)
    met = found.join(heads, ["anchor", "content"])
    return met.select(*ROW, F.expr("span >> 16").alias("start"), F.col("windows").cast("int").alias("windows"), F.xxhash64("anchor", "content").alias("unitig"))


EDGES = "unitig long, h long, g long, doc_id long, version long, at long, windows int, sure boolean"


def _edges(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For the coordinates asked for, what stands there: a digest (h, g) of the words of each unitig,
    and of each single window (unitig 0) of paths that fork; sure says that its class repeats anyway."""
    for batch in batches:
        ids, versions, ask, whole = (batch.column(c).to_pylist() for c in ("doc_id", "version", "ask", "whole"))
        for lo, hi, data, offsets in buffers(batch.column("text")):
            a, b, first = word_symbols(data, offsets)
            start, end, _ = word_spans(data, offsets)
            a, b = PrimeRolling(a, 0), PrimeRolling(b, 1)
            for i in range(hi - lo):
                base, n = int(first[i]), int(first[i + 1] - first[i])
                parts = []
                for sure in (False, True):
                    at = windows_in(np.array([x["span"] for x in ask[lo + i] or () if x["sure"] is sure], dtype=np.int64), length, n)
                    s = at + base
                    parts.append((np.zeros(len(s), dtype=np.int64), a.of(s, s + length).view(np.int64), b.of(s, s + length).view(np.int64), at, np.ones(len(s), dtype=np.int32), np.full(len(s), sure)))
                spans = [x for x in whole[lo + i] or () if x["start"] + x["windows"] + length - 1 <= n]
                if spans:
                    s = np.array([x["start"] for x in spans], dtype=np.int64) + base
                    e = s + np.array([x["windows"] for x in spans], dtype=np.int64) + length - 1
                    text, digest = data.tobytes() if len(spans) > 64 else data, []
                    for p, q in zip(s.tolist(), e.tolist()):
                        words = bytes(text[start[p] : end[q - 1]]).split()
                        digest.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    pair = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
                    parts.append((np.array([x["unitig"] for x in spans], dtype=np.int64), pair[:, 0], pair[:, 1], s - base, (e - s - length + 1).astype(np.int32), np.zeros(len(s), dtype=bool)))
                unitig, h, g, at, windows, sure = (np.concatenate([p[j] for p in parts]) for j in range(6))
                if len(at):
                    same = lambda x: pa.array(np.full(len(at), x, dtype=np.int64))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(unitig), pa.array(h), pa.array(g), same(ids[lo + i]), same(versions[lo + i]), pa.array(at), pa.array(windows), pa.array(sure)], ["unitig", "h", "g", "doc_id", "version", "at", "windows", "sure"])


def _finish(batches: Iterator[pa.RecordBatch], length: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("marks").to_pylist()
        n = batch.num_rows
        n_words, n_removed, digest, kept = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), [""] * n, [""] * n
        for lo, hi, data, offsets in buffers(batch.column("text")):
            start, end, first = word_spans(data, offsets)
            # Bytes of words, each with the one byte after it, which becomes the space between words.
            for i in range(hi - lo):
                s, e = start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
                gone = np.zeros(len(s), dtype=bool)
                if marks[lo + i]:
                    at = np.array([m["at"] for m in marks[lo + i]], dtype=np.int64)
                    gone = covered(at, at + np.array([m["windows"] for m in marks[lo + i]], dtype=np.int64) + length - 1, len(s))
                n_words[lo + i], n_removed[lo + i] = len(s), gone.sum()
                s, e = s[~gone], e[~gone]
                body = b""
                if len(s):
                    base = offsets[i]
                    own = np.append(data[base : offsets[i + 1]], np.uint8(32))
                    step = np.zeros(len(own) + 1, dtype=np.int8)
                    step[s - base] += 1
                    step[e - base + 1] -= 1
                    own[e - base] = 32
                    body = own[np.cumsum(step[:-1], dtype=np.int8) > 0][:-1].tobytes()
                digest[lo + i] = hashlib.sha256(body).hexdigest()
                if texts:
                    kept[lo + i] = body.decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_removed), pa.array(digest), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def dedup_passages(docs: DataFrame, length: int = 35, k: int = 12, texts: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256, kept (the words
    left, joined by one space; empty with texts=False).  Removed is each word in a window of `length`
    words that also starts anywhere else."""
    docs = keyed(docs)
    found = repeated_paths(docs.where(F.col("doc_id").isNotNull()), word_symbols, length, k, follow=True, rolling=PrimeRolling)
    each = classes(found, F.min("next").alias("low"), F.max("next").alias("high"))
    # Tables of their own, so that Spark can split the tasks of frequent anchors and unitigs in the joins.
    whole = stash(occurrences(found, each), "unitigs")
    forks = stash(forked(each).select("anchor"), "forks")
    ask = stash(each.join(forks, "anchor", "left_semi").select("first.*", (F.col("n") >= 2).alias("sure")), "fork-paths")
    release(found, each, forks)
    none = F.lit(None)
    asked = whole.select(*ROW, F.struct("start", "windows", "unitig").alias("w"), none.cast("struct<span:long,sure:boolean>").alias("a"))
    asked = asked.unionByName(ask.select(*ROW, none.cast("struct<start:long,windows:int,unitig:long>").alias("w"), F.struct("span", "sure").alias("a")))
    lists = asked.groupBy(*ROW).agg(F.collect_list("w").alias("whole"), F.collect_list("a").alias("ask"))
    marked = docs.join(lists, list(ROW), "left")
    edges = marked.where(F.col("whole").isNotNull()).select(*ROW, "text", "ask", "whole").mapInArrow(partial(_edges, length=length), EDGES)
    # Contents that repeat, once for each of the parts that their edges are dealt to, so that the edges of
    # a frequent passage never meet in one task; numbers and parts are combined before they are shuffled.
    key, salt = ["unitig", "h", "g"], F.pmod(F.xxhash64(*ROW), F.lit(SALTS)).cast("int")
    counts = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.collect_set(salt).alias("salts"))
    repeated = counts.where("n >= 2").select(*key, F.explode("salts").alias("salt"))
    again = edges.where("not sure").withColumn("salt", salt).join(repeated, [*key, "salt"], "left_semi")
    marks = again.groupBy(*ROW).agg(F.collect_list(F.struct("at", "windows")).alias("marks"))
    return marked.join(marks, list(ROW), "left").select("doc_id", "text", "marks").mapInArrow(partial(_finish, length=length, texts=texts), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
