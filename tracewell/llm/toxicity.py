"""Toxicity: a linear-chain conditional random field tags toxic tokens; forward-backward marginals
give document scores and the offending spans.

Learning sees at most `most_labels` labelled rows, whole texts of any length.  Spark counts in how many
toxic and clean texts each word and word prefix stands; those that are surely more frequent in toxic
ones (lower bound of the log odds) form a lexicon.  The field has two states,
emissions from the lexicon scores and transitions between neighbours.  Labels of documents are labels
of their tokens: all tokens of a clean text are clean, and some token of a toxic one is toxic, but which
ones the field finds out itself; emissions and transitions are fitted by gradient ascent on the
likelihood of just that.  A logistic fit turns the marginals of a text into its score.

Tagging passes over whole texts once, without a shuffle.  Tokens outside the lexicon all have the same
potentials, so a stretch of n of them is the n-th power of one 2 x 2 matrix, and forward-backward is
exact while it only visits lexicon hits.

Cases: null and empty texts get the score of a text without tokens; labels that are null or have no
document are not learned from; without labels of both classes every score is the share of toxic
labels; repeated rows are scored one by one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, stash, word_hashes, word_spans

PREFIXES = (4, 5, 6, 8)
#: Letters, digits and bytes of characters beyond ASCII are in tokens.
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True
#: Powers of the background matrix that are kept; higher ones are multiplied from these.
_POWERS = 1024
#: Least and most logit of an emission.
MOST_LOGIT = 30.0
#: Tokens of one stretch in the fit; longer texts are several stretches.
STRETCH = 64


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(start, end, first token of each text, feature hashes: the word, then its prefixes, 0 where the
    word is no longer than the prefix)."""
    start, end, first = word_spans(data, offsets, _INSIDE)
    data = LOWER[data]
    out = [word_hashes(data, start, end)]
    for n in PREFIXES:
        longer = np.flatnonzero(end - start > n)
        hashes = np.zeros(len(start), dtype=np.uint64)
        hashes[longer] = word_hashes(data, start[longer], start[longer] + n, n)
        out.append(hashes)
    return start, end, first, out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        for lo, hi, data, offsets in buffers(batch.column("text")):
            _, _, first, features = token_features(data, offsets)
            text = np.repeat(np.arange(hi - lo), np.diff(first))
            seen = [np.unique(np.stack([f, text.astype(np.uint64)])[:, f != 0], axis=1) for f in features]
            each = np.concatenate([s[0] for s in seen])
            bad = np.concatenate([toxic[lo + s[1].astype(np.int64)] for s in seen])
            names, at = np.unique(each, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.bincount(at, bad, len(names)).astype(np.int64)), pa.array(np.bincount(at, 1 - bad, len(names)).astype(np.int64))], ["feature", "bad", "good"])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most_labels: int = 12_000) -> DataFrame:
    """(text, toxic) of at most most_labels labelled documents that are not held out.  That bound is
    also the size of what is broadcast to find their texts."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = some.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    return stash(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic"), "toxic-labelled")


def lexicon(rows: DataFrame, least_texts: int = 4, least_odds: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes in order, their scores): the lower 95 % bound of the log odds of standing in a
    toxic text.  All of them are kept; they are at most the distinct features of the toxic rows over
    least_texts."""
    totals = rows.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = float(totals.bad or 0), float(totals.good or 0)
    if not bad or not good:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    counts = rows.mapInArrow(_count_batches, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("b"), F.sum("good").alias("g")).where(F.col("b") >= least_texts)
    p, q = F.col("b") + 0.5, F.col("g") + 0.5
    odds = F.log(p / (bad - F.col("b") + 0.5)) - F.log(q / (good - F.col("g") + 0.5)) - 1.96 * F.sqrt(1 / p + 1 / q)
    found = counts.select("feature", odds.alias("odds")).where(F.col("odds") >= least_odds).collect()
    names = np.array([r.feature for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(names)
    return names[order], np.array([r.odds for r in found])[order]


class Field:
    """The fitted field: lexicon, emission weights (bias, word score, prefix score), transitions, and
    the logistic fit of document scores (bias, then SUMMARY)."""

    def __init__(self, names: np.ndarray, odds: np.ndarray, share: float):
        self.names, self.odds = names, odds
        self.emit = np.array([-3.0, 1.0, 1.0])
        self.move = np.array([[0.0, -1.0], [0.0, 0.5]])
        self.fit = np.append(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.zeros(len(SUMMARY)))
        self.table = np.zeros(1 << 22, dtype=bool)
        self.table[(names >> np.uint64(42)).astype(np.int64)] = True

    def score_of(self, hashes: np.ndarray) -> np.ndarray:
        """Lexicon score of each feature hash, 0 outside the lexicon."""
        out = np.zeros(len(hashes))
        at = np.flatnonzero(self.table[(hashes >> np.uint64(42)).astype(np.int64)])
        if len(at):
            near = np.minimum(np.searchsorted(self.names, hashes[at]), len(self.names) - 1)
            same = self.names[near] == hashes[at]
            out[at[same]] = self.odds[near[same]]
        return out

    def inputs(self, features: list[np.ndarray]) -> np.ndarray:
        """(word score, best prefix score) of each token."""
        word = self.score_of(features[0])
        prefix = np.zeros(len(word))
        for f in features[1:]:
            prefix = np.maximum(prefix, self.score_of(f))
        return np.stack([word, prefix], axis=1)

    def prepare(self) -> None:
        """Normalised powers of the background matrix."""
        step = np.exp(self.move) * np.array([1.0, np.exp(self.emit[0])])
        self.power = np.empty((_POWERS, 2, 2))
        self.power[0] = np.eye(2)
        for n in range(1, _POWERS):
            self.power[n] = self.power[n - 1] @ step
            self.power[n] /= self.power[n].sum()

    def steps(self, n: int) -> np.ndarray:
        """n background steps, normalised."""
        if n < _POWERS:
            return self.power[n]
        more, rest = divmod(n, _POWERS - 1)
        out, base = self.power[rest], self.power[_POWERS - 1]
        while more:
            if more & 1:
                out = out @ base
                out = out / out.sum()
            base = base @ base
            base, more = base / base.sum(), more >> 1
        return out

    def marginals(self, positions: np.ndarray, inputs: np.ndarray, n: int) -> np.ndarray:
        """P(toxic) of the tokens at positions among n tokens; the others are background."""
        a = np.exp(self.move)
        e = np.exp(np.clip(self.emit[0] + inputs @ self.emit[1:], -MOST_LOGIT, MOST_LOGIT))
        bias = np.exp(self.emit[0])
        m = len(positions)
        gap = (np.diff(np.concatenate([[-1], positions, [n]])) - 1).tolist()
        forward, back = np.empty((m, 2)), np.empty((m, 2))
        # The first token has no transition: its potentials are its emission alone.
        v = np.array([1.0, bias if positions[0] else e[0]])
        if positions[0]:
            v = (v @ self.steps(gap[0] - 1)) @ a * np.array([1.0, e[0]])
        forward[0] = v / v.sum()
        for i in range(1, m):
            v = (forward[i - 1] @ self.steps(gap[i])) @ a * np.array([1.0, e[i]])
            forward[i] = v / v.sum()
        back[m - 1] = self.steps(gap[m]) @ np.ones(2)
        for i in range(m - 2, -1, -1):
            v = self.steps(gap[i + 1]) @ (a @ (np.array([1.0, e[i + 1]]) * back[i + 1]))
            back[i] = v / v.sum()
        both = forward * back
        return both[:, 1] / both.sum(axis=1)


#: What a document score is made of; the summary of a text without lexicon hits.
SUMMARY = ("any", "expected", "second", "density")
NOTHING = (-12.0, 0.0, 0.0, 0.0)


def summary(p: np.ndarray, size: int) -> tuple[float, ...]:
    """Log odds of any toxic token among those with marginals p in a text of `size` bytes, the log of the
    expected number of them, plus one, the second highest marginal, and the log of the expected number
    in a thousand bytes, plus one."""
    none = np.log1p(-np.minimum(p, 1 - 1e-9)).sum()
    second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
    return float(np.clip(np.log(-np.expm1(none) + 1e-9) - none, -12, 12)), float(np.log1p(p.sum())), second, float(np.log1p(1000 * p.sum() / (size + 100)))


def _tagged(field: Field, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, token starts, ends, positions in the text, marginals) of each text with lexicon hits; then
    offsets are bytes of that text."""
    for lo, _, data, offsets in buffers(texts):
        start, end, first, features = token_features(data, offsets)
        inputs = field.inputs(features)
        hits = np.flatnonzero(inputs.any(axis=1))
        for i in np.unique(np.searchsorted(first, hits, side="right") - 1) if len(hits) else ():
            own = hits[np.searchsorted(hits, first[i]) : np.searchsorted(hits, first[i + 1])]
            p = field.marginals(own - first[i], inputs[own], int(first[i + 1] - first[i]))
            yield lo + int(i), start[own] - offsets[i], end[own] - offsets[i], data[offsets[i] : offsets[i + 1]], p


def _hits(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    """For the fit: toxic, the number of tokens of each text, the positions of its lexicon hits and their
    inputs, two for each."""
    for batch in batches:
        toxic = batch.column("toxic").to_pylist()
        for lo, hi, data, offsets in buffers(batch.column("text")):
            _, _, first, features = token_features(data, offsets)
            inputs = field.inputs(features)
            hits = np.flatnonzero(inputs.any(axis=1))
            cut = np.searchsorted(hits, first)
            own = [hits[cut[i] : cut[i + 1]] for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic[lo:hi], pa.int32()), pa.array(np.diff(first)), pa.array([h - first[i] for i, h in enumerate(own)], pa.list_(pa.int64())), pa.array([inputs[h].ravel() for h in own], pa.list_(pa.float64()))],
                ["toxic", "n", "at", "x"],
            )


def _expectations(x: np.ndarray, size: np.ndarray, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected features less those of the path without toxic tokens, its log probability) of padded
    sequences x (n, t, 3): three emission features, then the four transitions."""
    n, t, _ = x.shape
    on = np.arange(t)[None, :] < size[:, None]
    pair = on[:, 1:]
    a = np.exp(move)
    e = np.exp(np.clip(x @ emit, -MOST_LOGIT, MOST_LOGIT))
    f, b, scale = np.empty((n, t, 2)), np.ones((n, t, 2)), np.zeros(n)
    v = np.stack([np.ones(n), e[:, 0]], axis=1)
    for k in range(t):
        if k:
            v = f[:, k - 1] @ a
            v[:, 1] *= e[:, k]
        total = v.sum(axis=1, keepdims=True)
        f[:, k] = v / total
        scale += np.where(on[:, k], np.log(total[:, 0]), 0.0)
    for k in range(t - 2, -1, -1):
        v = b[:, k + 1].copy()
        v[:, 1] *= e[:, k + 1]
        v = v @ a.T
        b[:, k] = np.where(on[:, k + 1, None], v / v.sum(axis=1, keepdims=True), 1.0)
    p = f * b
    p = p[..., 1] / p.sum(axis=-1) * on
    joint = f[:, :-1, :, None] * a * (np.stack([np.ones((n, t)), e], axis=-1) * b)[:, 1:, None, :]
    joint = joint / joint.sum(axis=(2, 3), keepdims=True) * pair[..., None, None]
    moves = joint.sum(axis=1).reshape(n, 4)
    moves[:, 0] -= size - 1
    return np.concatenate([np.einsum("ntf,nt->nf", x, p), moves], axis=1), move[0, 0] * (size - 1) - scale


def _train(field: Field, rows: list, steps: int = 120, at_once: int = 4096) -> None:
    """Fit emissions and transitions to rows (toxic, n, at, x of `_hits`).  Texts are cut into stretches
    of STRETCH tokens; stretches of one length without hits are one sequence.  A clean text says that
    all its tokens are clean, a toxic one that some is not: in the gradient a stretch counts -1 for a clean
    text, and the odds of none against any for a toxic one."""
    # Sequence i < STRETCH is that of i + 1 tokens without hits.
    seqs: list[tuple[int, np.ndarray, np.ndarray]] = [(k + 1, np.zeros(0, dtype=np.int64), np.zeros((0, 2))) for k in range(STRETCH)]
    text, seq, count = [], [], []
    for d, r in enumerate(rows):
        at, x = np.array(r.at, dtype=np.int64), np.array(r.x, dtype=float).reshape(-1, 2)
        full, rest = divmod(r.n, STRETCH)
        hit = np.unique(at // STRETCH)
        for k in hit.tolist():
            own = at // STRETCH == k
            text.append(d), seq.append(len(seqs)), count.append(1)
            seqs.append((STRETCH if k < full else rest, at[own] % STRETCH, x[own]))
        if full - (hit < full).sum():
            text.append(d), seq.append(STRETCH - 1), count.append(int(full - (hit < full).sum()))
        if rest and full not in hit:
            text.append(d), seq.append(rest - 1), count.append(1)
    if not text:
        return
    toxic = np.array([bool(r.toxic) for r in rows])
    text, seq, count = np.array(text), np.array(seq), np.array(count, dtype=float)
    size = np.array([n for n, _, _ in seqs])

    def padded(part: list) -> np.ndarray:
        x = np.zeros((len(part), STRETCH, 3))
        for i, (n, at, own) in enumerate(part):
            x[i, :n, 0], x[i, at, 1:] = 1, own
        return x

    parts = [(padded(seqs[i : i + at_once]), size[i : i + at_once]) for i in range(0, len(seqs), at_once)]
    theta = np.concatenate([field.emit, field.move.ravel()])
    speed, m1, m2 = 0.2, np.zeros(7), np.zeros(7)
    for step in range(1, steps + 1):
        found = [_expectations(x, n, theta[:3], theta[3:].reshape(2, 2)) for x, n in parts]
        more, none = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        # Log probability of no toxic token in each text, and the odds of that.
        clean = np.minimum(np.bincount(text, none[seq] * count, len(rows)), -1e-9)
        weight = np.where(toxic, np.exp(clean) / -np.expm1(clean), -1.0)
        grad = np.bincount(seq, weight[text] * count, len(seqs)) @ more / len(rows) - 1e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta += speed * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    field.emit, field.move = theta[:3], theta[3:].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit with a small ridge, by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


def learn(rows: DataFrame) -> Field:
    """The field from training_rows, all of which fit emissions, transitions and the score.  The driver
    fetches the lexicon hits of these rows and their summaries."""
    names, odds = lexicon(rows)
    share = rows.agg(F.avg("toxic")).first()[0] or 0.0
    field = Field(names, odds, share)
    field.prepare()
    if not len(names):
        return field
    _train(field, rows.orderBy("doc_id", F.xxhash64("text")).mapInArrow(partial(_hits, field=field), "toxic int, n long, at array<long>, x array<double>").collect())
    field.prepare()
    found = rows.mapInArrow(partial(_summaries, field=field), ", ".join(f"{c} double" for c in SUMMARY) + ", toxic int").collect()
    x, y = np.array([r[: len(SUMMARY)] for r in found]), np.array([r["toxic"] for r in found], dtype=float)
    field.fit = _logistic(x, y)
    return field


def _summaries(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.tile(np.array(NOTHING), (batch.num_rows, 1))
        for row, _, _, text, p in _tagged(field, batch.column("text")):
            out[row] = summary(p, len(text))
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in out.T), batch.column("toxic")], [*SUMMARY, "toxic"])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def _score(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, spans = np.tile(np.array(NOTHING), (batch.num_rows, 1)), [[]] * batch.num_rows
        for row, start, end, text, p in _tagged(field, batch.column("text")):
            x[row] = summary(p, len(text))
            bad = p >= 0.5
            if bad.any():
                points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                spans[row] = [{"start": int(points[s]), "end": int(points[e]), "p": float(q)} for s, e, q in zip(start[bad], end[bad], p[bad])]
        score = 1 / (1 + np.exp(-np.clip(field.fit[0] + x @ field.fit[1:], -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])


def score_texts(docs: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, score, predicted, spans (start, end, p: tokens more
    likely toxic than not, offsets in code points)."""
    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_score, field=field), "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
