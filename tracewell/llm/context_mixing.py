"""Language-model scores by logistic context mixing, in bits.

The model codes a text as its lower-case words, each as its UTF-8 bytes and a space, and a line feed at the end,
bit after bit.  Bits are predicted by counts of zeros and ones seen in training after hashed contexts: the
last one, two, three and four bytes within the word, the first two and the last two, and the whole word so far;
for the first two bytes of a word, the byte before and a class of the word before (of its last two bytes).
The logits of these predictors are summed with weights; a gate, how often the word's beginning and its last
four bytes were seen and which bit it is, says which set of weights holds.  Weights are learned online: from
chunk to chunk of the training words, each bit weighing as often as it occurs, predicted by counts from which
that occurrence itself is taken out.  The mixed probability is then refined adaptively: per gate and step of
the logit, by the share of ones that training saw there.  A text's score is the sum over its bits, so -score /
log10(2) / bytes are its bits per byte.

On Spark: texts become parts of about 16 MB, each with its own list of distinct words, in one scan.  Words are counted
over all parts; what is gathered so grows with the corpus.  Words that begin alike are dealt to a block (words
of a frequent beginning by a longer one), which holds the complete counts of every beginning that the whole-word
predictor uses; where several blocks share such a beginning, they are told its counts over all of them, so
what is counted does not depend on how words are dealt.  Counts of the shorter contexts are summed by Spark into a table of 2**slot_bits hashed slots, and those of
first bytes into one of at most classes * 65,536; both are broadcast and bounded by these parameters.  Weights
are learned per block and averaged by the bits seen.  Scores of words go back to the parts that hold them,
where the texts are word numbers by then.

Cases: a null or empty text is its end alone; a text or word of any length is scored whole (beginnings over
32 bytes have no whole-word predictor); a row without a doc_id is held out; repeated rows are scored and
learned from each; with nothing to learn from, all words are unknown; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, mix, release, stash, word_hashes, word_spans

SPACE_BYTE, END_BYTE = 0x20, 0x0A
#: Bytes of a word's beginning up to which the whole-word predictor reaches.
DEPTH = 32
#: Bytes of a word's beginning from which it does; every block holds the whole counts from there on, or is told them.
BEGIN = 6
#: What a count of zero and one begins with.
PRIOR = 0.4
#: Steps of the logit in the last refinement.
STEPS = 33
#: Words hashed at once.
HASHED = 1 << 18
#: The word scores of a part, column after column.
PACKED = (("idx", "<i4"), ("c", "<i8"), ("tail", "<f8"), ("code", "<i4"), ("bytes", "<i4"))
ENCODED = "part long, doc_id long, held_out boolean, n_tokens long, ids binary, word string, idx int, code int, n long"


def classes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, classes: int) -> np.ndarray:
    """Class 1 to classes - 1 of each word, by its last two bytes."""
    two = data[end - 1].astype(np.uint64) | data[np.maximum(end - 2, start)].astype(np.uint64) << np.uint64(8)
    return 1 + (mix(two + np.uint64(77)) % np.uint64(classes - 1)).astype(np.int64)


def heads_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first two bytes that code each word."""
    return data[start].astype(np.int64) << 8 | np.where(end - start > 1, data[np.minimum(start + 1, end - 1)], SPACE_BYTE)


def short_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each) of numbers below 2**28, seven bits a byte."""
    size = 1 + (values >= 1 << 7).astype(np.int8) + (values >= 1 << 14) + (values >= 1 << 21)
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(4):
        some = size > k
        out[at[some] + k] = values[some] >> 7 * k & 127 | np.where(size[some] > k + 1, 128, 0)
    return out, size


def long_numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers that short_numbers has written."""
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


# ------------------------------------------------------------------------------- texts to parts


def _encoded(batches: Iterator[pa.RecordBatch], classes: int, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: texts (doc_id ... ids: numbers of words in the part), the part's words (word, idx, n:
    occurrences in training), and pairs of the class before and first bytes (code, n)."""
    part = (TaskContext.get().partitionId() << 16) - 1
    for batch in batches:
        doc_id, learned = batch.column("doc_id"), batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, offsets in buffers(batch.column("text"), part_bytes):
            part += 1
            data = LOWER[data]
            start, end, first = word_spans(data, offsets)
            texts = hi - lo
            # Each text's words and, as one more, its end.
            each = np.diff(first) + 1
            cut = np.concatenate([[0], np.cumsum(each)])
            at = np.arange(len(start)) + np.repeat(np.arange(texts), np.diff(first))
            key = np.zeros(cut[-1], dtype=np.uint64)
            for k in range(0, len(start), HASHED):
                key[at[k : k + HASHED]] = word_hashes(data, start[k : k + HASHED], end[k : k + HASHED]) | np.uint64(1)
            _, place, idx, often = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            del key
            # Frequent words get small numbers.
            order = np.argsort(-often, kind="stable")
            place, rank = place[order], np.empty(len(order), dtype=np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            idx = rank[idx]
            weight = np.repeat(learned[lo:hi], each)
            n = np.bincount(idx[weight], minlength=len(place))
            # Where each distinct word stands; the end of a text is none.
            token = np.full(cut[-1], -1, dtype=np.int32)
            token[at] = np.arange(len(start), dtype=np.int32)
            own = token[place]
            del at, token
            ended = own < 0
            s, e = (np.where(ended, 0, x[np.maximum(own, 0)]) if len(x) else np.zeros(len(own), dtype=np.int64) for x in (start, end))
            del start, end
            code = np.full(len(place), END_BYTE << 8, dtype=np.int32)
            code[~ended] = classes_of(data, s[~ended], e[~ended], classes) << 16 | heads_of(data, s[~ended], e[~ended])
            before = np.zeros(len(idx), dtype=np.int32)
            before[1:] = code[idx[:-1]] & ~0xFFFF
            before[cut[:-1]] = 0
            before |= code[idx] & 0xFFFF
            pair = np.unique(before)
            seen = np.bincount(np.searchsorted(pair, before[weight]), minlength=len(pair))
            del before, weight
            size = e - s
            ends = np.concatenate([[0], np.cumsum(size)])
            raw = data[np.repeat(s - ends[:-1], size) + np.arange(ends[-1])]
            words = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
            numbers, lengths = short_numbers(idx)
            del idx
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), texts, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)])[cut].astype(np.int64)), pa.py_buffer(numbers)]).cast(pa.binary())
            for rows, columns in (
                (texts, {"doc_id": doc_id.slice(lo, texts), "held_out": pa.array(~learned[lo:hi]), "n_tokens": pa.array(each), "ids": ids}),
                (len(place), {"word": words, "idx": pa.array(np.arange(len(place), dtype=np.int32)), "n": pa.array(n)}),
                (len(pair), {"code": pa.array(pair), "n": pa.array(seen)}),
            ):
                columns["part"] = pa.array(np.full(rows, part))
                kinds = {"part": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "ids": pa.binary(), "word": pa.string(), "idx": pa.int32(), "code": pa.int32(), "n": pa.int64()}
                yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(rows, t) for c, t in kinds.items()], list(kinds))


# ------------------------------------------------------------------------------------ counts and bits


def node_counts(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For symbols seen n times after contexts: how often the context was followed by each beginning, of 0 to 8
    bits, of the symbol."""
    key = context.astype(np.int64) << 8 | symbol
    order = None
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    out = np.zeros((len(key), 9), dtype=np.int64)
    for bits in range(9):
        node = key >> (8 - bits)
        new = np.ones(len(node), dtype=bool)
        new[1:] = node[1:] != node[:-1]
        at = np.flatnonzero(new)
        if len(at):
            out[:, bits] = np.add.reduceat(n, at)[np.cumsum(new) - 1]
    if order is not None:
        back = np.empty_like(out)
        back[order] = out
        return back
    return out


class Edges:
    """The bytes from the third on of a block's sorted distinct words, each once for all words that share all up to it."""

    def __init__(self, words: pa.Array, n: np.ndarray, begins: np.ndarray, known: pa.Array | None = None):
        """known: for words whose beginning other blocks have too, the counts over all blocks of `known_nodes`."""
        words = words.cast(pa.large_binary())
        _, offsets, data = words.buffers()
        offset = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.concatenate([np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), np.zeros(DEPTH + 1, dtype=np.uint8)])
        size = np.diff(offset)
        grid = data[offset[:-1, None] + np.arange(DEPTH)[None, :]]
        grid[np.arange(DEPTH)[None, :] >= size[:, None]] = 0
        common = np.full(len(size), -1, dtype=np.int64)
        if len(size) > 1:
            apart = grid[1:] != grid[:-1]
            common[1:] = np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), DEPTH), np.minimum(size[1:], size[:-1]))
        parts, links, total = [], [], 0
        for p in range(2, DEPTH):
            here = np.flatnonzero(size >= p)
            if not len(here):
                break
            symbol = np.where(size[here] > p, grid[here, p], SPACE_BYTE).astype(np.int64)
            new = common[here] <= p
            first = np.flatnonzero(new)
            context = np.cumsum(common[here] < p)[first]
            weight = np.add.reduceat(n[here], first)
            nodes = node_counts(context, symbol[first], weight)
            nodes[begins[here[first]] > p, :] = 0
            if known is not None and p >= BEGIN:
                told = here[first][known.is_valid().to_numpy(zero_copy_only=False)[here[first]]]
                at = known.offsets.to_numpy()[told] + 9 * (p - BEGIN)
                nodes[np.isin(here[first], told)] = known.values.to_numpy()[at[:, None] + np.arange(9)]
            parts.append((here[first], np.full(len(first), p), symbol[first], weight, nodes))
            links.append((here, np.cumsum(new) - 1 + total))
            total += len(first)
        long = np.flatnonzero(size >= DEPTH)
        if len(long):
            more = size[long] - DEPTH + 1
            word = np.repeat(long, more)
            at = DEPTH + np.arange(len(word)) - np.repeat(np.cumsum(more) - more, more)
            symbol = np.where(at < size[word], data[offset[word] + at], SPACE_BYTE).astype(np.int64)
            parts.append((word, at, symbol, n[word], np.zeros((len(word), 9), dtype=np.int64)))
            links.append((word, np.arange(len(word)) + total))
        self.word, self.at, self.symbol, self.weight, self.nodes = (np.concatenate([x[i] for x in parts]) if parts else np.zeros((0, 9) if i == 4 else 0, dtype=np.int64) for i in range(5))
        self.links = tuple(np.concatenate([x[i] for x in links]) if links else np.zeros(0, dtype=np.int64) for i in range(2))
        place = offset[self.word] + self.at
        last = [np.where(self.at >= k, data[np.maximum(place - k, 0)], np.where(self.at == k - 1, SPACE_BYTE, 0)).astype(np.uint64) for k in range(1, 5)]
        head = data[offset[self.word]].astype(np.uint64) << np.uint64(8) | data[offset[self.word] + 1]
        one = last[0]
        two = one | last[1] << np.uint64(8)
        three = two | last[2] << np.uint64(16)
        four = three | last[3] << np.uint64(24)
        # The last byte stays free for a symbol.
        self.contexts = [mix(x + (np.uint64(i + 1) << np.uint64(56))) & ~np.uint64(255) for i, x in enumerate((one, two, three, four, head << np.uint64(16) | two))]

    def __len__(self) -> int:
        return len(self.symbol)


#: Predictors of a bit: five hashed contexts, the word so far, a constant.
INPUTS = 7
GATES = 6 * 4 * 8


def slots(context: np.ndarray, symbol: np.ndarray, bits: int, mask: np.uint64) -> np.ndarray:
    """Slot of the counts for the bit after the first `bits` of the symbol."""
    node = (1 << bits | symbol >> (8 - bits)).astype(np.uint64)
    return (mix(context + node * np.uint64(0x9E3779B97F4A7C15)) & mask).astype(np.int64)


def logit(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))


def features(edges: Edges, rows: slice, table: np.ndarray, leave: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, gate, bit) of the 8 bits of each edge; with leave = 1 the counts lack one occurrence of the bit."""
    symbol, nodes, contexts = edges.symbol[rows], edges.nodes[rows], [c[rows] for c in edges.contexts]
    mask = np.uint64(table.shape[0] - 1)
    x = np.ones((8, len(symbol), INPUTS), dtype=np.float32)
    gate, bit = np.zeros((8, len(symbol)), dtype=np.int64), np.zeros((8, len(symbol)), dtype=np.int64)
    for k in range(8):
        bit[k] = symbol >> (7 - k) & 1
        on = bit[k].astype(bool)
        for i, context in enumerate(contexts):
            pair = table[slots(context, symbol, k, mask)]
            zeros, ones = pair[:, 0], pair[:, 1]
            if leave:
                zeros, ones = np.maximum(zeros - ~on, 0), np.maximum(ones - on, 0)
            x[k, :, i] = logit(ones, zeros)
            if i == 3:
                met = zeros + ones
        same = np.maximum(nodes[:, k + 1] - leave, 0)
        other = nodes[:, k] - nodes[:, k + 1]
        x[k, :, 5] = logit(np.where(on, same, other).astype(np.float32), np.where(on, other, same).astype(np.float32))
        x[k, :, 6] = 0.3
        gate[k] = (np.searchsorted([1, 2, 4, 16, 256], same + other, "right") * 4 + np.searchsorted([1, 8, 64], met, "right")) * 8 + k
    return x.reshape(-1, INPUTS), gate.ravel(), bit.ravel()


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -16, 16)))


def mixed(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Logit of each bit being one."""
    return np.clip(np.einsum("bi,bi->b", x, weights[gate].astype(np.float32)), -12, 12)


def step_of(z: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """Cell of the last refinement."""
    return gate // 8 * STEPS + np.round((z + 12) * ((STEPS - 1) / 24)).astype(np.int64)


def online(chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray, gates: int, epochs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights after the chunks (inputs, gate, bit, weight) have passed `epochs` times, the bits that each gate saw, and bits
    and ones of the refinement's cells in the last pass."""
    inputs = weights.shape[1]
    weights, curve, mass = weights.copy(), np.full(weights.shape, 1e-3), np.zeros(gates)
    seen, ones = np.zeros(gates // 8 * STEPS), np.zeros(gates // 8 * STEPS)
    for epoch in range(epochs):
        for x, gate, bit, n in chunks:
            z = mixed(x, gate, weights)
            p = squash(z)
            if epoch == epochs - 1:
                cell = step_of(z, gate)
                seen += np.bincount(cell, weights=n, minlength=len(seen))
                ones += np.bincount(cell, weights=n * bit, minlength=len(seen))
                mass += np.bincount(gate, weights=n, minlength=gates)
            wrong, bend = n * (bit - p), n * p * (1 - p)
            for i in range(inputs):
                slope = np.bincount(gate, weights=wrong * x[:, i], minlength=gates)
                curve[:, i] = 0.9 * curve[:, i] + np.bincount(gate, weights=bend * x[:, i] * x[:, i], minlength=gates)
                # A step along one input alone would be slope / curve; inputs agree, so each takes a share.
                weights[:, i] += np.clip(slope / (curve[:, i] * inputs), -0.25, 0.25)
    return weights, mass, seen, ones


def refined(z: np.ndarray, gate: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Probability of a one: mixed, and what was seen at that logit, half each."""
    return np.clip(0.5 * squash(z) + 0.5 * shares[step_of(z, gate)], 1e-6, 1 - 1e-6)


def shares_of(seen: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Share of ones per cell of the refinement; the cell's own logit counts as 8 bits seen."""
    centre = squash((np.arange(len(seen)) % STEPS) * (24 / (STEPS - 1)) - 12)
    return (ones + 8 * centre) / (seen + 8)


CHUNK = 8192


def _edges_of(block: pa.Table) -> tuple[pa.Table, Edges]:
    block = block.take(pc.sort_indices(block, sort_keys=[("word", "ascending")]))
    word = block.column("word").combine_chunks()
    known = block.column("known").combine_chunks() if "known" in block.column_names else None
    return block, Edges(word, block.column("n").to_numpy(), block.column("begins").to_numpy(), known)


def _contexts(block: pa.Table) -> pa.Table:
    """How often each byte followed each hashed context."""
    _, edges = _edges_of(block)
    use = edges.weight > 0
    key = np.concatenate([c[use] | edges.symbol[use].astype(np.uint64) for c in edges.contexts])
    name, where = np.unique(key, return_inverse=True)
    n = np.bincount(where, weights=np.tile(edges.weight[use], len(edges.contexts)), minlength=len(name))
    return pa.table({"key": name.view(np.int64), "n": n.astype(np.int64)})


def _slots(batches: Iterator[pa.RecordBatch], slot_bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of bytes after contexts as counts of bits in slots."""
    size = 1 << slot_bits
    count = np.zeros(2 * size)
    for batch in batches:
        key, n = batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        symbol = (key & np.uint64(255)).astype(np.int64)
        for k in range(8):
            at = slots(key & ~np.uint64(255), symbol, k, np.uint64(size - 1))
            np.add.at(count, 2 * at + (symbol >> (7 - k) & 1), n)
    slot = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot].astype(np.int64))], ["slot", "n"])


def _learned(block: pa.Table, table, epochs: int) -> pa.Table:
    """What one block adds to the weights (cell = gate * INPUTS + input) and to the refinement (cells after those)."""
    _, edges = _edges_of(block)
    use = np.flatnonzero(edges.weight > 0)
    chunks = []
    for lo in range(0, len(use), CHUNK):
        rows = use[lo : lo + CHUNK]
        chunks.append((*features(edges, rows, table.value, 1), np.tile(edges.weight[rows], 8).astype(np.float64)))
    weights, mass, seen, ones = online(chunks, np.full((GATES, INPUTS), 0.3), GATES, epochs)
    part = np.concatenate([(weights * mass[:, None]).ravel(), ones])
    whole = np.concatenate([np.repeat(mass, INPUTS), seen])
    cell = np.flatnonzero(whole)
    return pa.table({"cell": cell, "part": part[cell], "whole": whole[cell]})


def _scored(block: pa.Table, table, weights: np.ndarray, shares: np.ndarray, classes: int) -> pa.Table:
    """log10 probability of each word after its first two bytes, and code, its class and these bytes."""
    block, edges = _edges_of(block)
    bits = np.zeros(len(edges))
    for lo in range(0, len(edges), CHUNK):
        x, gate, bit = features(edges, slice(lo, lo + CHUNK), table.value, 0)
        p = refined(mixed(x, gate, weights), gate, shares)
        bits[lo : lo + CHUNK] = np.log10(np.where(bit, p, 1 - p)).reshape(8, -1).sum(axis=0)
    word, edge = edges.links
    _, offsets, data = block.column("word").combine_chunks().cast(pa.large_binary()).buffers()
    data, ends = np.frombuffer(data, dtype=np.uint8), np.frombuffer(offsets, dtype=np.int64)[: block.num_rows + 1]
    code = classes_of(data, ends[:-1], ends[1:], classes) << 16 | heads_of(data, ends[:-1], ends[1:])
    return pa.table({"word": block.column("word"), "n": block.column("n"), "code": code.astype(np.int32), "tail": np.bincount(word, weights=bits[edge], minlength=block.num_rows)})


def first_bytes(code: np.ndarray, n: np.ndarray, epochs: int) -> np.ndarray:
    """log10 probability of each pair of class and first bytes (code), seen n times in training: of the first byte after no
    context and after the class, of the second after the first and after both."""
    group, one, two = code >> 16, code >> 8 & 255, code & 255
    out = np.zeros(len(code))
    for context, symbol in (((np.zeros_like(code), group), one), ((one, code >> 8), two)):
        key, where = np.unique((group << 16 | one << 8 | two) if symbol is two else (group << 8 | one), return_inverse=True)
        place = np.unique(where, return_index=True)[1]
        weight = np.bincount(where, weights=n, minlength=len(key)).astype(np.int64)
        nodes = [node_counts(c[place], symbol[place], weight) for c in context]

        def inputs(leave, nodes=nodes, symbol=symbol[place]):
            x, gate, bit = np.zeros((8, len(symbol), 3)), np.zeros((8, len(symbol)), dtype=np.int64), np.zeros((8, len(symbol)), dtype=np.int64)
            for k in range(8):
                bit[k] = symbol >> (7 - k) & 1
                for i, c in enumerate(nodes):
                    same, other = np.maximum(c[:, k + 1] - leave, 0), c[:, k] - c[:, k + 1]
                    x[k, :, i] = logit(np.where(bit[k], same, other), np.where(bit[k], other, same))
                x[k, :, 2] = 0.3
                gate[k] = np.searchsorted([1, 2, 4, 16, 256], same + other, "right") * 8 + k
            return x.reshape(-1, 3), gate.ravel(), bit.ravel()

        x, gate, bit = inputs(1)
        use = np.tile(weight, 8) > 0
        weights, _, seen, ones = online([(x[use], gate[use], bit[use], np.tile(weight, 8)[use].astype(np.float64))] * 8, np.full((48, 3), 0.3), 48, epochs)
        x, gate, bit = inputs(0)
        p = refined(mixed(x, gate, weights), gate, shares_of(seen, ones))
        lp = np.log10(np.where(bit, p, 1 - p)).reshape(8, -1).sum(axis=0)[where]
        # An end has one byte.
        out += np.where((symbol is two) & (one == END_BYTE), 0.0, lp)
    return out


# --------------------------------------------------------------------------------------- whole texts


def _packed(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Word scores as one row for each part that they go to."""
    held, rows = [], 0

    def parts() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        part = table.column("part").to_numpy()
        order = np.argsort(part, kind="stable")
        name, first = np.unique(part[order], return_index=True)
        columns = [table.column(c).to_numpy().astype(t)[order] for c, t in PACKED]
        blobs = [b"".join(c[lo:hi].tobytes() for c in columns) for lo, hi in zip(first, [*first[1:], len(order)])]
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(blobs, pa.binary())], ["part", "blob"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            yield parts()
            held, rows = [], 0
    if rows:
        yield parts()


def _texts(texts: pa.Table, answers: pa.Table, heads, total: int, distinct: int) -> pa.Table:
    """Scores of a part's texts from those of its words."""
    if not texts.num_rows:
        return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("coded_bytes", pa.int64()))})
    width = sum(np.dtype(t).itemsize for _, t in PACKED)
    parts = []
    for blob in answers.column("blob").to_pylist():
        n, lo, columns = len(blob) // width, 0, []
        for _, t in PACKED:
            columns.append(np.frombuffer(blob, dtype=t, count=n, offset=lo))
            lo += columns[-1].nbytes
        parts.append(columns)
    idx, *values = (np.concatenate(x) for x in zip(*parts))
    count, tail, code, length = (np.zeros(len(idx), dtype=v.dtype) for v in values)
    for x, v in zip((count, tail, code, length), values):
        x[idx] = v
    code, length = code.astype(np.int64), length.astype(np.int64)
    at = long_numbers(np.frombuffer(b"".join(texts.column("ids").to_pylist()), dtype=np.uint8))
    first = np.cumsum(texts.column("n_tokens").to_numpy()) - texts.column("n_tokens").to_numpy()
    before = np.zeros(len(at), dtype=np.int64)
    before[1:] = code[at[:-1]] >> 16
    before[first] = 0
    codes, lp = heads.value
    head = lp[np.searchsorted(codes, before << 16 | code[at] & 0xFFFF)]
    each = lambda x: np.add.reduceat(x, first)
    base = np.log10((count + 1) / (total + distinct + 1))
    return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": texts.column("n_tokens"), "n_known": each((count > 0).astype(np.int64)[at]), "base_score": each(base[at]), "score": each(tail[at] + head), "coded_bytes": each(length[at] + 1)})


def blocks_of(words: DataFrame, block_words: int) -> DataFrame:
    """words (word, n) with block, and begins: the length in bytes of the beginning by which the word was dealt."""
    raw = F.col("word").cast("binary")
    named = words.where("word <> ''").withColumn("two", F.substring(raw, 1, 2)).withColumn("six", F.substring(raw, 1, 6))
    counts = stash(named.groupBy("two", "six").agg(F.count(F.lit(1)).alias("m")), "beginnings")
    many = counts.groupBy("two").agg(F.sum("m").alias("m")).where(F.col("m") > block_words).select("two", F.lit(True).alias("hot"))
    more = counts.join(many, "two", "left_semi").where(F.col("m") > block_words).select("six", F.lit(True).alias("hotter"))
    dealt = named.join(many, "two", "left").join(more, "six", "left")
    blocks = max(1, -(-(words.count()) // block_words))
    key = F.when(F.col("hotter"), F.xxhash64("word")).when(F.col("hot"), F.xxhash64("six")).otherwise(F.xxhash64("two"))
    begins = F.when(F.col("hotter"), DEPTH).when(F.col("hot"), 6).otherwise(2)
    return stash(dealt.select("word", "n", begins.cast("long").alias("begins"), F.pmod(key, F.lit(blocks)).alias("block")), "word-blocks")


def known_nodes(dealt: DataFrame) -> DataFrame:
    """dealt (word, n, begins, block) so that the whole-word predictor starts after BEGIN bytes for every word, however
    it was dealt.  Words of a beginning that several blocks share get known: of each byte from there on, how often
    the word so far was followed by each beginning, of 0 to 8 bits, of that byte, over all blocks."""
    hotter = F.col("begins") == DEPTH
    if not dealt.where(hotter).limit(1).count():
        return dealt.withColumn("begins", F.lit(BEGIN).cast("long"))
    at = F.explode(F.sequence(F.lit(BEGIN), F.least(F.octet_length("word"), F.lit(DEPTH - 1)))).alias("p")
    byte = F.conv(F.hex(F.expr("substring(cast(word as binary), p + 1, 1)")), 16, 10).cast("int")
    edges = dealt.where(hotter).where(F.octet_length("word") >= BEGIN).select("word", "n", at).select("word", "n", "p", F.expr("substring(cast(word as binary), 1, p)").alias("prefix"), F.coalesce(byte, F.lit(SPACE_BYTE)).alias("symbol"))
    # At most 256 symbols follow a prefix.
    follow = edges.groupBy("prefix", "symbol").agg(F.sum("n").alias("n")).groupBy("prefix").agg(F.collect_list(F.struct("symbol", "n")).alias("all"))
    total = lambda k: F.aggregate(F.filter("all", lambda x: F.shiftright(x["symbol"], 8 - k) == F.shiftright(F.col("symbol"), 8 - k)), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    nodes = edges.join(follow, "prefix").select("word", F.struct("p", F.array(*[total(k) for k in range(9)]).alias("nodes")).alias("node"))
    known = nodes.groupBy("word").agg(F.flatten(F.transform(F.array_sort(F.collect_list("node")), lambda x: x["nodes"])).alias("known"))
    return stash(dealt.join(known, "word", "left").withColumn("begins", F.lit(BEGIN).cast("long")), "known-nodes")


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2, classes: int = 512, slot_bits: int = 22, block_words: int = 50_000, epochs: int = 3, part_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out (crc32 of doc_id as text modulo folds is `held`;
    those are not learned from), n_tokens, n_known, train_tokens, base_score (add-one unigram over words and
    ends, log10), score (log10 probability by the model), bits_per_byte (of the coded words)."""
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    learned = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(False))
    encoded = stash(docs.select(doc_id.alias("doc_id"), learned.alias("learned"), "text").mapInArrow(partial(_encoded, classes=classes, part_bytes=part_bytes), ENCODED), "encoded")
    held_words = encoded.where("word is not null")
    words = stash(held_words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pairs = encoded.where("word is null and code is not null").groupBy("code").agg(F.sum("n").alias("n")).toArrow().sort_by("code")
    codes = pairs.column("code").to_numpy().astype(np.int64)
    heads = spark.sparkContext.broadcast((codes, first_bytes(codes, pairs.column("n").to_numpy(), epochs)))
    dealt = blocks_of(words, block_words)
    block = known_nodes(dealt).groupBy("block")
    context = block.applyInArrow(lambda words: _contexts(words), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    filled = context.mapInArrow(partial(_slots, slot_bits=slot_bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(2 << slot_bits, dtype=np.float32)
    table[filled.column("slot").to_numpy()] = filled.column("n").to_numpy()
    table = spark.sparkContext.broadcast(table.reshape(-1, 2))
    cells = block.applyInArrow(lambda words: _learned(words, table, epochs), "cell long, part double, whole double").groupBy("cell").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole")).toArrow()
    part, whole = np.zeros(GATES * INPUTS + GATES // 8 * STEPS), np.zeros(GATES * INPUTS + GATES // 8 * STEPS)
    part[cells.column("cell").to_numpy()], whole[cells.column("cell").to_numpy()] = cells.column("part").to_numpy(), cells.column("whole").to_numpy()
    cut = GATES * INPUTS
    # Rounded, as sums of doubles depend on their order.
    weights = np.round(np.where(whole[:cut] > 0, part[:cut] / np.maximum(whole[:cut], 1), 0.3).reshape(GATES, INPUTS), 6)
    shares = np.round(shares_of(whole[cut:], part[cut:]), 9)
    scored = block.applyInArrow(lambda words: _scored(words, table, weights, shares, classes), "word string, n long, code int, tail double")
    scored = scored.unionByName(words.where("word = ''").select("word", "n", F.lit(END_BYTE << 8).alias("code"), F.lit(0.0).alias("tail")))
    scored = stash(scored.select("word", F.col("n").alias("c"), "tail", "code", F.octet_length("word").alias("bytes")), "word-scores")
    # A word's number and its part as one column: these rows are most of what is shuffled.
    asked = held_words.select("word", (F.shiftleft("part", 24) + F.col("idx")).alias("place"))
    answers = asked.join(scored, "word").select(F.shiftright("place", 24).alias("part"), F.col("place").bitwiseAND((1 << 24) - 1).cast("int").alias("idx"), "c", "tail", "code", "bytes")
    answers = answers.mapInArrow(_packed, "part long, blob binary")
    texts = encoded.where("ids is not null").select("part", "doc_id", "held_out", "n_tokens", "ids")
    found = texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda rows, scores: _texts(rows, scores, heads, total, distinct), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, coded_bytes long")
    found = stash(found, "text-scores")
    release(encoded, words, dealt, scored)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("coded_bytes")).alias("bits_per_byte"))
