"""Quality rules: a learned decision list over text statistics, all in DataFrame functions.

Sequential covering learns from labelled statistics: each rule is a conjunction of threshold tests,
grown by FOIL gain on one part of the labelled rows and pruned on the other, and what it covers is
taken out before the next.  The counts come from one small aggregation per step over binned
statistics; only those counts (features x bins x classes) reach the driver.  The list becomes an
ordered CASE expression, so applying it is a projection over the scan, without any shuffle.

Cases: a null text is empty; a text without words has zero statistics and fails the base rule;
labels that are null or without a document are not learned from; without labels of both classes the
list is empty and only the base rule decides; repeated rows are judged one by one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, stash, words

# Fixed values of the base rule.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = "[#*$%&|<>]"

#: Statistics that tests may use, from the counts below.
FEATURES = {
    "symbols_a_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "marks_a_word": lambda: F.col("n_marks") / F.greatest("n_words", F.lit(1)),
    "capitals_a_char": lambda: F.col("n_capitals") / F.greatest("word_chars", F.lit(1)),
    "repeated_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "distinct_share": lambda: F.col("n_distinct") / F.greatest("n_words", F.lit(1)),
    "dup_lines_a_line": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "chars_a_word": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "n_words": lambda: F.col("n_words").cast("double"),
}


def repeated_words(hashes: Column) -> Column:
    """Words in WINDOW-word windows that occur twice or more, from the array of word hashes."""
    n = F.size(hashes)
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.when(i < F.size(starts) - 1, F.least(F.lit(WINDOW), starts[i + 1] - p)).otherwise(F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        found = F.filter(F.transform(s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["p"])), lambda p: p.isNotNull())
        return let(F.sort_array(found), covered)

    def count(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, twice))

    return let(windows, count).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, text) with keep and the counts of each text; one pass over the words."""
    text = F.coalesce("text", F.lit(""))
    step = docs.select("doc_id", *keep, text.alias("text"), words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return step.select(
        "doc_id", *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("h")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


class DecisionList:
    """Ordered rules; a rule is a list of tests (feature, '<=' or '>', threshold).  A row that meets
    all tests of some rule is rejected."""

    def __init__(self, rules: list[list[tuple[str, str, float]]]):
        self.rules = rules

    def rejects(self) -> Column:
        """CASE in the order of the rules; false if none holds."""
        case = None
        for tests in self.rules:
            holds = F.lit(True)
            for name, sign, at in tests:
                holds = holds & (FEATURES[name]() <= at if sign == "<=" else FEATURES[name]() > at)
            case = F.when(holds, F.lit(True)) if case is None else case.when(holds, F.lit(True))
        return F.lit(False) if case is None else case.otherwise(F.lit(False))


def _bin(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below value."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in cuts]).cast("array<double>"), lambda t: value > t))


def _counts(rows: DataFrame, tests: list[tuple[int, str, int]]) -> dict[tuple[int, int, bool], tuple[int, int]]:
    """{(feature, bin, in growing part): (rejected, kept)} of the rows that meet the tests."""
    for f, sign, b in tests:
        rows = rows.where(F.col("bins")[f] <= b if sign == "<=" else F.col("bins")[f] > b)
    rows = rows.groupBy("bins", "grow").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    found = rows.select("grow", "bad", "good", F.posexplode("bins").alias("f", "b")).groupBy("f", "b", "grow").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    return {(r.f, r.b, r.grow): (int(r.bad), int(r.good)) for r in found}


def _part(counts: dict, grow: bool) -> tuple[int, int]:
    """(rejected, kept) over all rows of one part: any one feature holds them all."""
    own = [v for (f, _, g), v in counts.items() if f == 0 and g is grow]
    return sum(v[0] for v in own), sum(v[1] for v in own)


def learn(labelled: DataFrame, bins: int = 24, most_rules: int = 8, most_tests: int = 3, least_rows: int = 4, least_precision: float = 0.9) -> DecisionList:
    """Decision list from labelled statistics (columns of `statistics` and bad 0/1)."""
    names = list(FEATURES)
    rows = labelled.select("bad", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"), *[FEATURES[x]().alias(x + "_") for x in names])
    at = [i / bins for i in range(1, bins)]
    # Thresholds per class, so that a rare class has thresholds where it lies.
    cuts: list[set[float]] = [set() for _ in names]
    for r in rows.groupBy("bad").agg(*[F.percentile_approx(x + "_", at, 10000).alias(x) for x in names]).collect():
        for i, x in enumerate(names):
            cuts[i] |= set(r[x] or ())
    cut = [sorted(c) for c in cuts]
    index = [_bin(F.col(x + "_"), cut[i]) for i, x in enumerate(names)]
    rows = stash(rows.select("bad", "grow", F.array(*index).alias("bins")), "quality-bins")
    rules: list[list[tuple[int, str, int]]] = []
    left = rows
    for _ in range(most_rules):
        tests: list[tuple[int, str, int]] = []
        counts = _counts(left, tests)
        p, n = _part(counts, True)
        trail = []
        while p and n and len(tests) < most_tests:
            best, gain = None, 1e-9
            for f in range(len(names)):
                own = {b: counts.get((f, b, True), (0, 0)) for b in range(len(cut[f]) + 1)}
                below = [0, 0]
                for b in range(len(cut[f])):
                    below = [below[0] + own[b][0], below[1] + own[b][1]]
                    for sign, (q, m) in (("<=", below), (">", [p - below[0], n - below[1]])):
                        if q >= least_rows and (g := q * (math.log2(q / (q + m)) - math.log2(p / (p + n)))) > gain:
                            best, gain = (f, sign, b), g
            if best is None:
                break
            tests = [*tests, best]
            counts = _counts(left, tests)
            p, n = _part(counts, True)
            trail.append((tests, (p, n), _part(counts, False)))
        # Prune to the shortest conjunction of the highest worth on the other part.
        worth = lambda x: ((x[2][0] + 1) / (x[2][0] + x[2][1] + 2) if sum(x[2]) else 0, -len(x[0]))
        if not trail:
            break
        tests, (gp, gn), (pp, pn) = max(trail, key=worth)
        if gp + pp < least_rows or (gp + pp) < least_precision * (gp + gn + pp + pn):
            break
        rules.append(tests)
        covered = F.lit(True)
        for f, sign, b in tests:
            covered = covered & (F.col("bins")[f] <= b if sign == "<=" else F.col("bins")[f] > b)
        left = left.where(~covered)
    # Thresholds lie halfway to the next value above, so that rows as near to either side fare alike.
    used = sorted({(f, b) for r in rules for f, _, b in r})
    value = lambda f: FEATURES[names[f]]()
    above = labelled.agg(*[F.min(F.when(value(f) > cut[f][b], value(f))) for f, b in used]).first() if used else []
    at = {x: (cut[x[0]][x[1]] + (up if up is not None else cut[x[0]][x[1]])) / 2 for x, up in zip(used, above)}
    return DecisionList([[(names[f], sign, float(at[f, b])) for f, sign, b in r] for r in rules])


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """Statistics and bad (1: quality 0) of at most most_labels labelled documents: the bound of the
    sample on which the list is fitted, and so of what is broadcast."""
    some = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    picked = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id", (1 - F.col("quality")).cast("int").alias("bad"))), "doc_id")
    return stash(statistics(picked, "bad"), "quality-labelled")


def judge(docs: DataFrame, rules: DecisionList, *keep: str) -> DataFrame:
    """Per row of docs: doc_id, keep, the counts, base_failed and kept."""
    return statistics(docs, *keep).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~rules.rejects()))
