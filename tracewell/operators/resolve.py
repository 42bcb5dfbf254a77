"""Entity resolution (R7-R9, R16, R17): alias index, exact and fuzzy joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.columns import fold_accents, mention_forms
from tracewell.operators.rows import kept
from tracewell.params import KNOBS


def alias_index(entities: DataFrame, fold=fold_accents) -> DataFrame:
    """entities (entity_id, name, aliases) as form, entity_id, digit: one row per form and owner."""
    names = entities.select("entity_id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    forms = names.select("entity_id", F.explode(mention_forms(F.col("alias"), fold)).alias("form")).distinct()
    return forms.withColumn("digit", F.col("form").rlike("[0-9]"))


def ambiguous_aliases(index: DataFrame) -> DataFrame:
    """Forms with more than one owner, with their number."""
    return index.groupBy("form").agg(F.countDistinct("entity_id").alias("owners")).where("owners > 1")


def exact_resolve(mentions: DataFrame, index: DataFrame, fold=fold_accents) -> DataFrame:
    """mentions (mention_id, mention) with entity_id, method ('exact' or 'none') and owners: the first
    form with one owner wins; a form with several decides nothing, unless it is the last, whose owners
    then are counted."""
    owners = index.groupBy("form").agg(F.countDistinct("entity_id").alias("n"), F.min("entity_id").alias("owner"))
    forms = mentions.select("mention_id", F.posexplode_outer(mention_forms(F.col("mention"), fold)).alias("at", "form"))
    last = F.max("at").over(Window.partitionBy("mention_id"))
    seen = forms.withColumn("last", last).join(owners, "form", "left")
    first = F.min(F.when(F.col("n") == 1, F.struct("at", "owner")))["owner"]
    stuck = F.max(F.when((F.col("n") > 1) & (F.col("at") == F.col("last")), F.col("n")))
    found = seen.groupBy("mention_id").agg(first.alias("entity_id"), F.coalesce(stuck, F.lit(0)).alias("owners"))
    method = F.when(F.col("entity_id").isNotNull(), "exact").otherwise("none")
    count = F.when(F.col("entity_id").isNotNull(), F.lit(1)).otherwise(F.col("owners"))
    return mentions.join(found, "mention_id").select("mention_id", "mention", "entity_id", method.alias("method"), count.cast("long").alias("owners"))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit vector step for each character of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * common subsequence / total length of the two texts with words in order."""
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b)):
        x, y = " ".join(sorted((x or "").split())), " ".join(sorted((y or "").split()))
        total = len(x) + len(y)
        out[i] = 100.0 * 2 * _common(x, y) / total if total else 100.0
    return pd.Series(out)


def _grams(text: Column) -> Column:
    """Distinct neighbouring letters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def fuzzy_resolve(mentions: DataFrame, index: DataFrame, accept: float = KNOBS.fuzzy_accept, margin: float = KNOBS.fuzzy_margin, fold=fold_accents) -> DataFrame:
    """mentions (mention_id, mention) with entity_id and confidence: the best entity by sorted_ratio of
    the last form, if it reaches accept and beats every other by margin; null else.

    Blocking keeps every pair that can matter, those of accept - margin or more.  Such a ratio bounds the
    lengths, and how many pairs of neighbouring letters a form, its words in order, can lose: a letter
    left out breaks two, one put in breaks one.  So one of its rarest pairs, one more than it can lose,
    stands in the alias, and forms are joined on these alone."""
    floor = accept - margin
    share = floor / 100
    loss = max(2 / (2 - share), 1 / share) * 2 * (1 - share)
    last = mentions.withColumn("forms", mention_forms(F.col("mention"), fold)).select("mention_id", F.when(F.size("forms") > 0, F.element_at("forms", -1)).alias("form")).where("form is not null")
    grams = lambda form: _grams(F.array_join(F.array_sort(F.split(form, " ")), " "))
    pool = index.where("not digit").select("entity_id", F.col("form").alias("alias"))
    right = pool.withColumn("gram", F.explode(grams(F.col("alias"))))
    seen = right.groupBy("gram").agg(F.count(F.lit(1)).alias("seen"))
    left = last.withColumn("gram", F.explode(grams(F.col("form")))).join(seen, "gram", "left")
    rarest = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.coalesce("seen", F.lit(0)), "gram"))
    left = left.withColumn("rarest", rarest).where(F.col("rarest") <= F.floor(loss * F.length("form") + 1e-9) + 1).drop("seen", "rarest")
    a, b = F.length("form"), F.length("alias")
    pairs = left.join(right, "gram").where(200 * F.least(a, b) >= floor * (a + b)).select("mention_id", "entity_id", "form", "alias").distinct()
    scored = pairs.withColumn("score", sorted_ratio("form", "alias")).groupBy("mention_id", "entity_id").agg(F.max("score").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id"))).where("rank <= 2")
    top = ranked.groupBy("mention_id").agg(F.max(F.when(F.col("rank") == 1, F.col("entity_id"))).alias("entity_id"), F.max("score").alias("best"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    sure = (F.col("best") >= accept) & (F.col("best") - F.col("second") >= margin)
    out = mentions.join(top, "mention_id", "left")
    return out.select("mention_id", "mention", F.when(sure, F.col("entity_id")).alias("entity_id"), F.when(sure, F.round(F.col("best") / 100, 4)).alias("confidence"))


class _Aliases:
    """A block of texts, letters as numbers, for scoring one text against all at once."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        self.letters, flat = np.unique(codes, return_inverse=True)
        self.size, self.texts = size, texts
        row = np.repeat(np.arange(len(texts)), size)
        # Beyond its end a text has a letter that no other has.
        self.grid = np.full((len(texts), int(size.max(initial=0))), len(self.letters), dtype=np.int64)
        self.grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        self.counts = np.zeros((len(texts), len(self.letters) + 1), dtype=np.int16)
        np.add.at(self.counts, (row, flat), 1)

    def number(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        return np.where(self.letters[at] == codes, at, -1) if len(self.letters) else np.full(len(codes), -1)

    def bounds(self, text: str) -> np.ndarray:
        """No text scores more: a common subsequence has no letter more often than either text."""
        own = self.number(text)
        count = np.bincount(own[own >= 0], minlength=self.counts.shape[1]).astype(np.int16)
        return 100.0 * 2 * np.minimum(self.counts, count).sum(axis=1, dtype=np.int64) / (self.size + len(text))

    def scores(self, text: str, rows: np.ndarray) -> np.ndarray:
        """100 * 2 * common subsequence / total length: a bit vector per row, one step for each letter of the rows."""
        if len(text) > 63:
            common = np.array([_common(text, self.texts[i]) for i in rows], dtype=np.int64)
        else:
            masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
            for i, c in enumerate(self.number(text)):
                if c >= 0:
                    masks[c] |= np.uint64(1 << i)
            full = np.uint64((1 << len(text)) - 1)
            line = np.full(len(rows), full)
            for letters in self.grid[rows].T:
                hit = line & masks[letters]
                line = (line + hit | line - hit) & full
            common = len(text) - np.bitwise_count(line).astype(np.int64)
        return 100.0 * 2 * common / (self.size[rows] + len(text))


def _best(block: pa.Table, asked: pa.Table, k: int, at_first: int = 64) -> pa.Table:
    """For each form the k entities of the block that score best, then those of the smallest entity_id.  Aliases are
    scored in the order of their bounds until no bound reaches the kth score."""
    out: list[tuple] = []
    if block.num_rows and asked.num_rows:
        owner = block.column("entity_id").to_numpy()
        aliases = _Aliases(block.column("alias").to_pylist())
        for form, least in zip(asked.column("form").to_pylist(), asked.column("least").to_pylist()):
            bound = aliases.bounds(form)
            best: dict[int, float] = {}
            rows = np.argsort(-bound, kind="stable")
            rows = rows[bound[rows] >= least]
            for part in (rows[:at_first], rows[at_first:]):
                if len(best) >= k:
                    part = part[bound[part] >= sorted(best.values())[-k]]
                for e, s in zip(owner[part].tolist(), aliases.scores(form, part).tolist()):
                    best[e] = max(best.get(e, -1.0), s)
            out += [(form, e, s) for e, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return pa.table({"form": pa.array([x[0] for x in out], pa.string()), "entity_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})


def fuzzy_candidates(mentions: DataFrame, index: DataFrame, folder: str, most: int = KNOBS.candidates, fold=fold_accents, block: int = 4096) -> DataFrame:
    """For mentions (mention_id, mention) that resolve to nothing, the best entities of all by sorted_ratio, the least
    entity_id first among equals, `most` each, for review: mention_id, entity_id, score (R9, R15).

    Aliases are dealt to blocks by length.  A form is first scored in the blocks of its own length; the score
    that its last candidate has there bounds the lengths that can do better, and it meets only blocks that
    hold such lengths.  Blocks and chunks of forms meet in tasks of bounded size; of a block a form takes the
    best entities on, so what is left to rank is few rows a form."""
    order = lambda form: F.array_join(F.array_sort(F.split(form, " ")), " ")
    last = mentions.withColumn("forms", mention_forms(F.col("mention"), fold)).where(F.size("forms") > 0).select("mention_id", order(F.element_at("forms", -1)).alias("form"))
    last = kept(last, folder, "forms")
    forms = last.select("form").distinct().withColumn("size", F.length("form"))
    pool = index.where("not digit").select(F.col("entity_id").cast("long").alias("entity_id"), order(F.col("form")).alias("alias")).distinct().withColumn("size", F.length("alias"))
    n, m = pool.count(), forms.count()
    dealt = pool.repartitionByRange(max(1, -(-n // block)), "size", F.xxhash64("alias"), "entity_id").withColumn("block", F.spark_partition_id())
    dealt = kept(dealt, folder, "aliases")
    forms = kept(forms.withColumn("chunk", F.pmod(F.xxhash64("form"), F.lit(max(1, -(-m // block))))), folder, "asked")
    sizes = kept(dealt.select("size", "block").distinct(), folder, "sizes")

    def searched(asked: DataFrame) -> DataFrame:
        pairs = asked.select("block", "chunk").distinct()
        right = asked.select(F.col("block").alias("block"), F.col("chunk").alias("chunk"), F.col("form").alias("form"), F.col("least").alias("least"))
        both = dealt.join(pairs, "block").groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
        return both.applyInArrow(lambda a, b: _best(a, b, most), "form string, entity_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        best = found.groupBy("form", "entity_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("score"), "entity_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= most)

    near = kept(searched(forms.join(sizes, "size").select("form", "chunk", "block", F.lit(0.0).alias("least"))), folder, "near")
    known = ranked(near).groupBy("form").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    left = forms.join(known, "form", "left").withColumn("least", F.when(F.col("n") >= most, F.col("least")).otherwise(F.lit(0.0)))
    # 200 * lesser length / both lengths is at least `least`.
    reach = F.when(F.col("least") > 0, F.ceil(F.col("size") * (200 - F.col("least")) / F.col("least")))
    far = left.withColumn("longest", F.lit(sizes.agg(F.max("size")).first()[0] or 0)).withColumn("other", F.explode(F.sequence(F.floor(F.col("size") * F.col("least") / (200 - F.col("least"))), F.greatest(F.floor(F.col("size") * F.col("least") / (200 - F.col("least"))), F.least(F.coalesce(reach, F.col("longest")), F.col("longest")).cast("bigint")))))
    done = forms.join(sizes, "size").select("form", "block")
    meets = far.join(sizes.withColumnRenamed("size", "other"), "other").select("form", "chunk", "block", "least").distinct().join(done, ["form", "block"], "left_anti")
    best = ranked(near.union(searched(meets)))
    return last.join(best, "form").select("mention_id", "entity_id", F.round("score", 4).alias("score"))


def event_refs(refs: DataFrame, heads: DataFrame) -> DataFrame:
    """refs (ref) of the form E12 or 12 with the head that they name, null for unknown ones."""
    number = F.regexp_extract(F.upper(F.trim("ref")), "^E?([0-9]{1,18})$", 1)
    wanted = refs.withColumn("head", F.nullif(number, F.lit("")).cast("bigint"))
    return wanted.join(heads.select("head").distinct().withColumn("known", F.lit(True)), "head", "left").select("ref", F.when(F.col("known"), F.col("head")).alias("head"))


def race_refs(refs: DataFrame, races: DataFrame) -> DataFrame:
    """refs (ref), whole race ids or their starts such as GA or GA-SEN, with the race (race_id, cycle) of the
    newest cycle that they name (R16)."""
    parts = races.select("race_id", "cycle", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("race_id", "-"))), lambda n: F.array_join(F.slice(F.split("race_id", "-"), 1, n), "-"))).alias("key"))
    newest = parts.groupBy("key").agg(F.max(F.struct("cycle", "race_id"))["race_id"].alias("race_id"))
    return refs.join(newest, F.upper(F.trim("ref")) == F.col("key"), "left").select("ref", "race_id")


def entity_refs(refs: DataFrame, entities: DataFrame, fold=fold_accents) -> DataFrame:
    """refs (ref) with the entity (entity_id, canonical_id, name, aliases) that they name by number, by
    canonical id in any case, or by an unambiguous name: ref, entity_id, how (R16)."""
    text = F.lower(F.trim("ref"))
    by_number = refs.join(entities.select(F.col("entity_id").cast("string").alias("key"), F.col("entity_id").alias("a")), text == F.col("key"), "left").drop("key")
    by_id = by_number.join(entities.select(F.lower("canonical_id").alias("key"), F.col("entity_id").alias("b")), text == F.col("key"), "left").drop("key")
    named = exact_resolve(refs.select(F.xxhash64("ref").alias("mention_id"), F.col("ref").alias("mention")).distinct(), alias_index(entities, fold), fold).select(F.col("mention").alias("ref"), F.col("entity_id").alias("c"))
    how = F.when(F.col("a").isNotNull(), "number").when(F.col("b").isNotNull(), "canonical").when(F.col("c").isNotNull(), "name").otherwise("none")
    return by_id.join(named, "ref", "left").select("ref", F.coalesce("a", "b", "c").alias("entity_id"), how.alias("how"))


def topic_matches(words: DataFrame, topics: DataFrame) -> DataFrame:
    """words (word) with the topics (topic: slug of words joined by _) they may mean and how many: the
    exact slug, a whole word of it, or the start of one, four letters at least (R16)."""
    parts = topics.select("topic", F.explode(F.array_union(F.split("topic", "_"), F.array("topic"))).alias("part"))
    keys = parts.withColumn("key", F.explode(F.transform(F.sequence(F.least(F.lit(4), F.length("part")), F.length("part")), lambda n: F.substring(F.col("part"), F.lit(1), n))))
    whole = F.col("key") == F.col("part")
    keys = keys.where(whole | (F.length("key") >= 4)).select("topic", "key").distinct()
    found = words.join(keys, F.lower(F.trim("word")) == keys["key"]).groupBy("word").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return found.select("word", F.size("topics").cast("long").alias("options"), F.array_join("topics", ",").alias("topics"), F.when(F.size("topics") == 1, "resolved").otherwise("ambiguous").alias("status"))
