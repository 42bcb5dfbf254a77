"""License scans: exact set-similarity join of text blocks with license templates, all in DataFrame
functions.  A block is a line of the text, or any run of as many words as the template has, over
line ends, so that wrapped notices are found.

Tokens that occur in templates are counted over the whole corpus and ranked, rare ones first.  A
block that holds at least `threshold` of a template's tokens must share a token of the template's
prefix in that order, so blocks are joined on prefix tokens alone; the length and the positional
filter drop most of what meets, and the rest is verified on the full sets.  Runs that lie within one
line add nothing to it, so only prefix tokens with template tokens of other lines near by are joined.
Templates are a fixed, small table.

Cases: a null text is empty; a text without words has n_words 0, nulls for first_word and last_word,
empty labels and score 0; rows are judged one by one, so repeated rows and null or repeated doc_ids each
give their own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stash

# Base phrases with their labels, and the templates: label, text, and, where the label
# rests on one word, that word and the label of blocks without it.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3", None, None),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", None, None),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", None, None),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser", "gpl"),
    ("agpl", "licensed under the gnu affero general public license version 3", "affero", "gpl"),
    ("apache", "licensed under the apache license version 2 0", None, None),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", None, None),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", None, None),
    ("cc-by", "licensed under cc by 4 0", None, None),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc", "cc-by"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa", "cc-by"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", None, None),
    ("mit", "released under the mit license", None, None),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", None, None),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", None, None),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", None, None),
    ("bsd", "redistribution and use in source and binary forms", None, None),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", None, None),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", None, None),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", None, None),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", None, None),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", None, None),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", None, None),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", None, None),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization", "mit"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", None, None),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", None, None),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", None, None),
    ("public-domain", "this is free and unencumbered software released into the public domain", None, None),
    ("public-domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", None, None),
    ("gpl", "spdx license identifier gpl", None, None),
    ("lgpl", "spdx license identifier lgpl", None, None),
    ("agpl", "spdx license identifier agpl", None, None),
    ("apache", "spdx license identifier apache", None, None),
    ("mit", "spdx license identifier mit", None, None),
    ("bsd", "spdx license identifier bsd", None, None),
    ("isc", "spdx license identifier isc", None, None),
    ("mpl", "spdx license identifier mpl", None, None),
    ("public-domain", "spdx license identifier unlicense", None, None),
)
THRESHOLD = 0.8
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return F.filter(F.split(text, BETWEEN), lambda w: w != F.lit(""))


def _phrase_starts(w: Column, phrase: str) -> Column:
    """Positions in w at which all words of the phrase stand in a row."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for k, part in enumerate(parts):
            ok = ok & F.coalesce(F.get(w, i + k) == part, F.lit(False))
        return ok

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def token_ranks(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Rank of each template token by its count over all words of docs, rare ones first; as many
    rows reach the driver as templates have tokens."""
    vocabulary = sorted({w for _, t, _, _ in templates for w in t.split()})
    seen = docs.select(F.explode(F.filter(tokens(ascii_lower(F.col("text"))), lambda w: w.isin(vocabulary))).alias("token")).groupBy("token").count()
    counts = {r.token: r["count"] for r in seen.collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def prefixes(ranks: dict[str, int], threshold: float, templates=TEMPLATES) -> list[tuple]:
    """(template, label, ranks of its tokens, least overlap, prefix token, its position, the word that the
    label needs, the label without it, its length in words): a row for each token of each template's
    prefix."""
    out = []
    for n, (label, text, word, without) in enumerate(templates):
        own = sorted({ranks[w] for w in text.split()})
        need = math.ceil(threshold * len(own) - 1e-9)
        out += [(n, label, own, need, own[j], j, ranks.get(word), without, len(text.split())) for j in range(len(own) - need + 1)]
    return out


def match_blocks(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """blocks (row, block: ascending ranks of its template tokens) joined with the prefix index:
    row, label, share for every block and template that meet the threshold."""
    met = blocks.select("row", "block", F.posexplode("block").alias("i", "token")).join(F.broadcast(index), "token")
    later = F.lit(1) + F.least(F.size("own") - F.col("j") - 1, F.size("block") - F.col("i") - 1) + F.least("i", "j")
    held = F.col("word").isNull() | F.array_contains("block", F.col("word"))
    met = met.where((F.size("block") >= F.col("need")) & (later >= F.col("need")))
    share = F.size(F.array_intersect("block", "own"))
    return met.withColumn("common", share).where(F.col("common") >= F.col("need")).select("row", F.when(held, F.col("label")).otherwise(F.col("without")).alias("label"), (F.col("common") / F.size("own")).alias("share"))


def near_leads(known: Column, leads: list[int], reach: int, least: int) -> Column:
    """known: template tokens of a text (at, line, r) by at.  For each prefix token among them (token,
    near: the known ones less than `reach` words away, by offset), where near has `least` tokens and
    more than one line."""

    def here(x: Column, k: Column) -> Column:
        around = F.filter(F.slice(known, F.greatest(k - reach + 2, F.lit(1)), F.lit(2 * reach - 1)), lambda y: F.abs(y["at"] - x["at"]) < reach)
        near = F.when(x["r"].isin(leads), F.transform(around, lambda y: F.struct((y["at"] - x["at"]).alias("at"), (y["line"] - x["line"]).alias("line"), y["r"].alias("r"))))
        return F.struct(x["r"].alias("token"), near.alias("near"))

    def tells(x: Column) -> Column:
        return x["near"].isNotNull() & F.exists(x["near"], lambda y: y["line"] != 0) & (F.size(F.array_distinct(x["near"]["r"])) >= least)

    return F.array_distinct(F.filter(F.transform(known, here), tells))


def match_runs(leads: DataFrame, index: DataFrame) -> DataFrame:
    """leads (row, token, near) joined with the prefix index: row, label, share for the best run
    of the template's length around the token, where it meets the threshold."""
    met = leads.join(F.broadcast(index), "token").withColumn("near", F.filter("near", lambda x: (F.abs(x["at"]) < F.col("words")) & F.array_contains(F.col("own"), x["r"])))
    met = met.where(F.size(F.array_distinct(F.col("near.r"))) >= F.col("need"))

    def run(first: Column) -> Column:
        return F.array_distinct(F.transform(F.filter("near", lambda x: (x["at"] >= first["at"]) & (x["at"] < first["at"] + F.col("words"))), lambda x: x["r"]))

    # Runs that hold the word that the label rests on, and runs without it, which have the other label.
    held = lambda r: F.col("word").isNull() | F.array_contains(r, F.col("word"))
    best = lambda runs: F.array_max(F.transform(runs, lambda r: F.size(r)))
    met = met.withColumn("runs", F.transform(F.filter("near", lambda x: x["at"] <= 0), run))
    ways = F.array(F.struct("label", best(F.filter("runs", held)).alias("common")), F.struct(F.col("without").alias("label"), best(F.filter("runs", lambda r: ~held(r))).alias("common")))
    met = met.select("row", "need", "own", F.explode(ways).alias("way"))
    return met.where(F.col("way.common") >= F.col("need")).select("row", "way.label", (F.col("way.common") / F.size("own")).alias("share"))


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    ranks = token_ranks(docs, templates)
    rows = prefixes(ranks, threshold, templates)
    index = docs.sparkSession.createDataFrame(rows, "template int, label string, own array<int>, need int, token int, j int, word int, without string, words int")
    leads = sorted({r[4] for r in rows})
    by_rank = sorted(ranks, key=ranks.get)
    rank = F.create_map(*[x for w, r in ranks.items() for x in (F.lit(w), F.lit(r))])
    lead_words = F.array(*[F.lit(by_rank[r]) for r in leads])
    least = min(r[3] for r in rows)
    step = docs.select(F.col("doc_id").cast("long"), ascii_lower(F.col("text")).alias("text"))
    step = step.select("doc_id", "text", tokens(F.col("text")).alias("w"))
    some = F.array_contains("w", "license") | F.array_contains("w", "cc")
    none = F.array().cast("array<struct<at:int,label:string>>")
    places = F.when(some, F.concat(*[_labelled(_phrase_starts(F.col("w"), p), label) for p, label in PHRASES])).otherwise(none)

    def block(line: Column) -> Column:
        known = F.filter(F.array_distinct(tokens(line)), lambda w: w.isin(by_rank))
        return F.sort_array(F.transform(known, lambda w: rank[w]))

    # Lines without a prefix token of some template, or with too few template tokens, match nothing.
    lines = F.filter(F.split("text", "\n"), lambda x: F.arrays_overlap(tokens(x), lead_words))
    blocks = F.when(F.arrays_overlap("w", lead_words), F.filter(F.transform(lines, block), lambda b: F.size(b) >= least)).otherwise(F.array().cast("array<array<int>>"))
    # The template tokens of texts of several lines, with their place among the words and their line.
    worded = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(tokens(x), lambda w: F.struct(i.alias("line"), w.alias("w")))))
    placed = F.filter(F.transform(worded, lambda x, i: F.struct(i.alias("at"), x["line"].alias("line"), x["w"].alias("w"))), lambda x: x["w"].isin(by_rank))
    known = F.transform(placed, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"), rank[x["w"]].alias("r")))
    known = F.when(F.arrays_overlap("w", lead_words) & F.contains("text", F.lit("\n")), known).otherwise(F.array().cast("array<struct<at:int,line:int,r:int>>"))
    step = step.select("doc_id", F.size("w").cast("long").alias("n_words"), places.alias("places"), F.array_distinct(blocks).alias("blocks"), known.alias("known"))
    near = near_leads(F.col("known"), leads, max(r[8] for r in rows), least)
    # Rows are numbered as they are written, so the numbers stay.
    found = stash(step.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "places", "blocks", near.alias("leads")), "license-blocks")
    hits = match_blocks(found.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("block")), index)
    hits = hits.unionByName(match_runs(found.where(F.size("leads") > 0).select("row", F.inline("leads")), index))
    hits = hits.groupBy("row").agg(F.collect_set("label").alias("added"), F.max("share").alias("share"))
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    added = F.coalesce("added", F.array().cast("array<string>"))
    n = F.size("places")
    return found.join(hits, "row", "left").select(
        "doc_id", "n_words", n.cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["at"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, added))), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
