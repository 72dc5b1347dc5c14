"""Licence scans: normalised passages compared with licence templates by Dice coefficient over word bigrams.

A passage is a line of a document, its whole text, or a window of consecutive words wherever lines and sentences end. Two bounds prune without loss. By size: with a Dice coefficient of at
least t, a passage of n bigrams can only match a template of m if n <= (2 - t) / t * m and the other way round, so at least so
many bigrams are shared. By words: each template has a few words whose bigrams are so many that a passage without any of
these words can't share enough. Documents, then passages without such words leave before any is split. The rest meet the
templates in an equi-join on bigrams, in which the template side is a fixed list of a few kilobytes (its broadcast is bounded
by the library), and only matches go on to an aggregation.

Texts that hold telling words of both of two sets for the templates, or one for the whole licence texts, are stored; all that
follows reads these only.

Windows are found by alignment instead of by trying all: of such a document each place of a template's bigram
counts 200 - t, each other place -t (t in per cent), and one pass over these places gives the windows whose sum reaches t times
the template's bigrams, which is the Dice bound itself (a bigram that the window has already counts nothing). A window that is
mostly lines which match by themselves is left to these. Whole licence texts (BODIES) are compared with windows only.

Defined results: null or empty texts match nothing; a passage of one word has no bigram; lines of a document that are
equal but for case count once; rows that share doc_id and text get the same result; an empty table gives an empty table; ties between
templates go to the first name; other columns pass through unless they carry the name of a result column.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written

THRESHOLD = 80  # per cent
BROADCAST = 1 << 21  # characters of templates up to which their bigrams are broadcast
RESULT = ("licenses", "best_license", "best_dice", "n_passages")

# Common licence notices and short licence texts.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


EVERYDAY = {"always", "another", "around", "because", "become", "before", "between", "change", "during", "either", "except", "follow", "however", "itself", "matter", "others", "person", "provide", "really", "should", "through", "together", "unless", "whether", "within", "without"}


def normalised(text: Column) -> Column:
    """Lower-cased words: runs of letters and digits of any script."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def bigrams(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= 2, F.array_distinct(F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))))


@cache
def bodies() -> dict[str, list[str]]:
    """Whole licence texts by name, one file each beside this module."""
    return {f.stem: [f.read_text()] for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def _spare(n: int, threshold: int) -> int:
    """Of a template's n bigrams, those that a match may lack."""
    least = -(-n * threshold // (200 - threshold))  # bigrams that the smallest match has
    return n - -(-threshold * (least + n) // 200)


def _words_and_pairs(text: str) -> tuple[list[str], set[tuple[str, str]]]:
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return words, {*zip(words, words[1:])}


def telling_words(templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD, numbers: int = 6) -> list[str]:
    """Words of which every passage that matches some template holds at least one; a number counts as that many letters more."""
    found: set[str] = set()
    for text in (t for variants in templates.values() for t in variants):
        words, pairs = _words_and_pairs(text)
        lost: set[tuple[str, str]] = set()
        for w in sorted({*words}, key=lambda w: (w not in found, -len(w) - numbers * w.isdigit(), w)):  # rare ones first: long words and numbers
            if len(lost) <= _spare(len(pairs), threshold):
                lost |= {p for p in pairs if w in p}
                found.add(w)
    return sorted(found)


def telling_stems(texts: list[str], threshold: int = THRESHOLD) -> list[str]:
    """The same for long texts, few by taking the words of most bigrams first, and as parts of words: what holds none of these matches no text. Short and everyday words come last."""
    found: list[str] = []
    for text in sorted(texts, key=len):
        words, pairs = _words_and_pairs(text)
        count = Counter(w for p in pairs for w in {*p})
        lost = {p for p in pairs if any(s in w for s in found for w in p)}
        for w in sorted({*words}, key=lambda w: (len(w) < 6 or w in EVERYDAY, -count[w], w)):
            if len(lost) <= _spare(len(pairs), threshold) and not any(s in w for s in found):
                lost |= {p for p in pairs if w in p[0] or w in p[1]}
                found.append(w)
    return found


def template_table(spark: SparkSession, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(license, variant, n_template, bigram): distinct bigrams of each template."""
    rows = spark.createDataFrame([(k, i, t) for k, v in templates.items() for i, t in enumerate(v)], "license string, variant int, t string")
    rows = rows.select("license", "variant", bigrams(normalised(F.col("t"))).alias("b")).where("b is not null")
    return rows.select("license", "variant", F.size("b").alias("n_template"), F.explode("b").alias("bigram"))


def _sized(table: DataFrame, library: dict[str, list[str]]) -> DataFrame:
    """table, made of library, to be broadcast if the library's texts are small."""
    return F.broadcast(table) if sum(len(t) for texts in library.values() for t in texts) <= BROADCAST else table


def _holds(text: Column, parts: list[str]) -> Column:
    """Whether text holds one of parts anywhere."""
    return F.exists(F.array(*(F.lit(p) for p in parts)), lambda p: F.contains(text, p)) if parts else F.lit(False)


def windows(docs: DataFrame, lines: DataFrame, library: dict[str, list[str]], threshold: int) -> DataFrame:
    """(doc_id, tag, unit, license, dice) of the windows of docs (doc_id, tag, low) that match; of overlapping ones that which shares most. lines: (doc_id, tag, units), hashes of what matches by itself."""
    hit, miss, least = 200 - threshold, threshold, threshold * F.col("n_template")
    table = template_table(docs.sparkSession, library)
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
    words = docs.select("doc_id", "tag", normalised(F.col("low")).alias("w")).where(F.size("w") >= 2)
    key = ["doc_id", "tag", "license", "variant", "n_template"]
    places = words.select("doc_id", "tag", F.posexplode(pairs(F.col("w"))).alias("pos", "bigram")).join(_sized(table, library), "bigram")
    places = places.groupBy(*key, "bigram").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    before = F.concat(F.array(F.lit(-1)), F.slice("at", F.lit(1), F.size("at") - 1))
    steps = F.zip_with("at", before, lambda p, q: F.struct(p.alias("pos"), q.alias("prev")))
    # A match shares at least t / (200 - t) of the template's bigrams.
    runs = places.groupBy(*key).agg(F.count("*").alias("shared"), F.collect_list(steps).alias("steps")).where(hit * F.col("shared") >= least)

    def state(start, last, score, peak, stop, found) -> Column:
        return F.struct(start.alias("start"), last.alias("last"), score.cast("bigint").alias("score"), peak.cast("bigint").alias("peak"), stop.alias("stop"), found.alias("found"))

    def emitted(s: Column) -> Column:
        return F.when(s["peak"] >= least, F.concat(s["found"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))).otherwise(s["found"])

    def step(s: Column, x: Column) -> Column:
        gap = x["pos"] - s["last"] - 1
        left = s["score"] - miss * gap
        # No match spans a gap that costs more than what all of the template's bigrams give above the bound.
        over = (left <= 0) | (miss * gap > (hit - miss) * F.col("n_template")) | ((s["peak"] >= least) & (left < least))
        score = left + F.when(x["prev"] >= s["start"], 0).otherwise(hit)
        on = state(s["start"], x["pos"], score, F.greatest(score, s["peak"]), F.when(score > s["peak"], x["pos"]).otherwise(s["stop"]), s["found"])
        return F.when(over, state(x["pos"], x["pos"], F.lit(hit), F.lit(hit), x["pos"], emitted(s))).otherwise(on)

    none = state(F.lit(0), F.lit(-1), F.lit(0), F.lit(0), F.lit(0), F.array().cast("array<struct<start:int,stop:int>>"))
    spans = runs.select(*key, F.explode(F.aggregate(F.array_sort(F.flatten("steps")), none, step, emitted)).alias("span"))
    grams = table.groupBy("license", "variant").agg(F.collect_list("bigram").alias("own"))
    # Written first: where windows are few, as their size then shows, the texts needn't be shuffled to them.
    spans = written(spans).join(_sized(grams, library), ["license", "variant"]).select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "license", "n_template", "span.start", "span.stop", "own")
    spans = spans.join(docs, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("tag") == F.col("__tag"))).drop("__doc", "__tag")
    lines = lines.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "units")
    spans = spans.join(lines, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("tag") == F.col("__tag")), "left").drop("__doc", "__tag")
    known = lambda text: F.coalesce(F.array_contains("units", F.xxhash64(text)), F.lit(False))
    marked = F.flatten(F.transform(F.split("low", "\n"), lambda x: F.transform(normalised(x), lambda w: F.struct(w.alias("w"), known(x).alias("known")))))
    spans = spans.where(~known(F.col("low"))).withColumn("part", F.slice(marked, F.col("start") + 1, F.col("stop") - F.col("start") + 2))
    spans = spans.where(2 * F.size(F.filter("part", lambda x: x["known"])) <= F.size("part"))
    spans = spans.withColumn("w", F.col("part.w")).withColumn("b", F.array_distinct(pairs(F.col("w"))))
    both = F.size(F.array_intersect("b", "own"))
    spans = spans.select("doc_id", "tag", "license", "start", "stop", F.xxhash64(F.array_join("w", " ")).alias("unit"), both.alias("both"), (2 * both / (F.size("b") + F.col("n_template"))).alias("dice"))
    best = spans.where(F.col("dice") * 100 >= threshold).groupBy("doc_id", "tag").agg(F.array_sort(F.collect_set(F.struct((-F.col("both")).alias("o"), (-F.col("dice")).alias("d"), "license", "start", "stop", "unit"))).alias("all"))
    meets = lambda kept, x: F.exists(kept, lambda y: (y["start"] <= x["stop"]) & (x["start"] <= y["stop"]))
    apart = F.aggregate("all", F.slice("all", 1, 1), lambda kept, x: F.when(meets(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    return best.select("doc_id", "tag", F.explode(apart).alias("x")).select("doc_id", "tag", "x.unit", "x.license", (-F.col("x.d")).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """docs with licenses (of each passage the closest; names, sorted), best_license, best_dice and n_passages (distinct passages that match)."""
    library = {k: [*templates.get(k, []), *bodies().get(k, [])] for k in sorted({*templates, *bodies()})} if templates is TEMPLATES else templates
    table = template_table(docs.sparkSession, templates)
    sizes = table.agg(F.min("n_template"), F.max("n_template")).first()  # two numbers of the library
    least, most = (sizes[0] or 1) * threshold / (200 - threshold), (sizes[1] or 0) * (200 - threshold) / threshold
    telling = telling_words(templates, threshold)
    any_of = lambda c: reduce(lambda x, w: x | F.contains(c, F.lit(w)), telling, F.lit(False))
    # Both columns are a generator's output, so the filters on them don't lower-case the text once a word.
    low = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("tag"), F.explode(F.array(F.lower("text"))).alias("low"))
    # What holds no word of each set of the templates and none of the whole texts can't match. Written once, as lines and, twice, windows read it.
    long = [] if templates is not TEMPLATES else telling_stems([t for texts in bodies().values() for t in texts], threshold)
    low = written(low.where((_holds(F.col("low"), telling) & _holds(F.col("low"), telling_words(templates, threshold, numbers=-20))) | _holds(F.col("low"), long)))
    passages = low.where(any_of(F.col("low"))).select("doc_id", "tag", F.explode(F.array_distinct(F.concat(F.split("low", "\n"), F.array("low")))).alias("passage")).where(any_of(F.col("passage")))
    units = passages.select("doc_id", "tag", F.xxhash64("passage").alias("unit"), normalised(F.col("passage")).alias("w"))
    # Distinct words less one bound the distinct bigrams from below.
    units = units.where((F.size("w") >= 2) & (F.size(F.array_distinct("w")) <= int(most) + 1)).select("doc_id", "tag", "unit", bigrams(F.col("w")).alias("b"))
    units = units.where(F.size("b").between(int(least), int(most))).select("doc_id", "tag", "unit", F.size("b").alias("n_own"), F.explode("b").alias("bigram"))
    hits = units.join(_sized(table, templates), "bigram").groupBy("doc_id", "tag", "unit", "license", "variant", "n_own", "n_template").agg(F.count("*").alias("both"))
    hits = hits.where(200 * F.col("both") >= threshold * (F.col("n_own") + F.col("n_template")))
    hits = written(hits.select("doc_id", "tag", "unit", "license", (2 * F.col("both") / (F.col("n_own") + F.col("n_template"))).alias("dice")))
    lines = hits.groupBy("doc_id", "tag").agg(F.collect_set("unit").alias("units"))
    hits = hits.unionByName(windows(low, lines, library, threshold))
    hits = hits.groupBy("doc_id", "tag", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), F.col("license").alias("l"))).alias("best"))
    found = hits.groupBy("doc_id", "tag").agg(
        F.array_sort(F.collect_set("best.l")).alias("licenses"),
        F.min("best").alias("best"),
        F.count("*").alias("n_passages"),
    ).select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "licenses", "best", "n_passages")
    rest = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(*rest).withColumn("__own", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(found["__doc"]) & rows["__own"].eqNullSafe(found["__tag"])
    return rows.join(found, same, "left").select(
        *(F.col(c) for c in rest),
        F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.col("best.l").alias("best_license"),
        F.coalesce(-F.col("best.d"), F.lit(0.0)).alias("best_dice"),
        F.coalesce("n_passages", F.lit(0)).cast("bigint").alias("n_passages"),
    )
