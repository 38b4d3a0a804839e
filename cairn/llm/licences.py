"""Licence scan: normalised text compared to licence templates by Dice coefficient over word bigrams. DataFrame functions only.

Compared are each line of a text, the text as a whole, and runs of consecutive words outside the lines that match, so that
a wrapped notice, a licence inside a longer text and a notice that shares its line are found. Normalised: lower case, every run of characters other than
letters and digits one blank. A unit of x distinct bigrams can reach Dice t with a template of y only if
t / (2 - t) * y <= x <= (2 - t) / t * y, so a unit is compared only with templates in its size bounds, after a count
of its bigrams that any template has has shown that the threshold can be reached at all.

A run begins and ends at a bigram of its template, is at most three times as long as the template, and counts as no shorter
than it, so that a part of a notice does not pass for all of it. Such a run has at least t * y of the template's bigrams, so
only texts that have as many are searched; in them the best run always reaches from one end of a stretch of shared bigrams to
an end of another, as one shared bigram more never lowers Dice. Of runs that overlap the one of the highest Dice counts, then of
the smaller template name. Runs are also compared with the full licence texts (licence_texts; there are none of CC licences).

Texts that can match nothing go first: a match lacks few of its template's bigrams, so that of words that stand in more of them than that
(marks) one at least is in the text.

Null and empty texts, and units of under two words, have no bigrams and match nothing. Ties go to the smaller template name. Every
row gives one row, repeated rows too; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

#: Notices by which texts state a licence, and the openings of the licences' own texts.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}
#: Headers that only runs are compared with, besides TEMPLATES and the full texts: the header of version 2 is close to that of version 3.
HEADERS = {"gpl-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]}
THRESHOLD = 0.8
#: From so many bigrams on a template is looked for only in texts that have enough bigrams for it.
LONG = 300
#: What stands for a line that matches, when runs are looked for: a word that no template has.
BARRIER = "0line0that0matches0"


def template_bigrams(templates: dict[str, list[str]] | None = None) -> list[tuple[str, list[str]]]:
    """(licence, sorted distinct word bigrams) of each template; bounded by the list of templates, never by data."""
    out = []
    for name, notices in sorted((templates or TEMPLATES).items()):
        for notice in notices:
            words = re.sub(r"[^a-z0-9]+", " ", notice.lower()).split()
            out.append((name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return out


#: Words too common to tell anything; marks() does without them.
COMMON = "a about all also an and any are as at be been but by can do for from had has have her his if in into is it its may more must no not of on one only or other our out shall so such than that the their them then there these they this those to under up was we were what when which who will with would you your"


def marks(known: list[tuple[list[str], float]]) -> list[str]:
    """Words, and beginnings of words, of which every text with the share given of a template's bigrams has one at least: chosen one after another, each for what it adds to all templates, long ones first. Those of under five letters count as whole words only."""
    common = set(COMMON.split())
    need = [len(b) - math.ceil(share * len(b) - 1e-9) + 1 for b, share in known]
    words = {w for b, _ in known for g in b for w in g.split() if len(w) > 1} - common
    words |= {w[:n] for w in words for n in (6, 7, 8)}
    words = {w for w in words if not any(w in c for c in common)}
    holds = lambda g, w: w in g if len(w) >= 5 else w in g.split()
    cover = {w: [{g for g in b if holds(g, w)} for b, _ in known] for w in sorted(words)}
    got: list[set] = [set() for _ in known]
    out: list[str] = []
    while left := [k for k in range(len(known)) if len(got[k]) < need[k]]:
        worth = lambda w: sum(min(1, len(cover[w][k] - got[k]) / (need[k] - len(got[k]))) for k in left) / (1 if len(w) > 5 else 1.5 if len(w) == 5 else 6)
        best = max(cover, key=lambda w: (worth(w), len(w), w), default="")
        if not best or not worth(best):  # a template of common words alone: every text may match
            return []
        out.append(best)
        got = [a | b for a, b in zip(got, cover.pop(best), strict=True)]
    return out


def may_match(low: Column, some: list[str]) -> Column:
    """Whether a lowered text has one of the marks."""
    out = F.lit(not some)
    for w in some:
        out = out | (low.contains(w) if len(w) >= 5 else low.rlike(rf"(?<![\p{{L}}\p{{N}}]){w}(?![\p{{L}}\p{{N}}])"))
    return out


def normalised_words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " ")), " ")


def bigrams(words: Column) -> Column:
    # Past its end the shifted list is null, so the last word's pair is null and goes.
    return F.array_distinct(F.array_compact(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))))


def _once(value: Column) -> Column:
    """A value behind a generator: Catalyst would else copy its expression to every place that uses it."""
    return F.explode(F.array(value))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """key, unit (1 up: a line; 0: the whole text), licence, dice: the best template of each unit at or above the threshold. df must have one row per key."""
    known = template_bigrams(templates)
    least = min(len(b) for _, b in known) * threshold / (2 - threshold)
    most = max(len(b) for _, b in known) * (2 - threshold) / threshold
    lines = F.split(F.col(text), "\n")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.col(text)), lines)).otherwise(F.array(F.lit(None).cast("string"), F.col(text)))
    u = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(units).alias("unit", "body"))
    u = u.where("body is not null").select(key, "unit", _once(normalised_words(F.col("body"))).alias("words"))
    u = u.where(F.size("words") >= 2).select(key, "unit", _once(bigrams(F.col("words"))).alias("grams"))
    u = u.withColumn("n", F.size("grams")).where(F.col("n").between(least, most))
    every = F.array(*[F.lit(g) for g in sorted({g for _, b in known for g in b})])
    u = u.withColumn("shared", F.size(F.array_intersect("grams", every))).where(F.col("shared") * 2 >= threshold * (F.col("n") + min(len(b) for _, b in known)))
    rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(b)).alias("m"), F.array(*map(F.lit, b)).alias("known")) for name, b in known])
    bound = lambda t: (F.col("n") >= t["m"] * (threshold / (2 - threshold))) & (F.col("n") <= t["m"] * ((2 - threshold) / threshold))
    u = u.withColumn("t", F.explode(F.filter(rows, bound)))
    u = u.withColumn("dice", 2.0 * F.size(F.array_intersect("grams", "t.known")) / (F.col("n") + F.col("t.m"))).where(F.col("dice") >= threshold)
    best = u.groupBy(key, "unit").agg(F.min(F.struct((-F.col("dice")).alias("worse"), F.col("t.licence").alias("licence"))).alias("best"))
    return best.select(key, "unit", F.col("best.licence").alias("licence"), (-F.col("best.worse")).alias("dice"))


def full_texts() -> dict[str, list[str]]:
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def _list(b: list[str]) -> Column:
    return F.split(F.lit("|".join(b)), r"\|")


def scan_runs(df: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """As scan(), of the runs of words outside the units found; unit is minus the place of the run's first word, a line found counting as one word. df must have one row per key."""
    known = template_bigrams() + template_bigrams(HEADERS) + template_bigrams(full_texts())
    short = [b for _, b in known if len(b) < LONG]
    has = lambda b: F.size(F.array_intersect("grams", b))
    enough = has(_list(sorted({g for b in short for g in b}))) >= threshold * min(map(len, short))
    for b in (b for _, b in known if len(b) >= LONG):
        enough = enough | ((F.size("grams") >= threshold * len(b)) & (has(_list(b)) >= threshold * len(b)))
    rows = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(len(b)).alias("m"), _list(b).alias("known")) for name, b in known])
    c = df.where(F.col(text).isNotNull()).select(key, text, _once(normalised_words(F.col(text))).alias("words"))
    c = c.where(F.size("words") >= 2).select(key, text, _once(bigrams(F.col("words"))).alias("grams")).where(enough)
    c = c.select(key, text, _once(F.filter(rows, lambda t: (F.size("grams") >= threshold * t["m"]) & (has(t["known"]) >= threshold * t["m"]))).alias("ts")).where(F.size("ts") > 0)
    c = c.join(found.groupBy(key).agg(F.collect_set("unit").alias("units")), key, "left").withColumn("units", F.coalesce("units", F.array().cast("array<int>"))).where(~F.array_contains("units", 0))
    body = F.array_join(F.transform(F.split(F.col(text), "\n"), lambda x, i: F.when(F.array_contains("units", i + 1), F.lit(BARRIER)).otherwise(x)), "\n")
    c = c.select(key, "ts", _once(normalised_words(body)).alias("words"))
    pairs = F.array_compact(F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b)))
    c = c.where(F.size("words") >= 2).select(key, "ts", _once(pairs).alias("g")).select(key, "g", F.explode("ts").alias("t"))
    hits = F.array_compact(F.transform("g", lambda x, i: F.when(F.array_contains(F.col("t.known"), x), i + 1)))
    c = c.select(key, "g", "t", _once(hits).alias("hits")).where(F.size("hits") >= threshold * F.col("t.m"))
    edge = lambda step: F.filter("hits", lambda p, i: ~F.coalesce(F.get("hits", i + step) == p + step, F.lit(False)))
    c = c.select(key, "g", "t", _once(edge(-1)).alias("starts"), F.col("hits")).select(key, "g", "t", "starts", _once(edge(1)).alias("ends"))
    m = F.col("t.m")
    # A run at the threshold has at most so many bigrams that the template lacks, and so no more gaps.
    gaps = F.floor(m * (2 * (1 - threshold) / threshold)).cast("int") + 1

    def runs(s: Column, i: Column) -> Column:
        ends = F.filter(F.slice("ends", i + 1, gaps + 1), lambda e: (e - s + 1).between(threshold * m, 3 * m))
        cut = F.transform(ends, lambda e: F.struct(s.alias("from"), e.alias("to"), F.array_distinct(F.slice("g", s, e - s + 1)).alias("grams")))
        dice = lambda x: -2.0 * F.size(F.array_intersect(x["grams"], F.col("t.known"))) / (F.greatest(F.size(x["grams"]), m) + m)
        return F.array_min(F.transform(cut, lambda x: F.struct(dice(x).alias("worse"), F.col("t.licence").alias("licence"), x["from"].alias("from"), x["to"].alias("to"))))

    c = c.select(key, F.explode(F.transform("starts", runs)).alias("run")).where(F.col("run.worse") <= -threshold)
    c = c.groupBy(key).agg(F.array_sort(F.collect_list("run")).alias("runs"))
    none = F.array().cast("array<struct<worse: double, licence: string, from: int, to: int>>")
    apart = lambda kept, x: F.when(F.exists(kept, lambda y: (x["from"] <= y["to"]) & (y["from"] <= x["to"])), kept).otherwise(F.concat(kept, F.array(x)))
    c = c.select(key, F.explode(F.aggregate("runs", none, apart)).alias("run"))
    return c.select(key, (-F.col("run.from")).alias("unit"), F.col("run.licence").alias("licence"), (-F.col("run.worse")).alias("dice"))


def scan_documents(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_notices (units and runs that match), licences (distinct, ascending, joined by a comma; empty if none), best_dice of every document."""
    # A unit at the threshold has t / (2 - t) of its template's bigrams, a run t of them.
    some = marks([(b, threshold / (2 - threshold)) for _, b in template_bigrams()] + [(b, threshold) for _, b in template_bigrams(HEADERS) + template_bigrams(full_texts())])
    low = df.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), F.explode(F.array(F.lower("text"))).alias("low"))
    # Written, so that a row has one number for all that follows; texts that can match nothing are left out.
    d = materialize(low.select("doc_id", "row", F.when(may_match(F.col("low"), some), F.col("text")).alias("text")), "licence-rows")
    candidates = d.where("text is not null").select("row", "text")
    found = materialize(scan(candidates, "row", threshold=threshold), "licence-units")
    found = found.unionByName(scan_runs(candidates, found, "row", threshold=threshold))
    sums = found.groupBy("row").agg(F.count("*").alias("n_notices"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licences"), F.round(F.max("dice"), 6).alias("best_dice"))
    out = d.select("doc_id", "row").join(sums, "row", "left")
    return out.select("doc_id", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))
