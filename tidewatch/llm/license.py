"""License scan in DataFrame expressions only: MinHash bands over text windows, then exact containment."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices to look for.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-long": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License.",
    "mit-long": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}
WIDTH = 5
CONTAINED = 0.8
#: One hash a band, and so many bands.  A window is two steps long and a template has over half a step of
#: shingles, at least CONTAINED of which a match shares: the similarity of their shingle sets is then
#: 0.4 / 2.1 = 0.19 or more, and they meet in a band with probability 1 - (1 - 0.19) ** BANDS > 0.9999.
BANDS = 48


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """The hash of each run of WIDTH words; none for fewer words."""
    at = F.when(F.size(ws) >= WIDTH, F.sequence(F.lit(1), F.size(ws) - (WIDTH - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(ws, i, WIDTH), " ")))


def plain_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that less than CONTAINED of any template's shingles do without all of them.

    A text that holds none of them can therefore contain no template; the rarest-looking (longest)
    words are taken first.
    """
    out: set[str] = set()
    for text in templates.values():
        ws = plain_words(text)
        runs = [set(ws[i : i + WIDTH]) for i in range(len(ws) - WIDTH + 1)]
        for w in sorted(set(ws), key=lambda w: (-len(w), w)):
            if sum(not r & out for r in runs) < CONTAINED * len(runs):
                break
            out.add(w)
    return sorted(out)


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(template, step, ours, total)``: as large as the templates given, whatever the documents.

    ``ours`` are a template's distinct shingles.  ``step`` is the distance of windows for its length,
    the least power of two that is not below their number; windows are two steps long, so one holds
    each occurrence whole.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in templates.items()])
    apart = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", F.explode(F.array(words(F.col("t.text")))).alias("ws"))
    one = apart.select("template", F.array_distinct(shingles(F.col("ws"))).alias("ours"))
    step = F.pow(2.0, F.ceil(F.log2(F.size("ours").cast("double")))).cast("int")
    return one.select("template", step.alias("step"), "ours", F.size("ours").alias("total"))


def minhash(of: Column) -> Column:
    """A window's bands: the least hash of its shingles, under each band's seed."""
    least = lambda b: F.array_min(F.transform(of, lambda s: F.xxhash64(s, F.lit(b))))
    return F.array(*map(least, range(BANDS)))


def scan_licenses(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``(key, template, containment, matched, total, first_word)``: one row for each row of ``docs`` and template contained.

    Containment is the share of a template's distinct five-word shingles within one window; 0.8 or
    more counts, the best window is reported (of equals the first), and ``first_word`` is the number
    of words before its first matched shingle.  Null texts and texts under five words have none;
    texts are read whole; every row is scanned by itself, so rows that repeat a key, or have a null
    one, give results of their own; other columns are ignored; an empty table gives none.
    Templates must have five words at least.
    """
    if short := [k for k, v in templates.items() if len(plain_words(v)) < WIDTH]:
        raise ValueError(f"templates under {WIDTH} words: {short}")
    known = template_table(spark, templates)  # broadcast below: its size is that of the templates given
    told = known.select("step", "ours").collect()
    steps, all_ours = sorted({r["step"] for r in told}), sorted({x for r in told for x in r["ours"]})
    gate = r"(?<![\p{L}\p{N}])(?:" + "|".join(anchors(templates)) + r")(?![\p{L}\p{N}])"
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.lower("text").rlike(gate))
    # words and shingles stand in rows of their own, so that later steps read them instead of making them anew
    apart = some.select("key", F.monotonically_increasing_id().alias("row"), F.explode(F.array(words(F.col("text")))).alias("ws"))
    hashed = apart.select("key", "row", F.explode(F.array(shingles(F.col("ws")))).alias("all"))
    # a window without any template's shingle contains no template: the others are cut out, with all their shingles
    at = F.filter(F.transform("all", lambda s, i: F.when(s.isin(all_ours), i)), lambda i: i.isNotNull())
    near = hashed.select("key", "row", "all", F.explode(F.array(at)).alias("at")).where(F.size("at") > 0)

    def of_step(s: int) -> Column:
        both = F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(F.floor(i / s), F.floor(i / s) - 1))))
        return F.transform(F.filter(both, lambda w: w >= 0), lambda w: F.struct(F.lit(s).alias("step"), w.alias("window")))

    places = F.flatten(F.array(*map(of_step, steps)))
    cut_out = near.select("key", "row", "all", F.explode(places).alias("p"))
    window = F.slice("all", (F.col("p.window") * F.col("p.step") + 1).cast("int"), 2 * F.col("p.step"))
    windows = cut_out.select("key", "row", "p.step", "p.window", F.explode(F.array(window)).alias("of"))
    bands = windows.select("*", F.posexplode(minhash(F.col("of"))).alias("band", "value"))
    mine = known.select("template", "step", F.posexplode(minhash(F.col("ours"))).alias("band", "value"))
    candidates = bands.join(F.broadcast(mine), ["step", "band", "value"]).groupBy("key", "row", "step", "window", "template").agg(F.first("of").alias("of"))
    # verification: the shingles of a candidate's window against its template's, and nothing else
    asked = candidates.join(F.broadcast(known.select("template", "ours", "total")), "template")
    first = F.array_min(F.filter(F.transform("of", lambda s, i: F.when(F.array_contains("ours", s), i)), lambda i: i.isNotNull()))
    hits = asked.select("key", "row", "template", "total", F.size(F.array_intersect("of", "ours")).cast("long").alias("matched"), (F.col("window") * F.col("step") + first).alias("first_word"))
    exact = hits.where(F.col("matched") >= CONTAINED * F.col("total"))
    best = F.max_by(F.struct("matched", "first_word"), F.struct("matched", -F.col("first_word")))
    out = exact.groupBy("key", "row", "template", "total").agg(best.alias("best"))
    return out.select("key", "template", (F.col("best.matched") / F.col("total")).alias("containment"), F.col("best.matched").alias("matched"), F.col("total").cast("long").alias("total"), F.col("best.first_word").cast("long").alias("first_word"))
