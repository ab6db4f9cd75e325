"""License scan with DataFrame functions only: Dice coefficient over word bigrams of lines and templates.

A line is normalised: lower case, runs of other characters than a-z and 0-9 become one
space. Its distinct word bigrams (its only word, if it has one) are compared with
those of each template; Dice = 2 * shared / (line's + template's). A Dice of at least t
needs a line of size between t / (2 - t) and (2 - t) / t times the template's: lines
whose size fits no template are dropped before any comparison, then lines that share no
bigram with any template, and each line that is left meets just the templates
of its size. All of that happens within the line's row, so nothing but found lines is shuffled.

Statements that wrap over lines or stand within longer lines, and the licence texts in
``license_texts``, are found as windows over the words of the whole text: a window
begins at a bigram of the template. For templates of up to 64 bigrams, all statements among them, it ends at one too, and all of those windows
of a size that can reach the threshold are tried: no other window could be better. For longer ones it has 0.75, 1 or 1.25 times the template's bigrams, and the whole text is one more.
At a Dice of t a window shares at least t / (2 - t) of the template's bigrams, so texts without
any word of a set that touches enough bigrams of every template are dropped first. Of windows
that overlap, the one that shares most bigrams counts, ties for the largest Dice, and none counts that overlaps a line
that counts already. Of templates of 400 bigrams and more not every hit begins a window: one in (bigrams / 64).

Defined cases: a null or empty text has no lines; a line that fits several templates
counts for the best one, ties for the first name; rows that share an id (or a null id) are reported as
one document, and each of their lines counts, in repeated rows too; further columns are ignored; no match gives no row.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Licence statements as they are commonly worded.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}


#: Words that most texts have; which they are changes the cost alone.
COMMON = frozenset("a all an and any are as at be been by for from has have in is it no not of on or that the these this to under which will with work works you your 0 1 2 3 4".split())


#: Bigrams of a template up to which all windows are tried.
EVERY_WINDOW = 64


def full_texts() -> dict[str, str]:
    """The licence texts beside this file, by name."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def bigrams_of(text: str) -> list[str]:
    """The distinct bigrams of a template."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))}) if words else []


def size_bounds(n: int, threshold: float) -> range:
    """Sizes of lines that can reach the threshold with a template of n bigrams."""
    return range(max(1, math.ceil(threshold / (2 - threshold) * n - 1e-9)), math.floor((2 - threshold) / threshold * n + 1e-9) + 1)


def _bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def _best_lines(docs: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """doc_id, license, dice: the lines that are statements."""
    known = [(name, bigrams_of(text)) for name, text in sorted(templates.items())]
    known = [(name, grams) for name, grams in known if grams]
    if not known:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("dice")).limit(0)
    every = sorted({g for _, grams in known for g in grams})
    # distinct bigrams can be fewer than words - 1, so only the lower bound holds for words
    least = min((size_bounds(len(g), threshold).start for _, g in known), default=1)
    most = max((size_bounds(len(g), threshold)[-1] for _, g in known), default=0)
    # each generator is a barrier: what it makes is computed once, not again in every filter above it
    normal = F.transform(F.split("text", "\n"), lambda line: F.split(F.trim(F.regexp_replace(F.lower(line), "[^a-z0-9]+", " ")), " "))
    words = docs.select("doc_id", F.explode(normal).alias("words")).where((F.size("words") >= least) & (F.element_at("words", 1) != ""))
    grams = words.select("doc_id", F.explode(F.array(_bigrams(F.col("words")))).alias("grams"))
    grams = grams.where(F.size("grams").between(least, most) & F.arrays_overlap("grams", F.array(*map(F.lit, every)) if every else F.lit(None).cast("array<string>")))
    # least first: the largest dice, then the first name
    templates_of = [(i, name, own, size_bounds(len(own), threshold)) for i, (name, own) in enumerate(known)]
    constant = F.from_json(F.lit(json.dumps([{"i": i, "license": name, "grams": own, "low": r.start, "high": r[-1]} for i, name, own, r in templates_of])), "array<struct<i:int,license:string,grams:array<string>,low:int,high:int>>")
    size = F.size("grams")
    fitting = F.filter(constant, lambda t: size.between(t["low"], t["high"]))
    dice = lambda t: F.lit(2.0) * F.size(F.array_intersect("grams", t["grams"])) / (size + F.size(t["grams"]))
    best = F.array_min(F.transform(fitting, lambda t: F.struct((-dice(t)).alias("less"), t["i"].alias("i"), t["license"].alias("license"))))
    found = grams.select("doc_id", F.explode(F.array(best)).alias("best")).where(F.col("best.less") <= -threshold)
    return found.select("doc_id", "best.license", (-F.col("best.less")).alias("dice"))


def anchors(templates: list[list[str]], threshold: float) -> list[str]:
    """Words of which every window that reaches the threshold with a template has at least one."""
    out: set[str] = set()
    for grams in sorted(templates, key=len):
        may_miss = len(grams) - math.ceil(threshold / (2 - threshold) * len(grams) - 1e-9)
        left = [g.split() for g in grams if not out & set(g.split())]
        words = sorted({w for g in left for w in g}, key=lambda w: (w in COMMON, -len(w), w))
        while len(left) > may_miss:
            word = words.pop(0)
            if any(word in g for g in left):
                out.add(word)
                left = [g for g in left if word not in g]
    return sorted(out)


def _windows(docs: DataFrame, templates: list[tuple[str, str]], line_templates: dict[str, str], threshold: float) -> DataFrame:
    """doc_id, license, dice, copies (rows of that id and text): windows over whole texts that are statements, apart from lines that are. Only texts with enough bigrams of a template leave the scan."""
    need = threshold / (2 - threshold)
    known = [(name, bigrams_of(text), max(1, len(re.sub(r"[^a-z0-9]+", " ", text.lower()).split()) - 1)) for name, text in templates]
    known = [{"license": name, "grams": grams, "n": len(grams), "need": math.ceil(need * len(grams) - 1e-9), "size": size, "step": max(1, size // 64) if size >= 400 else 1, "low": size_bounds(len(grams), threshold).start, "high": size_bounds(len(grams), threshold)[-1]} for name, grams, size in known if grams]
    kind = "array<struct<license:string,grams:array<string>,n:int,need:int,size:int,step:int,low:int,high:int>>"
    constant = lambda x, t: F.from_json(F.lit(json.dumps(x)), t)
    split = lambda text: F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    rare = anchors([x["grams"] for x in known], threshold)
    texts = docs.select("doc_id", "text", F.explode(F.array(split("text"))).alias("words"))
    texts = texts.where(F.arrays_overlap("words", constant(rare, "array<string>")))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    texts = texts.select("doc_id", "text", F.explode(F.array(F.when(F.size("words") > 1, pairs).otherwise(F.col("words")))).alias("grams"))

    def fitting(some: list[dict]) -> Column:
        """The templates that a text has enough bigrams of."""
        own = F.array_intersect("grams", constant(sorted({g for x in some for g in x["grams"]}), "array<string>"))
        fits = lambda own: F.filter(constant(some, kind), lambda t: F.when(F.size(own) >= t["need"], F.size(F.array_intersect(own, t["grams"])) >= t["need"]).otherwise(False))
        every = F.flatten(F.transform(F.array(own), fits))
        return F.when(F.size("grams") >= min((x["need"] for x in some), default=1), every).otherwise(constant([], kind))

    texts = texts.select("doc_id", "text", "grams", F.explode(F.concat(*(fitting([x for x in known if (x["size"] >= 400) == long]) for long in (False, True)))).alias("t"))
    texts = texts.select("doc_id", "text", "grams", "t.*", F.explode(F.array(F.filter(F.transform("grams", lambda g, i: F.struct(i.alias("at"), g.alias("gram"))), lambda x: F.array_contains(F.col("t.grams"), x["gram"])))).alias("hits"))
    texts = texts.toDF("doc_id", "text", "grams", "license", "template", "n", "need", "size", "step", "low", "high", "hits")
    count = lambda grams: F.size(F.array_distinct(grams))
    longest = F.greatest(F.ceil(F.col("size") * 1.25).cast("int"), F.col("high"))
    starts = F.filter(F.transform("hits", lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))), lambda x: x["i"] % F.col("step") == 0)
    begun = texts.select("*", F.explode(F.concat(starts, F.array(F.struct(F.lit(0).alias("at"), F.lit(-1).alias("i"))))).alias("start"))
    begun = begun.withColumn("near", F.when(F.col("start.i") < 0, F.col("hits")).otherwise(F.slice("hits", F.greatest(F.col("start.i"), F.lit(0)) + 1, longest)))
    all_ends = F.filter(F.transform("near", lambda x: x["at"] - F.col("start.at") + 1), lambda length: length.between(F.col("low"), F.col("high")))
    lengths = F.when(F.col("start.i") < 0, F.array(F.size("grams"))).when(F.col("size") <= EVERY_WINDOW, all_ends).otherwise(F.array(*(F.least(F.ceil(F.col("size") * x).cast("int"), F.size("grams") - F.col("start.at")) for x in (0.75, 1.0, 1.25))))
    sized = begun.select("*", F.explode(F.array_distinct(lengths)).alias("length")).where(F.col("length") > 0)
    sized = sized.select("*", F.explode(F.array(count(F.transform(F.filter("near", lambda x: x["at"] < F.col("start.at") + F.col("length")), lambda x: x["gram"])))).alias("shared"))
    sized = sized.where(F.col("shared") >= F.col("need"))
    dice = F.lit(2.0) * F.col("shared") / (F.col("n") + count(F.slice("grams", F.col("start.at") + 1, F.col("length"))))
    found = sized.select("doc_id", "text", "license", F.col("start.at").alias("a"), (F.col("start.at") + F.col("length")).alias("z"), "shared", dice.alias("dice"), F.col("start.i").alias("i")).where(F.col("dice") >= threshold)
    # bigrams a to z - 1 are words a to z
    ranked = F.sort_array(F.collect_set(F.struct((-F.col("shared")).alias("less"), (-F.col("dice")).alias("d"), "license", "a", "z")))
    # a row has each of these windows once, so their number tells how often the row is repeated
    copies = (F.count("*") / F.size(F.collect_set(F.struct("license", "a", "z", "i")))).cast("int").alias("copies")
    found = found.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), ranked.alias("windows"), copies)
    # where the words of lines lie that count already
    found = found.select("doc_id", "windows", "copies", F.explode(F.array(F.transform(F.split("text", "\n"), split))).alias("lines"))
    before = lambda i: F.aggregate(F.slice("lines", F.lit(1), i), F.lit(0), lambda x, y: x + F.when(F.element_at(y, 1) == "", 0).otherwise(F.size(y)))
    short = constant([g for g in map(bigrams_of, line_templates.values()) if g], "array<array<string>>")
    fits = lambda own: F.exists(short, lambda t: F.lit(2.0) * F.size(F.array_intersect(own, t)) / (F.size(own) + F.size(t)) >= threshold)
    counts = lambda line: F.exists(F.array(_bigrams(line)), fits)
    taken = F.filter(F.transform("lines", lambda line, i: F.when((F.element_at(line, 1) != "") & counts(line), i)), lambda i: i.isNotNull())
    spans = F.transform(taken, lambda i: F.struct(F.lit(1).alias("less"), F.lit(0.0).alias("d"), F.lit("").alias("license"), before(i).alias("a"), (before(i + 1) - 1).alias("z")))
    clash = lambda x, y: (x["a"] <= y["z"]) & (y["a"] <= x["z"])
    kind = "array<struct<less:int,d:double,license:string,a:int,z:int>>"
    chosen = F.aggregate("windows", spans.cast(kind), lambda acc, w: F.when(F.exists(acc, lambda x: clash(x, w)), acc).otherwise(F.concat(acc, F.array(w).cast(kind))))
    return found.select("doc_id", "copies", F.explode(chosen).alias("w")).where("w.less <= 0").select("doc_id", F.col("w.license").alias("license"), (-F.col("w.d")).alias("dice"), "copies")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, n_lines, dice: a row for each document and licence that it states; n_lines: its lines and windows, dice: of the best."""
    lines = _best_lines(docs, templates or TEMPLATES, threshold)
    texts = [*sorted((templates or TEMPLATES).items()), *(() if templates else full_texts().items())]
    found = lines.withColumn("copies", F.lit(1)).unionByName(_windows(docs, texts, templates or TEMPLATES, threshold))
    return found.groupBy("doc_id", "license").agg(F.sum("copies").alias("n_lines"), F.max("dice").alias("dice"))


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The part of it that lines are, in DuckDB, every line against every template."""
    values = ", ".join("('" + name + "', ['" + "', '".join(bigrams_of(text)) + "'])" for name, text in sorted(TEMPLATES.items()))
    return f"""
WITH templates(license, template) AS (VALUES {values}),
numbered AS (SELECT doc_id, text, row_number() OVER () AS row_no FROM documents),
split AS (SELECT doc_id, row_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM numbered),
words AS (SELECT doc_id, row_no, line_no, string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM split WHERE regexp_matches(lower(line), '[a-z0-9]')),
grams AS (SELECT doc_id, row_no, line_no, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM words),
scored AS (SELECT doc_id, row_no, line_no, license, 2.0::DOUBLE * len(list_intersect(g, template)) / (len(g) + len(template)) AS dice FROM grams, templates),
best AS (SELECT *, row_number() OVER (PARTITION BY row_no, line_no ORDER BY dice DESC, license) AS k FROM scored WHERE dice >= {threshold})
SELECT doc_id, license, count(*) AS n_lines, max(dice) AS dice FROM best WHERE k = 1 GROUP BY doc_id, license"""
