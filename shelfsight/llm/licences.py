"""Licence notices: a trained paragraph classifier with an unknown class, confirmed against templates.

Paragraphs are runs of lines without a blank one, read through windows of up to ``lines`` lines, single lines among
them, so that notices are found hard-wrapped as well as beside other text. Features are word bigrams and trigrams that occur in the templates; a multinomial logistic
regression, fitted on shortened and embedded templates and on paragraphs of the corpus as the unknown class,
weighs them. Platt scaling on rows that the fit has not seen turns the odds of the likeliest family against all other
classes into the probability that the notice is one of that family; below a limit it is unknown. A paragraph without any such n-gram has the unknown class's features and is not looked at further,
so only few paragraphs are scored. The weights are a constant of bounded size, and all work is built-in
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.workspace import written

UNKNOWN = "unknown"

#: Usual notices of each licence family.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Distributed under the terms of the Apache License, Version 2.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("agpl-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated this work to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
)
#: Sentences about licences that grant none, labelled unknown.
OTHERS = (
    "A driving licence is required for this job.", "The license plate was found near the station.",
    "Choosing between the MIT License and others is hard.", "The general public was invited to the opening.",
    "Version 3 of the program is faster than version 2.", "He took a poetic license with the facts.",
    "The software is sold under many names.", "The terms of the contract were discussed in public.",
    "The Apache helicopter was shown to the public.", "This work is the result of many years.",
)
#: More of them, for calibration only.
OTHERS_HELD_OUT = (
    "All rights of way are reserved for walkers.", "She studied at MIT and holds a driving license.",
    "The notice was distributed under the door.", "Version 2 of the apache server license key expired.",
    "The foundation published a public statement.", "Every copy of this work was sold in the public square.",
    "You may not use this entrance.", "The creative commons room is open to the international public.",
    "The author dedicated this work to his mother.", "Redistribution of land was debated in source documents.",
)
#: Words that say nothing by themselves; n-grams of them alone are no features.
COMMON = frozenset(
    "a all an and any are as at be by can do for from has have if in is it its may must no not of on one or so that the "
    "this to under was which with you your".split()
)


@dataclass(frozen=True)
class LicenceSettings:
    """``sample_docs`` documents of least hash give unknown paragraphs. A family counts from the calibrated ``probability`` on and is
    confirmed when a template of it shares ``share`` of the template's n-grams with the paragraph. Windows have up to
    ``lines`` lines: as many as the longest template has words, so that no template is too long at one word a line."""

    sample_docs: int = 1000
    probability: float = 0.5
    share: float = 0.5
    lines: int = max(len(text.split()) for _, text in TEMPLATES)


def _words(text: str) -> str:
    return f"filter(split(lower({text}), r'[^a-z0-9\\-]+'), w -> w != '')"


def _bigrams(words: str) -> str:
    return f"zip_with({words}, slice({words}, 2, size({words})), (a, b) -> concat(a, ' ', b))"


def _grams(words: str) -> str:
    """Bigrams and trigrams; pairing with the shifted array leaves nulls at the end."""
    three = f"zip_with({_bigrams(words)}, slice({words}, 3, size({words})), (a, b) -> concat(a, ' ', b))"
    return f"filter(concat({_bigrams(words)}, {three}), g -> g IS NOT NULL)"


def _telling(gram: str) -> bool:
    """Whether an n-gram has a bigram that is not only of common words."""
    words = gram.split()
    return any(not {a, b} <= COMMON for a, b in zip(words, words[1:], strict=False))


def _with_grams(frame: DataFrame) -> DataFrame:
    """Adds ``grams`` to rows with ``paragraph``."""
    return frame.withColumn("_w", F.expr(_words("paragraph"))).withColumn("grams", F.expr(_grams("_w"))).drop("_w")


def _variants(text: str) -> list[str]:
    words = text.split()
    half = max(3, len(words) // 2)
    return [text, " ".join(words[:-1]), " ".join(words[1:]), " ".join(words[:half + 1]), "see below: " + text,
            text + " see the file for details"]


def _held_out_variants(text: str) -> list[str]:
    """Other edits than those the model is fitted on: words left out or changed, other surroundings."""
    words = text.split()
    n = len(words)
    return [
        " ".join(words[:n // 3] + words[n // 3 + 1:]), " ".join(words[:2 * n // 3] + words[2 * n // 3 + 1:]),
        " ".join([*words[:n // 2], "hereby", *words[n // 2:]]), "copyright by the authors 2020 " + text + " thank you",
        " ".join(words[:max(3, 4 * n // 5)]), "note that " + text,
    ]


@dataclass(frozen=True)
class LicenceModel:
    families: list[str]  # the first is UNKNOWN
    grams: list[str]
    weights: list[list[float]]  # by n-gram, then family
    bias: list[float]
    templates: list[list[str]]  # n-grams
    template_family: list[int]
    scale: float  # calibrated log odds are scale * log odds + shift
    shift: float
    held_out: int  # rows of calibration, and the mean squared error of the probabilities there before and after
    error_before: float
    error_after: float


def _calibrated(scored: DataFrame) -> tuple[float, float, int, float, float]:
    """Platt scaling: logistic regression of ``hit`` on ``odds``, both classes of equal weight, with Platt's targets
    that stay off 0 and 1. Also rows, and the weighted squared error before and after."""
    both = scored.groupBy("hit").count().collect()
    count = {r["hit"]: r["count"] for r in both}
    yes, no = count.get(1, 0), count.get(0, 0)
    if not yes or not no:
        return 1.0, 0.0, yes + no, float("nan"), float("nan")
    of_hit = F.when(F.col("hit") == 1, (yes + 1) / (yes + 2)).otherwise(1 / (no + 2))
    weight = F.when(F.col("hit") == 1, 0.5 / yes).otherwise(0.5 / no)
    rows = scored.select("odds", "hit", of_hit.alias("target"), weight.alias("weight"))
    rows = VectorAssembler(inputCols=["odds"], outputCol="features").transform(rows)
    soft = rows.select("features", F.lit(1.0).alias("label"), (F.col("target") * F.col("weight")).alias("w")).union(
        rows.select("features", F.lit(0.0), (1 - F.col("target")) * F.col("weight"))
    )
    model = LogisticRegression(weightCol="w", maxIter=100, tol=1e-9, standardization=False).fit(soft)
    scale, shift = float(model.coefficients[0]), float(model.intercept)

    def error(a: float, b: float):
        gap = 1 / (1 + F.exp(-(a * F.col("odds") + b))) - F.col("hit")
        return F.sum(F.col("weight") * gap * gap)

    before, after = rows.agg(error(1.0, 0.0), error(scale, shift)).first()
    return scale, shift, yes + no, before, after


def train(docs: DataFrame, settings: LicenceSettings = LicenceSettings()) -> LicenceModel:
    spark = docs.sparkSession
    families = [UNKNOWN, *sorted({f for f, _ in TEMPLATES})]
    labelled = [(families.index(f), v) for f, t in TEMPLATES for v in _variants(t)] + [(0, t) for t in OTHERS * 3]
    rows = _with_grams(spark.createDataFrame(labelled, "label int, paragraph string"))
    exact = _with_grams(
        spark.createDataFrame([(i, t) for i, (_, t) in enumerate(TEMPLATES)], "i int, paragraph string")
    ).collect()
    templates = [sorted(g for g in set(r["grams"]) if _telling(g)) for r in sorted(exact, key=lambda r: r["i"])]
    vocabulary = sorted({g for t in templates for g in t})

    least = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_docs)
    sample = docs.join(F.broadcast(least), "doc_id", "left_semi")
    lines = _with_grams(sample.select(F.explode(F.split("text", "\n")).alias("paragraph")))
    # A corpus paragraph that shares a trigram with a template may be a licence, so it is no sample of the unknown.
    longer = _constant([g for g in vocabulary if g.count(" ") == 2])
    # Others without any feature say nothing about the weights; one empty row stands for them.
    near = f"arrays_overlap(grams, {_constant(vocabulary)}) AND NOT arrays_overlap(grams, {longer})"
    # A quarter of the distinct lines is kept for calibration.
    kept_out = "pmod(xxhash64(array_sort(array_distinct(grams))), 4) = 0"
    strange = lines.where(near).select(F.lit(0).alias("label"), "grams", F.expr(kept_out).alias("out"))
    strange = written(strange, "licence-unknown")
    empty = spark.sql("SELECT 0, CAST(array() AS ARRAY<STRING>)")
    unknown = strange.where("NOT out").drop("out").union(empty)

    counter = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    data = counter.transform(rows.select("label", "grams").union(unknown))
    model = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60, standardization=False).fit(data)

    later = [(families.index(f), v) for f, t in TEMPLATES for v in _held_out_variants(t)]
    later += [(0, t) for t in OTHERS_HELD_OUT]
    held = _with_grams(spark.createDataFrame(later, "label int, paragraph string")).select("label", "grams")
    held = held.union(strange.where("out").select("label", "grams").distinct()).union(empty)
    # Odds of the likeliest family against all other classes.
    p = model.transform(counter.transform(held)).select("label", vector_to_array("probability").alias("p"))
    p = p.withColumn("known", F.expr("slice(p, 2, size(p) - 1)")).withColumn("best", F.array_max("known"))
    scored = p.select(
        F.expr("ln(greatest(best, 1e-12D) / greatest(1 - best, 1e-12D))").alias("odds"),
        F.expr("CAST(array_position(known, best) = label AS INT)").alias("hit"),
    )
    scored = written(scored, "licence-held-out")
    weights = model.coefficientMatrix.toArray().T.tolist()
    return LicenceModel(
        families, vocabulary, weights, model.interceptVector.toArray().tolist(), templates,
        [families.index(f) for f, _ in TEMPLATES], *_calibrated(scored),
    )


def _constant(values: list[str]) -> str:
    """An array of strings as a constant; the values hold no bar."""
    return "split('" + "|".join(v.replace("'", "") for v in values) + "', '[|]')"


def licence_scan(docs: DataFrame, settings: LicenceSettings = LicenceSettings()) -> DataFrame:
    """Licence notices in every row of ``docs`` (doc_id, text; other columns are ignored).

    Returns doc_id, n_paragraphs (lines with a word), n_scored (those with an n-gram of a template), n_notices
    (windows of lines with a confirmed family, the shortest of those that overlap), families (confirmed ones, sorted,
    comma-joined) and notices (first line:family:probability of each, in order, lines from 0; probabilities in
    thousandths). A window of another family that holds a weaker notice takes its place. Null and empty texts have none. Repeated rows give repeated results; empty input gives empty output.
    """
    model = train(docs, settings)
    n = len(model.families)
    weights = _constant([",".join(str(round(1000 * x)) for x in row) for row in model.weights])
    in_templates = [
        ",".join(str(t) for t, grams in enumerate(model.templates) if g in set(grams)) for g in model.grams
    ]
    weight_of = f"map_from_arrays({_constant(model.grams)}, {weights})"
    template_of = f"map_from_arrays({_constant(model.grams)}, {_constant(in_templates)})"
    listed = ", ".join(f"'{g}'" for g in model.grams)
    bias = "array(" + ", ".join(str(round(1000 * b)) for b in model.bias) + ")"
    sizes = "array(" + ", ".join(str(len(t)) for t in model.templates) + ")"
    family_of = "array(" + ", ".join(map(str, model.template_family)) + ")"
    names = "array(" + ", ".join(f"'{f}'" for f in model.families) + ")"

    given = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    lines = given.select(
        "doc_id", F.expr("split(text, '\\n', -1)").alias("lines"), F.expr(_words("text")).alias("all_words")
    )
    # Texts without a telling bigram, lines taken together, have none in any line.
    pairs = ", ".join(f"'{g}'" for g in model.grams if g.count(" ") == 1)
    words = lines.select(
        "doc_id",
        F.expr(r"CAST(size(filter(lines, l -> l rlike r'[^\x20\x09-\x0D]')) AS BIGINT)").alias("n_paragraphs"),
        F.expr(f"exists({_bigrams('all_words')}, g -> coalesce(g IN ({pairs}), false))").alias("maybe"),
        "lines",
    ).select("doc_id", "n_paragraphs", F.expr("CASE WHEN maybe THEN lines ELSE array() END").alias("lines"))
    # All words with their lines; a blank line stands as an empty word, which no n-gram spans. Dashes alone are no words.
    line_words = f"filter({_words('l')}, w -> trim(BOTH '-' FROM w) != '')"
    flat = (
        rf"flatten(transform(lines, (l, i) -> IF(l rlike r'[^\x20\x09-\x0D]', transform({line_words}, w -> "
        "struct(i AS line, w AS w)), array(struct(i AS line, '' AS w)))))"
    )

    # A word broken at its dash by a line's end is one word.
    broken = "flat[{0}].w LIKE '%-' AND flat[{0} + 1].w != '' AND flat[{0} + 1].line > flat[{0}].line"
    rejoined = (
        f"filter(transform(flat, (x, k) -> struct(x.line AS line, IF(k + 1 < size(flat) AND {broken.format('k')}, "
        f"concat(x.w, flat[k + 1].w), x.w) AS w, k > 0 AND {broken.format('(k - 1)')} AS rest)), x -> NOT x.rest)"
    )

    def grams(n: int) -> str:
        text = ", ' ', ".join(f"flat[k + {d}].w" for d in range(n))
        return (
            f"IF(size(flat) < {n}, array(), filter(transform(sequence(0, greatest(size(flat) - {n}, 0)), k -> struct("
            f"flat[k].line AS a, flat[k + {n - 1}].line AS b, concat({text}) AS g)), x -> x.g IN ({listed})))"
        )

    # Hits by first line, and where each line's begin; as many lines on, no window of the line goes further.
    placed = words.withColumn("flat", F.expr(flat)).withColumn("flat", F.expr(rejoined)).withColumn(
        "hits", F.expr(f"array_sort(array_distinct(concat({grams(2)}, {grams(3)})))")
    ).drop("flat").withColumn(
        "starts",
        F.expr(
            "filter(transform(hits, (x, h) -> IF(h = 0 OR x.a != hits[greatest(h - 1, 0)].a, h, -1)), h -> h >= 0)"
        ),
    )
    near = (
        f"slice(hits, h + 1, coalesce(try_element_at(starts, p + {settings.lines + 1}), size(hits)) - h)"
    )
    whole = r"NOT exists(slice(lines, x.i + 2, greatest(y.b - x.i - 1, 0)), l -> NOT l rlike r'[^\x20\x09-\x0D]')"
    ends = f"array_distinct(transform(filter(x.near, y -> y.b < x.i + {settings.lines} AND {whole}), y -> y.b))"
    windows = (
        f"flatten(transform(transform(starts, (h, p) -> struct(hits[h].a AS i, {near} AS near)), x -> transform({ends}, j -> "
        "struct(x.i AS line, j AS stop, array_distinct(transform(filter(x.near, y -> y.b <= j), y -> y.g)) AS hits))))"
    )
    hits = placed.select(
        "doc_id", "n_paragraphs",
        F.expr("CAST(size(array_distinct(transform(filter(hits, x -> x.a = x.b), x -> x.a))) AS BIGINT)").alias("n_scored"),
        F.expr(windows).alias("scored"),
    )
    logits = (
        f"transform(sequence(0, {n - 1}), f -> aggregate(y.hits, {bias}[f], "
        f"(s, g) -> s + CAST(split({weight_of}[g], ',')[f] AS INT)))"
    )
    shares = (
        f"transform(sequence(0, {len(model.templates) - 1}), t -> struct({family_of}[t] AS family, "
        f"size(filter(y.hits, g -> array_contains(split({template_of}[g], ','), CAST(t AS STRING)))) / {sizes}[t] AS share))"
    )
    ranked = hits.select(
        "doc_id", "n_paragraphs", "n_scored",
        F.expr(
            f"transform(scored, y -> struct(y.line AS line, y.stop AS stop, {logits} AS z, {shares} AS shares))"
        ).alias("scored"),
    )
    best = f"transform(sequence(0, {n - 1}), f -> coalesce(array_max(transform(filter(y.shares, s -> s.family = f), s -> s.share)), 0D))"
    likeliest = ranked.select(
        "doc_id", "n_paragraphs", "n_scored",
        F.expr(
            f"transform(scored, y -> struct(y.stop AS stop, -y.line AS back, {best} AS shares, y.z AS z, "
            f"CAST(array_position(slice(y.z, 2, {n - 1}), array_max(slice(y.z, 2, {n - 1}))) AS INT) AS family))"
        ).alias("scored"),
    )
    # Against the sum of all other classes.
    others = "aggregate(y.z, 0D, (s, v) -> s + exp((v - y.z[y.family]) / 1000D)) - 1D"
    chosen = likeliest.select(
        "doc_id", "n_paragraphs", "n_scored",
        F.expr(
            "transform(scored, y -> struct(y.stop AS stop, y.back AS back, y.shares AS shares, y.family AS family, "
            f"CAST(round(1000 / (1 + exp({model.scale!r}D * ln(greatest({others}, 1e-12D)) - ({model.shift!r}D)))) AS INT) AS p))"
        ).alias("scored"),
    )
    # By last line, then the shortest first.
    good = chosen.withColumn(
        "good",
        F.expr(
            f"array_sort(filter(scored, y -> y.family > 0 AND y.p >= {round(1000 * settings.probability)} AND "
            f"y.shares[y.family] >= {settings.share}D))"
        ),
    ).drop("scored")
    # Windows that hold one are among the next lines * lines; what it shares with their family tells it from a neighbour.
    stronger = (
        f"exists(slice(good, k + 2, {settings.lines**2}), o -> o.back >= x.back AND o.family != x.family AND "
        f"o.shares[o.family] > x.shares[x.family] AND x.shares[o.family] >= {settings.share / 2}D)"
    )
    own = good.withColumn(
        "own",
        F.expr(
            f"transform(filter(good, (x, k) -> NOT {stronger}), "
            "x -> struct(CAST(-x.back AS INT) AS line, x.stop AS stop, x.family AS family, x.p AS p))"
        ),
    ).drop("good")
    kind = "STRUCT<last: ARRAY<INT>, out: ARRAY<STRUCT<line: INT, stop: INT, family: INT, p: INT>>>"
    found = (
        f"array_sort(aggregate(own, CAST(struct(array_repeat(-1, {n}) AS last, array() AS out) AS {kind}), "
        "(s, x) -> IF(s.last[x.family] < x.line, struct(transform(s.last, (v, f) -> IF(f = x.family, x.stop, v)) AS last, "
        "concat(s.out, array(x)) AS out), s), s -> s.out))"
    )
    # A generator is a boundary: a filter on the result stays above it, where the expressions would otherwise be put in
    # for every mention.
    confirmed = own.select("doc_id", F.expr(f"inline(array(struct(n_paragraphs, n_scored, {found} AS found)))"))
    return confirmed.select(
        "doc_id", "n_paragraphs", "n_scored", F.expr("CAST(size(found) AS BIGINT)").alias("n_notices"),
        F.expr(f"array_join(array_sort(array_distinct(transform(found, y -> {names}[y.family]))), ',')").alias("families"),
        F.expr(f"array_join(transform(found, y -> concat(y.line, ':', {names}[y.family], ':', y.p)), ',')").alias("notices"),
    )
