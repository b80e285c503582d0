"""Licence scans (operator 5) in DataFrame functions only: a trained paragraph classifier.

A paragraph is a block of lines between lines without any letter or digit, so that comment marks neither hide
nor join anything. Its lines are judged, and then all of them together, so that a notice may be wrapped.
What is long is looked at in windows of words that overlap by more than a notice. The features of a window are the words and pairs of words that occur
in notices of a licence family and are rare in other paragraphs. A sparse multinomial logistic regression is
trained on pieces of the notices below, as positives, and a bounded sample of paragraphs of the
corpus, as the class ``none``. A threshold calibrated on paragraphs that were held out turns
doubtful predictions to ``unknown``. Comparison with the notices of the predicted family confirms
a prediction; what a confirmed notice explains is taken out of the window, and the rest is judged again, so
that each of several notices in one window is found.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.tokens import let
from trailmark.llm.workers import stored

#: Usual wordings of licence notices by family.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "proprietary": (
        "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. All rights reserved.",
    ),
}
NONE, UNKNOWN = "none", "unknown"
FAMILIES = (NONE, *NOTICES)

#: Paragraphs of the corpus to train and calibrate on, about.
SAMPLED_PARAGRAPHS = 8_000
PIECE_WORDS = 8  # of a notice that is cut into training pieces
#: Words of a window, and between the starts of two: any notice of up to 25 words lies in one window whole.
WINDOW_WORDS, WINDOW_STEP = 48, 24
RARE = 0.02  # a word in more of the sampled paragraphs than this is no feature
MIN_PROBABILITY = 0.5
CONFIRMED_SHARE = 0.6  # of the word pairs of a notice
HELD_OUT = 0.999  # quantile of held-out paragraphs without a notice that must stay ``none``


class Model(NamedTuple):
    features: list[str]
    weights: list[list[float]]  # per feature, in the order of FAMILIES
    intercepts: list[float]
    threshold: float
    needed: list[str]  # words, one of which any paragraph with a feature has


def words_of(text: Column) -> Column:
    found = F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![\p{N}])")
    return F.filter(found, lambda word: word != "")


def pairs_of(words: Column) -> Column:
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    before = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(before, after, lambda a, b: F.concat(a, F.lit(" "), b))


def grams_of(words: Column) -> Column:
    return F.array_distinct(F.concat(words, pairs_of(words)))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice, words) of the fixed notices."""
    rows = F.array(
        *[
            F.struct(F.lit(family).alias("family"), F.lit(text).alias("notice"))
            for family, texts in NOTICES.items()
            for text in texts
        ]
    )
    table = spark.range(1).select(F.explode(rows).alias("n")).select("n.family", "n.notice")
    return table.withColumn("words", words_of(F.col("notice")))


def paragraphs(text: Column) -> Column:
    """Blocks of lines between lines without a letter or digit."""
    return F.split(F.coalesce(text, F.lit("")), r"\n[^\p{L}\p{N}]*\n")


def windows(words: Column) -> Column:
    """The words of a paragraph in overlapping windows: one, unless there are more than WINDOW_WORDS."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - WINDOW_STEP, F.lit(1)), F.lit(WINDOW_STEP))
    return F.transform(starts, lambda at: F.slice(words, at, F.lit(WINDOW_WORDS)))


def sample_paragraphs(docs: DataFrame, wanted: int = SAMPLED_PARAGRAPHS) -> DataFrame:
    """(place, words) of about ``wanted`` different windows of paragraphs, chosen by hash, from documents
    chosen so."""
    facts = docs.agg(
        F.count("text").alias("docs"), F.sum(F.size(paragraphs(F.col("text")))).alias("blocks")
    ).head()
    share = min(1.0, 2 * wanted / max(facts["blocks"] or 0, 1))
    chosen = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < max(share, 64 / max(facts["docs"], 1)) * (1 << 30))
    blocks = chosen.select(F.explode(paragraphs(F.col("text"))).alias("block")).distinct()
    split = blocks.select(words_of(F.col("block")).alias("all"))
    pieces = split.select(F.explode(windows(F.col("all"))).alias("words")).where(F.size("words") > 0).distinct()
    return pieces.select(F.xxhash64("words").alias("place"), "words").orderBy("place", "words").limit(wanted)


def train(docs: DataFrame, *, sampled: int = SAMPLED_PARAGRAPHS) -> Model:
    """The classifier, from the fixed notices and a bounded sample of paragraphs of ``docs``."""
    spark = docs.sparkSession
    templates = notices(spark)
    pieces = templates.select(
        "family",
        F.explode(
            F.concat(
                F.array("words"),
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.size("words") - PIECE_WORDS + 1, F.lit(1))),
                    lambda at: F.slice("words", at, F.lit(PIECE_WORDS)),
                ),
            )
        ).alias("words"),
    ).distinct()
    marks = templates.select(F.explode(pairs_of(F.col("words"))).alias("pair")).distinct()
    marked = [row["pair"] for row in marks.collect()]
    sample = sample_paragraphs(docs, sampled)
    # A paragraph that shares several word pairs with a notice may be one and is not a negative.
    shared = F.size(F.array_intersect(pairs_of(F.col("words")), _strings(marked)))
    plain = stored(sample.where(shared < 2), "paragraphs")
    negatives = plain.withColumn("held", F.pmod(F.col("place"), F.lit(2)) == 1).select("words", "held").collect()
    known = [row["words"] for row in negatives if not row["held"]]
    held = [row["words"] for row in negatives if row["held"]]

    often: dict[str, int] = {}
    for words in known:
        for word in set(words):
            often[word] = often.get(word, 0) + 1
    common = {word for word, n in often.items() if n > RARE * max(len(known), 50)}
    grams = {row["gram"] for row in pieces.select(F.explode(grams_of(F.col("words"))).alias("gram")).collect()}
    features = sorted(g for g in grams if not set(g.split(" ")) <= common)

    label = F.array_position(_strings(list(FAMILIES)), F.col("family")) - 1
    positive = pieces.select(label.cast("double").alias("label"), grams_of(F.col("words")).alias("grams"))
    negative = plain.where(F.pmod(F.col("place"), F.lit(2)) == 0).select(
        F.lit(0.0).alias("label"), grams_of(F.col("words")).alias("grams")
    )
    rows = positive.unionAll(negative)
    vectors = CountVectorizerModel.from_vocabulary(
        features, inputCol="grams", outputCol="features", binary=True
    )
    table = vectors.transform(rows).select("label", "features")
    sizes = {row["label"]: row["n"] for row in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.lit(1.0)
    for value, n in sizes.items():
        weight = F.when(F.col("label") == value, 100.0 / n).otherwise(weight)
    fitted = LogisticRegression(
        family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60,
        weightCol="weight", standardization=False,
    ).fit(table.withColumn("weight", weight))
    matrix = fitted.coefficientMatrix.toArray()
    intercepts = fitted.interceptVector.toArray().tolist()
    classes, size = matrix.shape
    weights = [
        [float(matrix[c][f]) if c < classes else 0.0 for c in range(len(FAMILIES))] for f in range(size)
    ]
    intercepts = (intercepts + [-50.0] * len(FAMILIES))[: len(FAMILIES)]
    used = [i for i in range(size) if any(weights[i])]
    kept = [features[i] for i in used]
    needed = sorted({word for gram in kept for word in gram.split(" ") if word not in common})
    model = Model(kept, [weights[i] for i in used], intercepts, 0.0, needed)
    return model._replace(threshold=_calibrated(model, held))


def _calibrated(model: Model, held: list[list[str]]) -> float:
    """The probability that all but a thousandth of held-out paragraphs without a notice stay below."""
    place = {feature: i for i, feature in enumerate(model.features)}
    best = []
    for words in held:
        grams = {*words, *map(" ".join, zip(words, words[1:]))}
        scores = list(model.intercepts)
        for gram in grams:
            if gram in place:
                scores = [s + w for s, w in zip(scores, model.weights[place[gram]])]
        top = max(scores)
        powers = [math.exp(s - top) for s in scores]
        best.append(max(powers[1:]) / sum(powers))
    best.sort()
    reached = best[min(len(best) - 1, int(HELD_OUT * len(best)))] if best else 0.0
    return max(MIN_PROBABILITY, min(reached, 0.99))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]) if values else F.array().cast("array<string>")


def scan_licences(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_notices, licences, notices of every row of ``docs`` (doc_id, text).

    ``notices`` has, in order of paragraphs, for each window that holds a feature and is not ``none``: paragraph
    (from 0), line (from 0 in the paragraph), word (where the window starts in the line, from 0), family, probability,
    confirmed. A window has one such entry for each family that is confirmed in it, or one that is not. A
    family in windows that follow each other is one notice, and one that is not confirmed goes where a window that
    overlaps has a confirmed one. Families that no line confirms alone but the lines
    of the paragraph together do come after them, with a null line; they replace what the lines left open. A family below the threshold of the model is ``unknown``. ``licences`` are the confirmed
    families, sorted and joined by commas. A null or empty text is one empty paragraph without
    notice. Repeated rows give repeated rows; an empty table gives none; other columns are not read. Narrow: no shuffle.
    """
    spark = docs.sparkSession
    rows_of_weights = [F.array(*map(F.lit, row)) for row in model.weights]
    weights = F.map_from_arrays(
        _strings(model.features), F.array(*rows_of_weights).cast("array<array<double>>")
    )
    pairs_by_family, all_pairs_by_family = _templates(spark)
    start = F.array(*[F.lit(float(x)) for x in model.intercepts])
    nothing = F.array().cast("array<struct<family:string,probability:double,confirmed:boolean>>")

    def share(grams: Column, family: Column) -> Column:
        """The largest share of a notice's word pairs that the window has."""
        shares = F.transform(
            F.element_at(pairs_by_family, family),
            lambda notice: F.size(F.array_intersect(grams, notice)) / F.size(notice),
        )
        return F.coalesce(F.array_max(shares), F.lit(0.0))

    def judged(grams: Column) -> Column:
        """family, probability of the likeliest class."""
        known = F.filter(grams, lambda gram: gram.isin(model.features))
        scores = F.aggregate(
            known, start, lambda s, gram: F.zip_with(s, F.element_at(weights, gram), lambda a, b: a + b)
        )

        def best(s: Column) -> Column:
            top = F.array_max(s)
            total = F.aggregate(s, F.lit(0.0), lambda sum_, x: sum_ + F.exp(x - top))
            family = F.element_at(_strings(list(FAMILIES)), F.array_position(s, top).cast("int"))
            return F.struct(family.alias("family"), (F.lit(1.0) / total).alias("probability"))

        return let(scores, best)

    def unexplained(grams: Column, family: Column) -> Column:
        """The word pairs that no notice of the family has, and the words that are still part of any."""
        pairs = F.filter(grams, lambda gram: F.contains(gram, F.lit(" ")))
        rest = F.array_except(pairs, F.element_at(all_pairs_by_family, family))
        return let(rest, lambda left: F.concat(left, F.array_distinct(F.split(F.array_join(left, " "), " "))))

    def step(state: Column, _: Column) -> Column:
        """Judge what is left of a window; a confirmed notice is taken out, anything else ends it."""

        def decided(guess: Column) -> Column:
            family = guess["family"]
            sure = guess["probability"] >= model.threshold
            confirmed = sure & (family != NONE) & (share(state["grams"], family) >= CONFIRMED_SHARE)
            entry = F.struct(
                F.when(sure, family).otherwise(UNKNOWN).alias("family"),
                F.round(guess["probability"], 6).alias("probability"),
                confirmed.alias("confirmed"),
            )
            told = confirmed | ((family != NONE) & (F.size(state["found"]) == 0))
            return F.struct(
                F.when(confirmed, unexplained(state["grams"], family))
                .otherwise(F.array().cast("array<string>"))
                .alias("grams"),
                F.when(told, F.concat(state["found"], F.array(entry))).otherwise(state["found"]).alias("found"),
            )

        return F.when(F.size(state["grams"]) == 0, state).otherwise(let(judged(state["grams"]), decided))

    def found_in(words: Column) -> Column:
        first = F.struct(grams_of(words).alias("grams"), nothing.alias("found"))
        rounds = F.sequence(F.lit(1), F.lit(len(NOTICES)))
        return F.aggregate(rounds, first, step, lambda state: state["found"])

    def window_of(words: Column, at: Column) -> Column:
        wanted = F.exists(words, lambda word: word.isin(model.needed))
        return F.struct(
            (at * WINDOW_STEP).cast("bigint").alias("word"),
            F.when(wanted, found_in(words)).otherwise(nothing).alias("found"),
        )

    def new_ones(all_windows: Column) -> Column:
        """Entries that the windows which overlap do not tell as well."""

        def families(window: Column, confirmed: bool) -> Column:
            kept = F.filter(window["found"], lambda e: e["confirmed"] if confirmed else ~e["confirmed"])
            return F.coalesce(F.transform(kept, lambda e: e["family"]), F.array().cast("array<string>"))

        def of_window(window: Column, i: Column) -> Column:
            before, after = F.get(all_windows, i - 1), F.get(all_windows, i + 1)

            def is_new(entry: Column) -> Column:
                sure = ~F.array_contains(families(before, True), entry["family"])
                explained = F.size(F.concat(families(before, True), families(after, True))) > 0
                told = F.array_contains(families(before, False), entry["family"])
                return F.when(entry["confirmed"], sure).otherwise(~explained & ~told)

            return F.transform(
                F.filter(window["found"], is_new),
                lambda entry: F.struct(window["word"].alias("word"), entry.alias("entry")),
            )

        return F.flatten(F.transform(all_windows, of_window))

    def notices_in(words: Column) -> Column:
        return let(F.transform(windows(words), window_of), new_ones)

    def placed(entries: Column, paragraph: Column, line: Column) -> Column:
        return F.transform(
            entries,
            lambda one: F.struct(
                paragraph.cast("bigint").alias("paragraph"),
                line.cast("bigint").alias("line"),
                one["word"].alias("word"),
                one["entry"]["family"].alias("family"),
                one["entry"]["probability"].alias("probability"),
                one["entry"]["confirmed"].alias("confirmed"),
            ),
        )

    def sure_families(entries: Column) -> Column:
        return F.transform(F.filter(entries, lambda e: e["confirmed"]), lambda e: e["family"])

    def of_paragraph(block: Column, paragraph: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            """Notices of single lines, and then those that only the lines together confirm."""
            single = F.flatten(
                F.transform(lines, lambda words, i: placed(notices_in(words), paragraph, i))
            )
            together = F.when(
                F.size(lines) > 1, placed(notices_in(F.flatten(lines)), paragraph, F.lit(None))
            ).otherwise(F.filter(single, lambda _: F.lit(False)))

            def both(pair: Column) -> Column:
                known = sure_families(pair["single"])
                wrapped = F.filter(
                    pair["together"], lambda e: e["confirmed"] & ~F.array_contains(known, e["family"])
                )
                explained = F.size(F.array_except(sure_families(pair["together"]), known)) > 0
                kept = F.filter(pair["single"], lambda e: e["confirmed"] | ~explained)
                return F.concat(kept, wrapped)

            return let(F.struct(single.alias("single"), together.alias("together")), both)

        return let(F.transform(F.split(block, r"\r?\n"), words_of), of_lines)

    blocks = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), paragraphs(F.col("text")).alias("blocks")
    )
    rows = blocks.select(
        "doc_id",
        F.size("blocks").cast("bigint").alias("n_paragraphs"),
        F.flatten(F.transform("blocks", of_paragraph)).alias("notices"),
    )
    families = F.transform(F.filter("notices", lambda p: p["confirmed"]), lambda p: p["family"])
    return rows.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(families)), ",").alias("licences"),
        "notices",
    )


def _templates(spark: SparkSession) -> tuple[Column, Column]:
    """Maps from a family to the different word pairs of each of its notices, and of all of them."""
    pairs: dict[str, list[Column]] = {}
    together: dict[str, set[str]] = {}
    found = notices(spark).select("family", pairs_of(F.col("words")).alias("pairs"))
    for row in found.collect():
        pairs.setdefault(row["family"], []).append(_strings(sorted(set(row["pairs"]))))
        together.setdefault(row["family"], set()).update(row["pairs"])
    names = _strings(list(pairs))
    return (
        F.map_from_arrays(names, F.array(*[F.array(*notice) for notice in pairs.values()])),
        F.map_from_arrays(names, F.array(*[_strings(sorted(of)) for of in together.values()])),
    )
