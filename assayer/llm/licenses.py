"""Licence scan: a trained paragraph classifier with a calibrated unknown class and template confirmation.

DataFrame functions and Spark's own feature and regression classes only. A paragraph is a line. Word n-grams (one and two
words) of the training texts feed a sparse multinomial logistic regression over licence families, ``other`` (notices of
families without a template) and ``none``. A
paragraph without a feature of non-zero weight scores as the intercepts say, which is ``none``, and is skipped exactly. The
probability that a paragraph must reach to count as a licence is calibrated on all paragraphs of the corpus but those that
hold a notice's own words; one that reaches it and is ``other``, or whose family's templates don't confirm it, is unknown. Only the fit
itself takes a sample of rows of ``none`` (from at most SAMPLE documents, by a hash of doc_id).

Defined results: null or empty text has no paragraphs; repeated rows of one doc_id and text get equal rows, one each; a
null doc_id is a value like others; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 300
CONFIRM = 0.5
#: Share of paragraphs without a notice that stay at or below the least probability, and the steps it is counted in.
BELOW, STEPS = 0.999, 100_000
#: Word triples that a part of a notice has at least; shorter ones are held against as many.
PART = 5
#: Public licence notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl-3.0": [
        "licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl-3.0": ["licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl-3.0": ["licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-1.0": ["dedicated to the public domain under CC0 1.0 Universal", "waived all copyright and related rights, CC0 1.0"],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without written permission", "Proprietary and confidential, unauthorized copying is prohibited"],
}
#: Names of public licences that have no template here.
OTHER = (
    "ISC License",
    "Boost Software License, Version 1.0",
    "European Union Public Licence, EUPL version 1.2",
    "EUPL version 1.2",
    "CDDL version 1.0",
    "zlib License",
    "Eclipse Public License, version 2.0",
    "Common Development and Distribution License, version 1.0",
    "Artistic License 2.0",
    "SIL Open Font License, Version 1.1",
    "Python Software Foundation License, version 2",
    "PostgreSQL Licence",
    "Microsoft Public License",
    "Academic Free License, version 3.0",
    "Open Database License",
    "W3C Software Notice and License",
    "University of Illinois Open Source License",
    "IBM Public License, version 1.0",
)
_TERMS = ("Provided under the terms of the {}", "Licensed under the {}", "Released under the {}", "distributed under the terms of the {}", "made available under the {}", "subject to the {}", "The {} applies to this text")
_FRAMES = ("{}", "{}.", "This work is {}.", "This text is {}.", "The content of this page is {}.", "{} (see LICENSE for details)", "Copyright 2020 the authors. {}.", "# {}", "All files here are {}, unless noted otherwise.")
#: Sentences that use the words of notices without being one.
_OTHERS = (
    "You need a driving license to rent a car in this city",
    "The doctor is licensed to practice medicine in two states",
    "The public library reserved a room for the general meeting",
    "Please ask the owner for permission before you copy the key",
    "The software version 2.0 was released in the spring",
    "A version 3 of the plan was published under the old title",
    "MIT is a university in the city of Cambridge",
    "The apache helicopter landed at the foundation of the tower",
    "Creative people often share common rights and duties",
    "Use the source file and the binary forms for the exercise",
    "The license plate of the car was reported to the police",
    "General terms and conditions are met by most people here",
    "The version of the story is subject to the taste of the reader",
    "The terms of the treaty were made available to the press",
)
_STOP = "a all an and any are as at be been but by can for free from had has have he her his i if in is it its may most no not of on one or our part people see she so that the their them then there these they this those to under up use was we were what when which who will with work would you your".split()
_TOKEN = r"[\p{L}\p{N}]+(?:\.\p{N}+)*"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), 0)


def _grams(w: Column, n: int) -> Column:
    at = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def _with_grams(rows: DataFrame) -> DataFrame:
    """Adds ``grams``: the words of ``words`` that are no stop words, and all word pairs.

    Spark's own n-gram class takes the array once a row; a lambda would split the line anew for every word.
    """
    pairs = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows)
    return pairs.withColumn("grams", F.concat(F.array_except("words", F.lit(_STOP)), "pairs")).drop("pairs")


@dataclass
class Model:
    vocabulary: list[str]
    families: list[str]
    regression: LogisticRegressionModel
    least: float

    def keys(self) -> list[str]:
        """For every feature with a weight its rarest word: without one of them a paragraph has no such feature."""
        heavy = abs(self.regression.coefficientMatrix.toArray()).max(axis=0) > 1e-9
        return sorted({max((w for w in g.split(" ") if w not in _STOP), key=len) for g, h in zip(self.vocabulary, heavy, strict=True) if h})


def _training(spark: SparkSession) -> DataFrame:
    rows = [(family, frame.format(t)) for family, some in TEMPLATES.items() for t in some for frame in _FRAMES]
    spelt = sorted({*OTHER, *(t.replace("License", "Licence") for t in OTHER)})
    rows += [("other", said.format(t) + end) for t in spelt for said in _TERMS for end in ("", ".")]
    rows += [("none", frame.format(t)) for t in _OTHERS for frame in _FRAMES if "LICENSE" not in frame]
    return spark.createDataFrame(rows, "family string, text string")


def _lines() -> Column:
    return F.filter(F.split(F.col("text").cast("string"), r"\r?\n"), lambda x: x.rlike(r"[\p{L}\p{N}]"))


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, line: one row a line that holds a word."""
    return documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_lines()).alias("line"))


def _holds_notice(templates: list[tuple[str, list[str]]], w: Column, triples: Column) -> Column:
    """Whether a paragraph of these words and triples holds half of a template, is half made of one, or is a phrase of one."""
    least = F.greatest(F.size(F.array_distinct(triples)), F.lit(PART))
    shares = [F.size(F.array_intersect(F.lit(t), triples)) / F.least(F.lit(len(set(t))), least) >= CONFIRM for _, t in templates]
    whole = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    phrase = [F.contains(F.lit(f" {said} "), whole) for said, _ in templates]
    return F.exists(F.array(*shares, *phrase), lambda x: x)


def _notices(spark: SparkSession) -> list[tuple[str, list[str]]]:
    """Each notice's words in one string, and its word triples; a few dozen rows."""
    w = words(F.col("t"))
    texts = [*(t for some in TEMPLATES.values() for t in some), *(_TERMS[1].format(t) for t in OTHER)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return [(r["said"], r["triples"]) for r in rows.select(F.array_join(w, " ").alias("said"), _grams(w, 3).alias("triples")).collect()]


def _scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash, line, words, p: paragraphs that hold a key, with the probabilities of ``none`` and the families."""
    held = paragraphs(documents).withColumn("words", words(F.col("line"))).where(F.arrays_overlap("words", F.lit(model.keys())))
    counts = CountVectorizerModel.from_vocabulary(model.vocabulary, "grams", "features").setBinary(True)
    scored = model.regression.transform(counts.transform(_with_grams(held)))
    return scored.select("doc_id", "text_hash", "line", "words", vector_to_array("probability").alias("p"))


def calibrated(documents: DataFrame, model: Model) -> float:
    """The least probability, over every paragraph of ``documents`` without a notice.

    The others count by step of their probability, STEPS at most, before anything is shuffled. Below a half no step is needed,
    and paragraphs without a key are below it, so those are only counted.
    """
    total = documents.agg(F.sum(F.greatest(F.size(_lines()), F.lit(0)).cast("long")).alias("n")).first()["n"] or 0
    high = _scored(documents, model).withColumn("probability", 1 - F.get("p", 0)).where("probability >= 0.5")
    high = NGram(n=3, inputCol="words", outputCol="threes").transform(high)
    notice = _holds_notice(_notices(documents.sparkSession), F.col("words"), F.col("threes"))
    step = F.when(~notice, F.ceil(F.col("probability") * STEPS)).alias("step")
    seen = {r["step"]: r["n"] for r in high.select(step).groupBy("step").agg(F.count("*").alias("n")).collect()}  # STEPS / 2 rows at most
    total -= seen.pop(None, 0)
    above = 0
    for k in sorted(seen, reverse=True):
        above += seen[k]
        if above > (1 - BELOW) * total:
            return max(0.5, k / STEPS)
    return 0.5


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model:
    spark = documents.sparkSession
    known = _with_grams(_training(spark).select("family", words(F.col("text")).alias("words"))).select("family", "grams")
    ids = documents.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    some = documents.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")  # ``sample`` ids
    line = paragraphs(some).select("line", words(F.col("line")).alias("words"))
    line = NGram(n=3, inputCol="words", outputCol="threes").transform(line).where(~_holds_notice(_notices(spark), F.col("words"), F.col("threes")))
    corpus = line.orderBy(F.xxhash64("line")).limit(10 * sample).select("words")
    corpus = _with_grams(corpus).select(F.lit("none").alias("family"), "grams")
    vocabulary = sorted({g for r in known.collect() for g in r["grams"] if not set(g.split(" ")) <= set(_STOP)})  # of the fixed training texts
    families = ["none", "other", *TEMPLATES]
    rows = known.union(corpus).withColumn("label", F.array_position(F.lit(families), F.col("family")).cast("double") - 1).coalesce(1)
    counts = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features").setBinary(True)
    ready = counts.transform(rows).select("family", "label", "features").cache()
    try:
        regression = LogisticRegression(family="multinomial", regParam=2e-3, elasticNetParam=0.5, maxIter=60, standardization=False).fit(ready)
    finally:
        ready.unpersist()
    model = Model(vocabulary, families, regression, 0.5)
    model.least = calibrated(documents, model)
    return model


def _similarity(spark: SparkSession) -> DataFrame:
    """family, templates: word triples of each notice (its words where it has fewer)."""
    rows = spark.createDataFrame([(f, t) for f, some in TEMPLATES.items() for t in some], "family string, t string")
    w = words(F.col("t"))
    return rows.groupBy("family").agg(F.collect_list(F.when(F.size(w) >= 3, _grams(w, 3)).otherwise(F.array(F.array_join(w, " ")))).alias("templates"))


def classified(documents: DataFrame, model: Model) -> DataFrame:
    """Every paragraph that counts as a licence: doc_id, text_hash, line, family, probability, similarity, confirmed."""
    w = F.col("words")
    scored = _scored(documents, model).withColumn("probability", 1 - F.get("p", 0)).where(F.col("probability") >= model.least)
    best = F.array_max(F.slice("p", 2, len(model.families)))
    scored = scored.withColumn("family", F.get(F.lit(model.families), (F.array_position(F.slice("p", 2, len(model.families)), best)).cast("int")))
    joined = scored.join(F.broadcast(_similarity(documents.sparkSession)), "family", "left")  # a dozen rows; ``other`` has none
    joined = NGram(n=3, inputCol="words", outputCol="threes").transform(joined)
    triples = F.concat("threes", F.array(F.array_join(w, " ")))
    alike = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, triples)) / F.size(F.array_distinct(t))))
    joined = joined.withColumn("similarity", F.coalesce(alike, F.lit(0.0)))
    return joined.select("doc_id", "text_hash", "line", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_licenses, n_unknown, family (of the most probable confirmed one), probability, similarity."""
    model = fit(documents) if model is None else model
    none = F.lit(None).cast("struct<p:double,s:double,family:string>")
    lines = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.greatest(F.size(_lines()), F.lit(0)).cast("long").alias("n"), none.alias("hit"), F.lit(0).alias("unknown"), F.lit(1).alias("copies"))
    hit = F.when(F.col("confirmed"), F.struct(F.col("probability").alias("p"), F.col("similarity").alias("s"), "family"))
    found = classified(documents, model).select("doc_id", "text_hash", F.lit(0).cast("long"), hit, (~F.col("confirmed")).cast("int"), F.lit(0))
    # Rows of one doc_id and text add up the same paragraphs each; they are told apart again by their number.
    out = lines.union(found).groupBy("doc_id", "text_hash").agg(
        F.max("n").alias("n_paragraphs"), F.count("hit").alias("licenses"), F.sum("unknown").alias("unknown"), F.max("hit").alias("hit"), F.sum("copies").alias("copies")
    )
    share = lambda c: F.expr(f"{c} div copies")
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "n_paragraphs", share("licenses").alias("n_licenses"), share("unknown").alias("n_unknown"), F.col("hit.family").alias("family"), F.round("hit.p", 6).alias("probability"), F.round("hit.s", 6).alias("similarity"))
