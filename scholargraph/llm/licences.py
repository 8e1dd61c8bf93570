"""Licence scan: a trained paragraph classifier with an unknown class, confirmed against templates."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholargraph.operators.lineage import checkpointed

# Statements by which licences are commonly declared, by family.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "This software is distributed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL version 2 or later",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "You can redistribute it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
}
# Statements that speak of a licence which is none of the families.
UNKNOWN = [
    "Licensed under the terms of the company license agreement",
    "All rights reserved. Use is subject to license terms",
    "This file is released under a custom license",
    "See the license for details",
    "Released under the house license",
    "This work is licensed under the terms of the publisher",
    "SPDX-License-Identifier: LicenseRef-Proprietary",
]
# How a licence is named in a line that declares one, by family; the first that matches decides.
NAMES = {
    "LGPL": r"lesser general public|\blgpl\b",
    "GPL": r"gnu general public|\bgpl\b|\bgpl-[123]",
    "Apache-2.0": r"apache licen[cs]e|apache 2\.0|apache-2\.0",
    "MPL-2.0": r"mozilla public|\bmpl\b",
    "BSD": r"\bbsd\b",
    "MIT": r"\bmit\b",
    "CC-BY-NC": r"cc[ -]by-nc|attribution-noncommercial",
    "CC-BY": r"cc[ -]by\b|creative commons attribution",
}
DECLARES = r"licen[cs]ed? |licen[cs]e\b|licen[cs]ed under|released under|distributed under|spdx-license-identifier"
#: What a text that may hold such a line contains, in lower case.
HINTS = ("licen", "spdx", "released under", "distributed under")
# Ways to declare a licence by its name, and the names.
WAYS = [
    "Licensed under {}", "Released under {}", "Distributed under the terms of {}", "This work is licensed under {}",
    "The source code is available under {}", "This file is part of a project under {}", "See {} for the permissions that apply",
]
CALLED = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 license"],
    "MIT": ["the MIT License", "the terms of the MIT license"],
    "GPL": ["the GNU General Public License, version 3", "the GNU GPL v2"],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "the LGPL"],
    "BSD": ["the BSD 3-Clause License", "the simplified BSD license"],
    "MPL-2.0": ["the Mozilla Public License, Version 2.0", "the MPL 2.0"],
    "CC-BY": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "unknown": ["the company license", "the terms of our user agreement", "the license of the publisher", "a proprietary license"],
}
NONE, UNKNOWN_NAME = "none", "unknown"
#: Documents that training lines are taken from, at most, of each kind (with a hint, and any), and lines of each kind.
SAMPLE_DOCUMENTS, SAMPLE_LINES = 1000, 2000
#: One in this many training lines is held out to calibrate the threshold of the unknown class.
CALIBRATION = 4


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Distinct words and adjacent pairs of words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def known_grams(words: Column, vocabulary: list[str]) -> Column:
    """The grams that are in the vocabulary."""
    return F.filter(grams(words), lambda g: g.isin(vocabulary))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row key, pos, grams): one row for each line that has a word."""
    return (
        docs.filter(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "row", "pos", words_of(F.col("line")).alias("words"))
        .filter(F.size("words") > 0)
    )


class LicenceModel:
    """Weights of the vocabulary's grams by class, intercepts, the threshold of the unknown class, and the grams of
    the templates by family."""

    def __init__(self, names, vocabulary, weights, intercepts, threshold):
        self.names, self.vocabulary, self.weights = names, vocabulary, weights
        self.intercepts, self.threshold = intercepts, threshold
        known = set(vocabulary)
        self.templates: list[list[list[str]]] = []
        for variants in TEMPLATES.values():
            found = []
            for text in variants:
                w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
                found.append(sorted(({*w} | {f"{a} {b}" for a, b in zip(w, w[1:])}) & known))
            self.templates.append([g for g in found if g])

    def table(self, spark: SparkSession) -> DataFrame:
        """One row a gram: at most the vocabulary's size, a parameter of fit()."""
        rows = [(g, [float(x) for x in w]) for g, w in zip(self.vocabulary, self.weights)]
        return spark.createDataFrame(rows, "gram string, w array<double>")


def stated_lines() -> list[tuple[str, str]]:
    """(family or unknown, line): the templates, the statements of no family, and every way to name each licence."""
    rows = [(name, text) for name, texts in [*TEMPLATES.items(), (UNKNOWN_NAME, UNKNOWN)] for text in texts]
    rows += [(name, way.format(called)) for name, all_called in CALLED.items() for called in all_called for way in WAYS]
    return sorted(set(rows))


def _sampled_lines(docs: DataFrame, documents: int, lines: int) -> tuple[list, list]:
    """(declaring lines with their families, other lines' grams) of the documents of smallest hash: numbers first, so
    that tasks send no texts that are not taken."""
    low = F.lower("text")
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | low.contains(hint)
    keyed = docs.filter(F.col("text").isNotNull()).select("text", F.xxhash64(F.lit("sample"), "text").alias("h"), hinted.alias("hinted"))
    hashes = checkpointed(keyed.select("h", "hinted"))
    last = [hashes.filter(c).select("h").distinct().orderBy("h").limit(documents).agg(F.max("h").alias("h")).first()["h"] for c in ("hinted", "true")]
    if last[1] is None:
        return [], []
    line = F.trim("line")
    families = F.lit(None).cast("string")
    for name, pattern in reversed(NAMES.items()):
        families = F.when(F.lower("line").rlike(pattern), name).otherwise(families)
    wanted = keyed.filter((F.col("h") <= last[1]) | (F.col("hinted") & (F.col("h") <= (last[1] if last[0] is None else last[0]))))
    every = wanted.select(F.explode(F.split("text", "\n", -1)).alias("line")).select(line.alias("line")).distinct()
    declares = F.lower("line").rlike(DECLARES)
    said = every.filter(declares & (F.length("line") < 400)).select(F.coalesce(families, F.lit(UNKNOWN_NAME)).alias("family"), "line")
    said = said.orderBy(F.xxhash64("line"), "line").limit(lines).collect()
    other = every.filter(~declares & ~F.lower("line").rlike("copyright|" + "|".join(NAMES.values()))).select(F.xxhash64("line").alias("h"), grams(words_of(F.col("line"))).alias("grams")).filter(F.size("grams") > 0)
    cut = other.select("h").orderBy("h").limit(lines).agg(F.max("h").alias("h")).first()["h"]
    plain = other.filter(F.col("h") <= F.lit(cut)).limit(lines).collect() if cut is not None else []
    return [(r["family"], r["line"]) for r in said], [r["grams"] for r in plain]


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES, vocabulary: int = 4096, common: float = 0.005) -> LicenceModel:
    """Trains the classifier on stated lines, on the corpus's own declaring lines and on ordinary lines.

    Declaring lines of the corpus are labelled by the name they give; those that name none are `unknown`. Both samples
    are bounded and only used for fitting. Grams that stand in more than `common` of the ordinary lines tell nothing
    and leave the vocabulary, as do those that the elastic net gives no weight: a line without any of the others
    belongs to `none`. One line in
    CALIBRATION (by hash) takes no part in the fit. The threshold under which a family becomes `unknown` lies halfway
    between the highest probability of a family that 99 % of the held-out lines of no family stay under and the
    probability that 99 % of the held-out lines of a family reach, within 0.5 to 0.95.
    """
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    families = list(TEMPLATES)
    names = [*families, UNKNOWN_NAME, NONE]
    own, plain_grams = _sampled_lines(docs, documents, lines)
    texts = [(float(names.index(f)), t) for f, t in sorted({*stated_lines(), *own})]
    stated = spark.createDataFrame(texts, "label double, text string").select("label", grams(words_of(F.col("text"))).alias("grams"))
    # One line of unknown words stands for all that is unlike any licence, also where the corpus is empty.
    plain = spark.createDataFrame([(float(len(names) - 1), g) for g in [*plain_grams, []]], "label double, grams array<string>")
    often = plain.select(F.explode("grams").alias("g")).groupBy("g").count().filter(F.col("count") > common * max(len(plain_grams), 1)).select("g").collect()
    kept = stated.withColumn("grams", F.array_except("grams", F.lit([r["g"] for r in often]).cast("array<string>")))
    vec = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=vocabulary).fit(kept)
    data = vec.transform(kept.unionByName(plain)).withColumn("weight", F.when(F.col("label") == len(names) - 1, F.lit(0.2)).otherwise(F.lit(1.0)))
    held = (F.pmod(F.xxhash64(F.array_join("grams", "|")), F.lit(CALIBRATION)) == 0) & (F.size("grams") > 0)
    data = data.withColumn("held", held).coalesce(1).cache()
    lr = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=120, weightCol="weight")
    model = lr.fit(data.filter(~F.col("held")))
    scored = model.transform(data.filter("held")).select("label", F.slice(vector_to_array("probability"), 1, len(families)).alias("p"))
    inside = F.col("label") < len(families)
    row = scored.agg(
        F.percentile(F.when(~inside, F.array_max("p")), 0.99).alias("other"),
        F.percentile(F.when(inside, F.get("p", F.col("label").cast("int"))), 0.01).alias("own")).first()
    data.unpersist()
    other, least = row["other"] if row["other"] is not None else 0.0, row["own"] if row["own"] is not None else 1.0
    threshold = min(max((other + max(least, other)) / 2, 0.5), 0.95)
    m = model.coefficientMatrix.toArray().T
    told = [i for i, row in enumerate(m) if row.any()]  # the fit is sparse: most grams weigh nothing
    return LicenceModel(names, [vec.vocabulary[i] for i in told], m[told], [float(x) for x in model.interceptVector], float(threshold))


def scan(docs: DataFrame, model: LicenceModel | None = None, confirm: float = 0.5) -> DataFrame:
    """Licence paragraphs (lines) by document.

    A paragraph's class is the most probable one, of equal ones the first in the model's order; a family whose
    probability is under the model's threshold is `unknown`. A family is confirmed if at least `confirm` of the
    vocabulary grams of one of its templates stand in the paragraph; unconfirmed ones count as `unknown` too. Result:
    doc_id, n_licence (paragraphs of a family or unknown), n_confirmed, families (sorted, comma-joined; empty if
    none), licence (the family of the first confirmed paragraph, else `unknown` or `none`), probability (highest of
    the confirmed, rounded; 0 if none). Null and empty texts have no paragraphs; paragraphs of any length are judged
    whole. Repeated rows get a row each. An empty table gives no rows. Other columns are ignored, whatever their names.

    The words of a line are looked up in the vocabulary where they stand; only lines that have one are taken apart
    into grams, and of these only the vocabulary's become rows and are scored.
    """
    spark = docs.sparkSession
    model = model or fit(docs)
    k, fam = len(model.names), len(TEMPLATES)
    table = model.table(spark)
    # One word of every gram: a single word itself, of a pair one that is a gram too, or else the longer one.
    single = {g for g in model.vocabulary if " " not in g}
    listed = sorted(single | {max(pair, key=len) for g in model.vocabulary if single.isdisjoint(pair := g.split(" "))})
    hits = (
        _paragraphs(docs).filter(F.exists("words", lambda w: w.isin(listed)))
        .select("doc_id", "row", "pos", F.explode(known_grams(F.col("words"), model.vocabulary)).alias("gram"))
        .join(F.broadcast(table), "gram")  # bounded by the vocabulary's size
        .groupBy("doc_id", "row", "pos")
        .agg(*[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(k)], F.collect_set("gram").alias("found"), F.count(F.lit(1)).alias("all"))
    )
    # Rows repeated under one doc_id meet here: each of their grams has come as often as the row stands.
    times = F.col("all") / F.size("found")
    logits = [F.col(f"s{i}") / times + F.lit(model.intercepts[i]) for i in range(k)]
    peak = F.greatest(*logits)
    exps = F.array(*[F.exp(x - peak) for x in logits])
    # Vocabulary grams of each template, as literals: a few dozen short arrays.
    shares = []
    for variants in model.templates:
        parts = [F.size(F.array_intersect("found", F.lit(g))) / F.lit(len(g)) for g in variants]
        shares.append(F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else F.lit(0.0))
    judged = (
        hits.withColumn("e", exps)
        .withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
        .withColumn("p", F.transform("e", lambda x: x / F.col("total")))
        .withColumn("cls", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
        .withColumn("prob", F.array_max("p"))
        .filter(F.col("cls") < k - 1)
        .withColumn("share", F.get(F.array(*shares), "cls"))
        .withColumn("sure", (F.col("cls") < fam) & (F.col("prob") >= model.threshold) & (F.coalesce("share", F.lit(0.0)) >= confirm))
        .withColumn("family", F.when(F.col("sure"), F.get(F.lit(model.names), "cls")).otherwise(UNKNOWN_NAME))
    )
    # The rows of licence paragraphs only; texts repeated under one doc_id are told apart by the row key.
    by_row = judged.groupBy("doc_id", "row").agg(
        F.count_distinct("pos").alias("n_licence"),
        F.count_distinct(F.when(F.col("sure"), F.col("pos"))).alias("n_confirmed"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
        F.coalesce(F.min_by("family", F.when(F.col("sure"), F.col("pos"))), F.lit(UNKNOWN_NAME)).alias("licence"),
        F.max(F.when(F.col("sure"), F.col("prob"))).alias("probability"),
    )
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    return keyed.join(
        by_row.withColumnRenamed("doc_id", "__id").withColumnRenamed("row", "__row"),
        (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left",
    ).select(
        "doc_id",
        F.coalesce("n_licence", F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce("n_confirmed", F.lit(0)).cast("long").alias("n_confirmed"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("licence", F.lit(NONE)).alias("licence"),
        F.coalesce(F.round("probability", 4), F.lit(0.0)).alias("probability"),
    )
