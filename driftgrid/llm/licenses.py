"""Licence scan: a trained paragraph classifier over sparse word n-grams, with a calibrated unknown class, confirmed by templates.

Scoring is in DataFrame functions and Spark's own logistic regression. The training set is built here: licence notices
(the templates, and variants of them with words left out), notices of invented licences and of neighbouring versions that are no family here
(class "unknown"), and a bounded sample of the corpus's own paragraphs that don't speak of a licence (class "none"). A held-out part sets
the temperature that calibrates the probabilities.

A paragraph for which "none" isn't the likeliest class speaks of a licence. It is given the likeliest family when its calibrated probability
reaches ``certain`` and a template of that family confirms it: the template shares enough of its n-grams, the paragraph has all of the
template's marks (version number, clause, suffix and the like), and none that tell another variant. Otherwise it is "unknown".

Every paragraph (a line with a word) of every whole text is scored. Null and empty texts have none. Repeated rows give repeated
results; extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled, sieve, written

#: Notices by which families are granted.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."],
    "Apache-1.1": ["Licensed under the Apache Software License, Version 1.1."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0 Universal."],
}
#: Notices of neighbours that are no family here, and forms for invented names.
NEIGHBOURS = [
    "This work is licensed under the GNU General Public License, version 1.", "This library is licensed under the GNU Library General Public License, version 2.", "Licensed under the Apache License, Version 1.0.",
    "Released under the BSD 4-Clause License.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "Licensed under CC BY 2.0.", "Licensed under CC BY-SA 2.5.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "This program is licensed under the Eclipse Public License, version 2.",
]
INVENTED = ["Orbital", "Harbour Free", "Quiet Commons", "Northern Source", "Vendor", "Sample Code", "Freeware", "Shared Works"]
FORMS = ["Released under the {} License.", "Licensed under the {} License, Version 1.1.", "This work is licensed under the {} Public License.", "All rights reserved. Use is subject to the {} license agreement."]
#: Words that tell a family or variant; numbers are compared without a leading v and trailing zeros.
MARK = r"^(?:v?\d{1,2}(?:\.\d{1,2})*|\d-clause|cc0|by(?:-(?:sa|nc|nd))*|attribution(?:-\p{L}+)*|lesser|library|affero|mit|apache|mozilla|bsd|eclipse)$"
#: Marks that plain prose has too; they don't tell a variant.
COMMON_MARK = r"^(?:[\d.]+|by|attribution|library)$"
NONE, UNKNOWN = "none", "unknown"
CLASSES = [*TEMPLATES, UNKNOWN, NONE]
FEATURES = 1 << 14


def _tokens(text: Column) -> Column:
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda w: F.regexp_replace(w, r"^[.+-]+|[.+-]+$", ""))
    return F.filter(words, lambda w: w != "")


def _ngrams(tokens: Column) -> Column:
    """Words, and pairs of neighbours."""
    pairs = F.when(F.size(tokens) >= 2, F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))).otherwise(F.array().cast("array<string>"))
    return F.concat(tokens, pairs)


def _marks(tokens: Column) -> Column:
    found = F.filter(tokens, lambda w: w.rlike(MARK))
    return F.array_distinct(F.transform(found, lambda w: F.regexp_replace(w, r"^v(?=\d)|(?:\.0)+$", "")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its line, from 0) and its text, for every line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    return lines.where(F.col("line").rlike(r"[\p{L}\p{N}]"))


def sample_paragraphs(docs: DataFrame, sample: int) -> DataFrame:
    """line and h (its hash): about ``sample`` distinct paragraphs at most, those of the smallest hashes.

    The lines are counted first, and a bound on the hash leaves about four times the sample before anything is shuffled.
    """
    lines = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("double"))).first()[0] or 1.0
    share = min(1.0, 4 * sample / lines)
    bound = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    few = paragraphs(docs).select("line", F.xxhash64("line").alias("h")).where(F.col("h") <= bound).distinct()
    return few.orderBy("h", "line").limit(sample)


def training_rows(docs: DataFrame, sample: int = 4000, variants: int = 24) -> DataFrame:
    """line, label and held: the notices with their variants, and at most ``sample`` paragraphs of the corpus, by hash."""
    spark = docs.sparkSession
    fixed = [(t, name) for name, texts in TEMPLATES.items() for t in texts]
    other = [(t, UNKNOWN) for t in [*NEIGHBOURS, *[f.replace("{}", n) for n in INVENTED for f in FORMS]]]
    notices = spark.createDataFrame(fixed + other, "notice string, label string").withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    # marks are never left out, or a variant would be that of another family
    mark = lambda w: _marks(_tokens(w))
    kept = F.filter(F.split("notice", " "), lambda w, i: (F.col("variant") == 0) | (F.size(mark(w)) > 0) | (F.pmod(F.xxhash64(F.col("variant"), w, i), F.lit(8)) > 0))
    notices = notices.select(F.array_join(kept, " ").alias("line"), "label", (F.pmod(F.xxhash64("notice", "variant"), F.lit(4)) == 0).alias("held"))
    plain = sample_paragraphs(docs, sample).where(~F.lower("line").rlike("licen[sc]|copyright|permission|redistribut|rights"))
    plain = plain.select("line", F.lit(NONE).alias("label"), (F.pmod("h", F.lit(4)) == 0).alias("held"))
    return notices.unionByName(plain)


class LicenceModel:
    """A fitted classifier: model over hashed n-grams, and the temperature of its probabilities."""

    def __init__(self, docs: DataFrame, seed_sample: int = 4000):
        label = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1
        lines = written(training_rows(docs, seed_sample).coalesce(2), "licence-training")
        rows = self.features(lines).select("features", label.cast("double").alias("label"), "held")
        fit, held = rows.where("not held"), rows.where("held")
        self.model = LogisticRegression(maxIter=40, regParam=1e-3, family="multinomial").fit(fit)
        raw = vector_to_array("rawPrediction")
        scored = self.model.transform(held).select(raw.alias("raw"), F.col("label").cast("int").alias("label"))
        trials = [0.25 * 2 ** (k / 2) for k in range(13)]
        loss = [F.avg(-F.log(F.greatest(F.lit(1e-12), F.get(self._softmax(F.col("raw"), t), F.col("label"))))).alias(str(k)) for k, t in enumerate(trials)]
        found = scored.agg(*loss).first()
        self.temperature = min(zip([math.inf if x is None else x for x in found], trials))[1]

    @staticmethod
    def features(rows: DataFrame) -> DataFrame:
        """rows(line) with tokens and hashed n-gram features."""
        grams = rows.withColumn("tokens", _tokens(F.col("line"))).withColumn("grams", _ngrams(F.col("tokens")))
        return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(grams).drop("grams")

    @staticmethod
    def _softmax(raw: Column, temperature: float) -> Column:
        top = F.array_max(raw)
        e = F.transform(raw, lambda x: F.exp((x - top) / temperature))
        return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows(line) with tokens, family and probability (calibrated)."""
        scored = self.model.transform(self.features(rows)).drop("features", "probability")
        names = F.array(*map(F.lit, CLASSES))
        found = sieve(scored, F.col("prediction") != CLASSES.index(NONE))  # only what looks like a licence is calibrated
        p = self._softmax(vector_to_array("rawPrediction"), self.temperature)
        return found.withColumn("p", p).select("*", F.get(names, F.col("prediction").cast("int")).alias("family"), F.array_max("p").alias("probability")).drop("rawPrediction", "prediction", "p")


def _confirmed_share(tokens: Column, family: Column) -> Column:
    """The largest share of a template's n-grams that the paragraph has, over the family's templates whose marks fit; 0 if none does."""
    own, marks = _ngrams(tokens), _marks(tokens)

    def share(text: str) -> Column:
        grams, wanted = F.array_distinct(_ngrams(_tokens(F.lit(text)))), _marks(_tokens(F.lit(text)))
        other = F.filter(F.array_except(marks, wanted), lambda w: ~w.rlike(COMMON_MARK))
        fits = (F.size(F.array_except(wanted, marks)) == 0) & (F.size(other) == 0)
        return F.when(fits, F.size(F.array_intersect(own, grams)) / F.size(grams)).otherwise(F.lit(0.0))

    best = [F.when(family == name, F.greatest(*map(share, texts), F.lit(0.0))) for name, texts in TEMPLATES.items()]
    return reduce(lambda a, b: F.coalesce(a, b), [*best, F.lit(0.0)])


def scan_licences(docs: DataFrame, certain: float = 0.5, share: float = 0.6, sample: int = 4000) -> DataFrame:
    """A row for each paragraph of docs(doc_id, text) that grants a licence: doc_id, paragraph, family, predicted, probability, template_share."""
    with scratch(docs.sparkSession):
        model = LicenceModel(docs, sample)
    found = model.predict(paragraphs(docs))
    found = found.withColumn("template_share", _confirmed_share(F.col("tokens"), F.col("family")))
    confirmed = (F.col("probability") >= certain) & (F.col("template_share") >= share)
    rounded = [F.round(c, 6).alias(c) for c in ("probability", "template_share")]
    return settled(found.select("doc_id", "paragraph", F.when(confirmed, F.col("family")).otherwise(UNKNOWN).alias("family"), F.col("family").alias("predicted"), *rounded))
