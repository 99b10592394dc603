"""Quality classifier by co-training: a text view and a metadata view teach each other.

The text view is hashed words of the whole text with marks of its style; the metadata view is what is known of the page
(language, source, length). Each has a logistic regression. It starts from labelled documents. In each round both views score every
unlabelled document; those that one view is sure of get its label and train the other, and what was exchanged in earlier rounds stays. A fit
uses at most ``labelled`` labelled documents and, for each view, class and round, at most about ``added`` exchanged ones, in the proportion of the
labels; both are taken by hash of the doc_id, so evenly over sources and languages. Nothing else is bounded. At the end a held-out part of the
labels calibrates each view (Platt scaling) and combines them, and all documents are scored.

Features are made once and written to the shared folder. A document is good when its labels say quality 1 and toxic 0 (a null toxic is 0).

Null and empty texts are scored by their marks and metadata; null metadata is a value of its own. Labels of ids that occur more than once
are averaged (0.5 counts as good). Repeated rows get equal scores. With no labels, or labels of one class, the score is that of the class
(0.5 without any). Extra columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled, words, written

TEXT_FEATURES, META_FEATURES, STYLE_FEATURES = 1 << 12, 1 << 9, 7


def _style(text: Column, w: Column) -> Column:
    """Marks of style between 0 and 1, one for repetition, symbols, capitals, digits, and length."""
    n, chars = F.greatest(F.size(w), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    less = lambda p: 1 - F.length(F.regexp_replace(text, p, "")) / chars
    return F.array(
        1 - F.size(F.array_distinct(w)) / n, less("[#*$%&|<>]+"), less("[A-Z]+"), less("[0-9]+"), less("[.!?]+"), F.least(F.log1p(F.size(w)) / 10, F.lit(1.0)),
        (F.size(w) < 20).cast("double"),
    )


def views(docs: DataFrame) -> DataFrame:
    """doc_id with the features of both views; docs(doc_id, text, lang, source, n_chars)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = lambda name: F.concat(F.lit(f"{name}="), F.coalesce(F.col(name).cast("string"), F.lit("?")))
    size = F.concat(F.lit("size="), F.floor(2 * F.log2(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(1)))).cast("string"))
    meta = F.array(known("lang"), known("source"), size, F.concat_ws("|", known("lang"), known("source")), F.concat_ws("|", known("lang"), size))
    rows = docs.select("doc_id", text.alias("text"), meta.alias("meta")).withColumn("w", words(F.col("text")))
    rows = rows.select("doc_id", "meta", "w", array_to_vector(_style(F.col("text"), F.col("w"))).alias("style"))
    rows = HashingTF(numFeatures=TEXT_FEATURES, binary=True, inputCol="w", outputCol="words").transform(rows)
    rows = VectorSizeHint(inputCol="style", size=STYLE_FEATURES, handleInvalid="optimistic").transform(rows)
    rows = VectorAssembler(inputCols=["style", "words"], outputCol="text_view").transform(rows)
    return HashingTF(numFeatures=META_FEATURES, binary=True, inputCol="meta", outputCol="meta_view").transform(rows).select("doc_id", "text_view", "meta_view")


def _margin(raw: str) -> Column:
    return F.get(vector_to_array(raw), F.lit(1))


class CoTraining:
    """Two fitted views with their calibration."""

    VIEWS = ("text", "meta")

    def __init__(self, docs: DataFrame, labels: DataFrame, labelled: int = 12_000, added: int = 1_000, rounds: int = 3, confidence: float = 0.9):
        good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
        label = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg(good) >= 0.5).cast("double").alias("label"))
        h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 30))
        self.rows = written(views(docs).withColumn("h", h), "cotraining-views")
        n = max(label.count(), 1)
        # about so many labelled documents, by hash
        chosen = written(label.withColumn("h", h).where(F.col("h") < (1 << 30) * min(1.0, labelled / n)), "cotraining-labels")
        known = self.rows.drop("h").join(F.broadcast(chosen), "doc_id").withColumn("held", F.pmod("h", F.lit(4)) == 0)
        known = written(known.dropDuplicates(["doc_id"]).coalesce(2), "cotraining-known")
        counts = {r["label"]: r["n"] for r in known.where("not held").groupBy("label").agg(F.count("*").alias("n")).collect()}
        self.constant, self.exchanged = None, []
        if len(counts) < 2:
            self.constant = next(iter(counts), 0.5)
            return
        own = known.where("not held").select("text_view", "meta_view", "label", F.lit(1.0).alias("weight"))
        extra: dict[str, list[DataFrame]] = {v: [] for v in self.VIEWS}
        self.models = {v: self._fit(own, v) for v in self.VIEWS}
        for k in range(rounds):
            p = {v: F.col(f"{v}_p") for v in self.VIEWS}
            scored = self._margins(self.rows.where("doc_id is not null")).select("doc_id", "h", *[(1 / (1 + F.exp(-F.col(f"{v}_margin")))).alias(f"{v}_p") for v in self.VIEWS])
            # labelled documents go after the scoring, so that scores are shuffled for it, not features
            scored = written(settled(scored).join(label.select("doc_id"), "doc_id", "left_anti"), "cotraining-scores")
            sure = {(v, c): (p[v] >= confidence if c else p[v] <= 1 - confidence) for v in self.VIEWS for c in counts}
            found = scored.agg(*[F.count(F.when(s, True)).alias(f"{v}{c}") for (v, c), s in sure.items()]).first()
            self.exchanged.append({key: found[k] for k, key in enumerate(sure)})
            # the rounds take different parts of the hash, so that each adds documents
            place = F.pmod(F.col("h") + k * (1 << 30) // rounds, F.lit(1 << 30))
            parts = {(v, c): s & (place < int((1 << 30) * min(1.0, max(1, added * counts[c] / sum(counts.values())) / max(self.exchanged[-1][v, c], 1)))) for (v, c), s in sure.items()}
            labels_of = [F.when(parts[v, 1.0], 1.0).when(parts[v, 0.0], 0.0).alias(f"{v}_says") for v in self.VIEWS]
            few = scored.select("doc_id", *labels_of).where("text_says is not null or meta_says is not null").dropDuplicates(["doc_id"])
            few = written(self.rows.drop("h").join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"]).coalesce(2), "cotraining-extra")  # some times ``added`` rows
            for v, other in (("text", "meta"), ("meta", "text")):
                extra[other].append(few.where(f"{v}_says is not null").select("text_view", "meta_view", F.col(f"{v}_says").alias("label"), F.lit(0.5).alias("weight")))
            self.models = {v: self._fit(reduce(DataFrame.unionByName, extra[v], own), v) for v in self.VIEWS}
        margins = self._margins(known.where("held")).select("label", *[f"{v}_margin" for v in self.VIEWS])
        margins = written(margins, "cotraining-held")
        self.platt = {v: self._platt(margins, [f"{v}_margin"]) for v in self.VIEWS}
        self.combined = self._platt(margins, [f"{v}_margin" for v in self.VIEWS])

    @staticmethod
    def _fit(rows: DataFrame, view: str):
        return LogisticRegression(featuresCol=f"{view}_view", weightCol="weight", regParam=0.02, maxIter=20).fit(rows.coalesce(2)).setFeaturesCol("features")

    @staticmethod
    def _platt(rows: DataFrame, columns: list[str]) -> tuple[list[float], float]:
        if rows.select("label").distinct().count() < 2:
            return [1.0 / len(columns)] * len(columns), 0.0
        model = LogisticRegression(featuresCol="f", regParam=1e-3, maxIter=50).fit(VectorAssembler(inputCols=columns, outputCol="f").transform(rows))
        return model.coefficients.toArray().tolist(), float(model.intercept)

    def _margins(self, rows: DataFrame) -> DataFrame:
        for v in self.VIEWS:
            rows = self.models[v].transform(rows.withColumnRenamed(f"{v}_view", "features")).withColumn(f"{v}_margin", _margin("rawPrediction"))
            rows = rows.drop("features", "rawPrediction", "probability", "prediction")
        return rows

    @staticmethod
    def _sigmoid(platt: tuple[list[float], float], columns: list[str]) -> Column:
        z = F.lit(platt[1])
        for c, name in zip(platt[0], columns, strict=True):
            z = z + c * F.col(name)
        return F.round(1 / (1 + F.exp(-z)), 6)

    def score(self) -> DataFrame:
        """Per row of the documents: doc_id, text_score, meta_score and score, the probability of good quality."""
        if self.constant is not None:
            return self.rows.select("doc_id", *[F.lit(float(self.constant)).alias(c) for c in ("text_score", "meta_score", "score")])
        own = [self._sigmoid(self.platt[v], [f"{v}_margin"]).alias(f"{v}_score") for v in self.VIEWS]
        return settled(self._margins(self.rows).select("doc_id", *own, self._sigmoid(self.combined, [f"{v}_margin" for v in self.VIEWS]).alias("score")))


def classify_quality(docs: DataFrame, labels: DataFrame, keep: float = 0.5, **options) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for every row of docs."""
    with scratch(docs.sparkSession):
        scores = written(CoTraining(docs, labels, **options).score(), "cotraining-result", lasting=True)
    return scores.withColumn("kept", F.col("score") >= keep)
