"""Toxicity by a classifier chain (operator 1).

Categories are predicted one after the other. The linear model of each category sees the
words of a text and the probabilities of all earlier categories. In training, those
probabilities come from models that were fitted on the other folds, so later models learn
from predictions as good, or as bad, as they get on unseen texts. The decision threshold of
each category is chosen on its out-of-fold probabilities too.

Fitting is Spark's logistic regression on a bounded sample of labelled rows; features are the
words that part some category from the rest best. Scoring is one pass over the texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import materialise, table

#: The same words in training (Java) and scoring (Python): runs of a-z after A-Z are lower-cased, or of code points beyond ASCII.
JAVA_WORDS = r"[^a-z\x{80}-\x{10FFFF}]+"
_find = re.compile("[a-z\x80-\U0010ffff]+").findall


@dataclass(frozen=True)
class ChainRules:
    """max_rows: labelled rows that a fit uses, about, drawn by a hash. features: words kept.
    min_rows: a word in fewer rows is no feature. folds: of the out-of-fold predictions."""

    max_rows: int = 12_000
    features: int = 1_500
    min_rows: int = 5
    folds: int = 3
    strength: float = 0.001
    rounds: int = 30


@dataclass(frozen=True)
class Chain:
    """The fitted chain; weights[k] has the word weights of category k, links[k] those of earlier categories."""

    categories: tuple[str, ...]
    vocabulary: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    links: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    thresholds: tuple[float, ...]


def _words(col: str):
    lower = F.translate(F.coalesce(F.col(col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.filter(F.split(lower, JAVA_WORDS), lambda w: w != ""))


def fit_chain(labelled: DataFrame, categories: tuple[str, ...], text_col: str = "text", rules: ChainRules = ChainRules()) -> Chain:
    """Fits the chain, in the order of ``categories``, to rows with a text and 0/1 labels.

    Rows with a null text or label are ignored. A category with one value only gets a
    constant model. Sample, folds and order of words are fixed by hashes, so reruns agree.
    """
    ids = F.xxhash64(text_col)
    rows = labelled.select(ids.alias("h"), F.col(text_col).alias("text"), *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]).na.drop()
    share = min(1.0, rules.max_rows / max(1, rows.count()))
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < share * 1_000_000)
    sample = materialise(sample.select(F.pmod(F.xxhash64("h"), F.lit(rules.folds)).alias("fold"), *[f"y{k}" for k in range(len(categories))], _words("text").alias("words")), "toxicity-sample")
    n = sample.count()
    positives = sample.agg(*[F.sum(f"y{k}") for k in range(len(categories))]).first()
    # log odds of a word in a category against the rest, in standard errors
    seen = sample.select("*", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.sum(f"y{k}").alias(f"p{k}") for k in range(len(categories))]).where(F.col("n") >= rules.min_rows)
    best = F.lit(0.0)
    for k in range(len(categories)):
        p = float(positives[k] or 0)
        a, b = F.col(f"p{k}") + 0.5, F.col("n") - F.col(f"p{k}") + 0.5
        c, d = F.lit(p + 1.0) - F.col(f"p{k}"), F.lit(n - p + 1.0) - F.col("n") + F.col(f"p{k}")
        best = F.greatest(best, F.abs(F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)))
    vocabulary = tuple(r["word"] for r in seen.orderBy(F.desc(best), "word").limit(rules.features).collect())
    if not vocabulary:
        k = len(categories)
        return Chain(tuple(categories), (), ((),) * k, tuple((0.0,) * i for i in range(k)), (-20.0,) * k, (0.5,) * k)
    counted = CountVectorizerModel.from_vocabulary(list(vocabulary), "words", "w")
    data = materialise(counted.setBinary(True).transform(sample).drop("words"), "toxicity-features")
    weights, links, intercepts, thresholds = [], [], [], []
    for k in range(len(categories)):
        inputs = ["w", *[f"q{j}" for j in range(k)]]
        ready = VectorAssembler(inputCols=inputs, outputCol="x").transform(data).cache()
        fit = LogisticRegression(featuresCol="x", labelCol=f"y{k}", regParam=rules.strength, maxIter=rules.rounds, standardization=False)
        final = fit.fit(ready)
        beta = final.coefficients.toArray().tolist()
        weights.append(tuple(beta[: len(vocabulary)]))
        links.append(tuple(beta[len(vocabulary) :]))
        intercepts.append(max(-20.0, min(20.0, float(final.intercept))))
        folds = [(f, ready.where(F.col("fold") != f)) for f in range(rules.folds)]
        parts = [fit.fit(train).transform(ready.where(F.col("fold") == f)) for f, train in folds if train.limit(1).count()]
        out = parts[0] if parts else final.transform(ready)
        for part in parts[1:]:
            out = out.unionByName(part)
        data = materialise(out.withColumn(f"q{k}", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction"), "toxicity-folds")
        thresholds.append(best_threshold(data, f"q{k}", f"y{k}"))
        ready.unpersist()
    return Chain(tuple(categories), vocabulary, tuple(weights), tuple(links), tuple(intercepts), tuple(thresholds))


def best_threshold(data: DataFrame, score: str, label: str) -> float:
    """The multiple of 0.01 with the best F1 on out-of-fold scores (the middle of a best stretch)."""
    per = data.groupBy(F.floor(F.col(score) * 100).alias("cut")).agg(F.sum(label).alias("p"), F.count("*").alias("n")).collect()  # 101 rows at most
    total, best = sum(r["p"] for r in per), (0.0, [])
    for cut in range(5, 100):
        p, n = sum(r["p"] for r in per if r["cut"] >= cut), sum(r["n"] for r in per if r["cut"] >= cut)
        f1 = 2 * p / (n + total) if n + total else 0.0
        if f1 > best[0] + 1e-12:
            best = (f1, [cut])
        elif abs(f1 - best[0]) <= 1e-12 and f1 > 0:
            best[1].append(cut)
    return best[1][len(best[1]) // 2] / 100 if best[1] else 0.5


def predict(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, <category>_prob double, <category> boolean for each category) of every row.

    A null or empty text has no words; its probabilities come from the intercepts. Repeated rows and
    null ids come back as they are; other columns aren't read. No shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        place = {w: i for i, w in enumerate(chain.vocabulary)}
        known = frozenset(place)
        per_word = [tuple(w[i] for w in chain.weights) for i in range(len(known))]
        lower = {c: c + 32 for c in range(65, 91)}
        for batch in batches:
            probs = []
            for text in batch.column(1).to_pylist():
                hits = [per_word[place[w]] for w in known.intersection(_find((text or "").translate(lower)))]
                got: list[float] = []
                for k, base in enumerate(chain.intercepts):
                    z = base + sum(h[k] for h in hits) + sum(a * b for a, b in zip(chain.links[k], got, strict=True))
                    got.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
                probs.append(got)
            cols = [pa.array([p[k] for p in probs], pa.float64()) for k in range(len(chain.categories))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *[f"p{k}" for k in range(len(cols))]])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"p{k} double" for k in range(len(chain.categories)))
    out = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, {kinds}")
    both = [c for k, name in enumerate(chain.categories) for c in (F.round(f"p{k}", 6).alias(f"{name}_prob"), (F.col(f"p{k}") >= chain.thresholds[k]).alias(name))]
    return out.select(F.col("id").alias(id_col), *both)


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain low quality, then toxic, of every document, learnt from ``labels``."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    # the sample is drawn before the join, so only its texts are shuffled
    chosen = labels.where("doc_id is not null")
    share = min(1.0, 3 * ChainRules().max_rows / max(1, chosen.count()))
    chosen = materialise(chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000), "toxicity-labels")
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return predict(docs, fit_chain(labelled, ("low_quality", "toxic")))
