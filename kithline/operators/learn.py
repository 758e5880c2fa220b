"""Sampling, classifiers, cross-fitting, pair-text scoring and pseudo-labels."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import with_margins

SENTINEL = -1.0


def hash01(*keys: str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) from integer keys, the same in any SQL engine."""
    out = F.lit(seed).cast("long")
    for k, m in zip(keys, (7919, 104729, 1299709), strict=False):
        out = out + F.col(k) * m
    return F.pmod(out, F.lit(9973)) / F.lit(9973.0)


def split_universes(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Half A or B of each record; a matched q is in the half of its s1."""
    half = lambda c: F.when(hash01(c, seed=42) < 0.5, "A").otherwise("B")
    owner = truth.select(F.col("q").alias("entity_id"), F.col("s1").alias("_owner"))
    return records.join(owner, "entity_id", "left").withColumn("half", half("entity_id")).withColumn("half", F.when(F.col("_owner").isNotNull(), half("_owner")).otherwise(F.col("half"))).drop("_owner")


def sample_mask(pairs: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """All positives and a share of the negatives."""
    return pairs.where((F.col("label") == 1) | (hash01("q", "s1", seed=seed) < rate))


def training_set(pairs: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """The sample with weights that keep the negatives' total."""
    return sample_mask(pairs, rate, seed).withColumn("weight", F.when(F.col("label") == 1, 1.0).otherwise(1.0 / rate))


def with_label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("q", "s1", F.lit(1).alias("label")), ["q", "s1"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def imputed(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls and NaN as a sentinel, as the tree learner takes neither."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(SENTINEL)) for c in features})


def train_gbm(rows: DataFrame, features: list[str], rounds: int = 50, rate: float = 0.08, depth: int = 5, seed: int = 42):
    """Gradient-boosted trees on rows (features, label, optional weight and `valid`)."""
    gbt = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, stepSize=rate, maxDepth=depth, seed=seed, maxBins=256, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=10, validationTol=1e-4)
    if "weight" in rows.columns:
        gbt = gbt.setWeightCol("weight")
    if "valid" in rows.columns:
        gbt = gbt.setValidationIndicatorCol("valid")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), gbt]).fit(imputed(rows, features).withColumn("label", F.col("label").cast("double")))


def predict(models: list, rows: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    """Adds the mean probability of the models."""
    out, base = imputed(rows, features), rows.columns
    for i, m in enumerate(models):
        out = m.transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return out.withColumn(name, mean).select(*[c for c in base if c != name], name)


def importance(model, features: list[str], n: int = 15) -> list[tuple[str, float]]:
    found = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, found, strict=True), key=lambda x: (-x[1], x[0]))[:n]


def crossfit(rows: DataFrame, features: list[str], fold: str = "half", rounds: int = 20, rate: float = 0.3) -> tuple[DataFrame, list]:
    """Out-of-fold probabilities: what A taught scores B, what B taught scores A. rate: share of negatives taken."""
    a, b = (rows.where(F.col(fold) == h) for h in ("A", "B"))
    models = [train_gbm(training_set(x, rate), features, rounds) for x in (a, b)]
    return predict([models[0]], b, features).unionByName(predict([models[1]], a, features)), models


def pair_text(q_text: Column, s1_text: Column) -> Column:
    """3-grams of both texts, marked shared, only left (s1) or only right (q)."""
    a, b = (F.array_distinct(T.trigrams(x)) for x in (s1_text, q_text))
    return F.concat(T.tagged("=", F.array_intersect(a, b)), T.tagged("<", F.array_except(a, b)), T.tagged(">", F.array_except(b, a)))


class PairTextScorer:
    """Default pair-text model: hashed marked 3-grams and a logistic regression."""

    def __init__(self, buckets: int = 1 << 14, iterations: int = 20) -> None:
        self.buckets, self.iterations, self.model = buckets, iterations, None

    def fit(self, rows: DataFrame) -> PairTextScorer:
        lr = LogisticRegression(featuresCol="_x", labelCol="label", maxIter=self.iterations, regParam=0.01)
        tf = HashingTF(inputCol="_t", outputCol="_x", numFeatures=self.buckets)
        self.model = Pipeline(stages=[tf, lr]).fit(self._tokens(rows).withColumn("label", F.col("label").cast("double")))
        return self

    @staticmethod
    def _tokens(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_t", pair_text(F.col("q_text"), F.col("s1_text")))

    def score(self, rows: DataFrame, name: str = "ce") -> DataFrame:
        return self.model.transform(self._tokens(rows)).withColumn(name, vector_to_array("probability")[1]).drop("_t", "_x", "rawPrediction", "probability", "prediction")


def band(pairs: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    return pairs.where(F.col("p").between(lo, hi))


def fill_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """ce (null where not scored), ce_f (p there) and its margin."""
    out = pairs.join(scores.select("q", "s1", "ce"), ["q", "s1"], "left").withColumn("ce_f", F.coalesce("ce", "p"))
    return with_margins(out, ["ce_f"])


def pseudo_labels(pairs: DataFrame, inside: Column, pos: float = 0.97, gap: float = 0.8, neg: float = 0.02, easy: float = 0.05) -> DataFrame:
    """Confident positives, all other rows of their q, and a sample of easy negatives, with labels."""
    from pyspark.sql import Window

    rows = with_margins(pairs, ["p"]).withColumn("_pos", inside & (F.col("p") >= pos) & (F.col("p_margin") >= gap))
    rows = rows.withColumn("_has", F.max(F.col("_pos").cast("int")).over(Window.partitionBy("q")) == 1)
    hard = F.col("_has") & ~F.col("_pos")
    light = inside & (F.col("p") <= neg) & ~hard & (hash01("q", "s1", seed=5) < easy)
    kind = F.when(F.col("_pos"), "positive").when(hard & inside, "hard").when(light, "easy")
    return rows.withColumn("kind", kind).where("kind is not null").select("q", "s1", "p", "kind", (F.col("kind") == "positive").cast("int").alias("label"))


def logloss(p: Column, y: Column) -> Column:
    c = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -F.avg(y * F.log(c) + (1 - y) * F.log(1 - c))
