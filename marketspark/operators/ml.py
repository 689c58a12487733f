"""Weights, scaling, classifiers, stacking, walk-forward evaluation and scoring on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.operators.quantiles import exact_quantiles

#: fixed values: extra weight per class (flat, up, down)
BOOSTS = {"none": {}, "directional": {0: 1.5, 1: 1.2, 2: 1.2}, "flat": {0: 4.0, 1: 1.3, 2: 1.3}}


def class_weights(df: DataFrame, label: str = "target", boost: dict[int, float] | None = None, live: Column | None = None, losing: Column | None = None) -> DataFrame:
    """Balanced weight ``n / (k n_c)`` per class times a boost; live rows count double, a losing pattern half more."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rows, classes = counts.agg(F.sum("_n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    w = counts.select(label, (rows / (classes * F.col("_n"))).alias("weight"))
    out = df.join(F.broadcast(w), label)  # one row per class
    x = F.col("weight")
    for c, b in (boost or {}).items():
        x = F.when(F.col(label) == c, x * b).otherwise(x)
    x = x * F.when(live, 2.0).otherwise(1.0) if live is not None else x
    x = x * F.when(losing, 1.5).otherwise(1.0) if losing is not None else x
    return out.withColumn("weight", x)


def scaler(kind: str = "robust", inp: str = "raw", out: str = "features"):
    """``robust`` uses median and quartiles, ``standard`` mean and deviation."""
    if kind == "robust":
        return RobustScaler(inputCol=inp, outputCol=out, withCentering=True, withScaling=True)
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def robust_scaled(df: DataFrame, cols: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """``df`` with each column less its median, over its quartile range, from exact quantiles; null where that is zero."""
    cols = list(cols)
    long = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("_f"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(cols)))))
    cuts = {r["_f"]: r for r in exact_quantiles(long, ["_f"], "_value", {"lo": 0.25, "mid": 0.5, "hi": 0.75}).collect()}  # a row for each column
    none = {"lo": None, "mid": None, "hi": None}
    of = lambda i, k: F.lit((cuts.get(i) or none)[k]).cast("double")
    return df.withColumns({f"{c}{suffix}": F.try_divide(F.col(c) - of(i, "mid"), of(i, "hi") - of(i, "lo")) for i, c in enumerate(cols)})


LEARNERS = {
    "logistic": lambda **k: LogisticRegression(maxIter=k.pop("maxIter", 30), regParam=0.01, **k),
    "forest": lambda **k: RandomForestClassifier(numTrees=k.pop("numTrees", 20), maxDepth=5, seed=7, **k),
    "boosted": lambda **k: OneVsRest(classifier=GBTClassifier(maxIter=k.pop("maxIter", 5), maxDepth=3, seed=7), **k),
}


def fit(df: DataFrame, feats: Sequence[str], learner: str = "logistic", label: str = "target", weight: str | None = "weight", scale: str = "robust", **kw) -> PipelineModel:
    est = LEARNERS[learner](labelCol=label, featuresCol="features", **({"weightCol": weight} if weight else {}), **kw)
    return Pipeline(stages=[VectorAssembler(inputCols=list(feats), outputCol="raw"), scaler(scale), est]).fit(df.fillna(0.0, subset=list(feats)))


def score(model: PipelineModel, df: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Prediction table: class and, where the learner gives them, class probabilities."""
    out = model.transform(df.fillna(0.0, subset=list(feats)))
    if "probability" in out.columns:
        p = vector_to_array("probability")
        out = out.withColumns({"p_flat": p[0], "p_long": p[1], "p_short": p[2]})
    keep = [c for c in out.columns if c not in ("raw", "features", "rawPrediction", "probability")]
    return out.select(*keep)


def importances(model: PipelineModel, feats: Sequence[str], spark, k: int = 30) -> DataFrame:
    """Most important features of a fitted forest."""
    rows = [(f, float(v)) for f, v in zip(feats, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(k)


def stack(train: DataFrame, val: DataFrame, feats: Sequence[str], label: str = "target", learners: Sequence[str] = ("logistic", "forest")) -> tuple[dict[str, PipelineModel], PipelineModel]:
    """Base learners fitted on ``train``, and a logistic model on their probabilities over ``val``."""
    base = {n: fit(train, feats, n, label, weight=None) for n in learners}
    meta_in, cols = stacked_inputs(base, val, feats)
    meta = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), LogisticRegression(labelCol=label, featuresCol="features", maxIter=30)]).fit(meta_in)
    return base, meta


def stacked_inputs(base: dict[str, PipelineModel], df: DataFrame, feats: Sequence[str]) -> tuple[DataFrame, list[str]]:
    df = df.fillna(0.0, subset=list(feats))
    cols = []
    for n, m in base.items():
        p = vector_to_array("probability")
        names = [f"{n}_{i}" for i in range(3)]
        df = m.transform(df).withColumns({c: p[i] for i, c in enumerate(names)}).drop("raw", "features", "rawPrediction", "probability", "prediction")
        cols += names
    return df, cols


def evaluate_folds(splits: DataFrame, folds: Sequence[int], feats: Sequence[str], label: str = "target", learner: str = "logistic") -> DataFrame:
    """Accuracy per fold, overall and per class; each fold fits on its training rows and scores its validation rows."""
    out = None
    for k in folds:
        part = splits.where(F.col("fold") == k)
        model = fit(part.where(F.col("part") == "train"), feats, learner, label, weight=None)
        s = score(model, part.where(F.col("part") == "val"), feats).select("fold", label, "prediction")
        out = s if out is None else out.unionByName(s)
    ok = (F.col("prediction") == F.col(label)).cast("double")
    return out.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(ok).alias("accuracy"),
                                   *(F.avg(F.when(F.col(label) == c, ok)).alias(f"accuracy_{n}") for c, n in enumerate(("flat", "up", "down"))))
