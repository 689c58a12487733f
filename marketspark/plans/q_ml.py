"""Model fitting and scoring over labelled hourly bars."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketspark.operators import ml as ML
from marketspark.operators import selection as FSL
from marketspark.operators.series import blocked
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.q_labels import sql_triple
from marketspark.plans.q_quality import FEATS, FT, labelled
from marketspark.plans.registry import query
from marketspark.session import materialize

LAB = f"lt AS ({sql_triple(6, 2.0, 1.0, 'symbol, timeframe, bar_ts, close, volume, target')})"


def data(spark, sf):
    """Features and labels, kept: iterative fits read them many times."""
    return materialize(labelled(spark, sf).rows())


def cut(df):
    at = F.lit("2024-01-22").cast("timestamp_ntz")
    return df.where(F.col("bar_ts") < at), df.where(F.col("bar_ts") >= at)


@query("ml_1_class_weights", f"""WITH {LAB}, c AS (SELECT target, count(*) AS n FROM lt GROUP BY target), w AS (SELECT target, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n) AS w FROM c)
SELECT symbol, bar_ts, target, {q.r6("w * CASE target WHEN 0 THEN 1.5 ELSE 1.2 END * CASE WHEN volume > 5 THEN 2 ELSE 1 END * CASE WHEN close < 150 THEN 1.5 ELSE 1 END")} AS weight FROM lt JOIN w USING (target)""")
def ml_1(spark, sf):
    df = ML.class_weights(data(spark, sf), boost=ML.BOOSTS["directional"], live=F.col("volume") > 5, losing=F.col("close") < 150)
    return df.select("symbol", "bar_ts", "target", F.round("weight", 6).alias("weight"))


@query("ml_2_standard_scaling", f"WITH {FT}, m AS (SELECT avg(body) AS m1, stddev_samp(body) AS s1, avg(rng) AS m2, stddev_samp(rng) AS s2 FROM ft) SELECT symbol, bar_ts, {q.r6('(body - m1) / s1')} AS body_scaled, {q.r6('(rng - m2) / s2')} AS rng_scaled FROM ft, m")
def ml_2(spark, sf):
    b = I.bars(spark, sf).withColumns({"body": F.col("close") - F.col("open"), "rng": F.col("high") - F.col("low")})
    v = VectorAssembler(inputCols=["body", "rng"], outputCol="raw").transform(b)
    out = ML.scaler("standard").fit(v).transform(v).withColumn("v", vector_to_array("features"))
    return out.select("symbol", "bar_ts", F.round(F.col("v")[0], 6).alias("body_scaled"), F.round(F.col("v")[1], 6).alias("rng_scaled"))


@query("ml_2_robust_scaling", f"""WITH {FT}, m AS (SELECT median(body) AS m1, quantile_cont(body, 0.75) - quantile_cont(body, 0.25) AS s1, median(rng) AS m2, quantile_cont(rng, 0.75) - quantile_cont(rng, 0.25) AS s2 FROM ft)
SELECT symbol, bar_ts, {q.r6('(body - m1) / nullif(s1, 0)')} AS body_scaled, {q.r6('(rng - m2) / nullif(s2, 0)')} AS rng_scaled FROM ft, m""")
def ml_2r(spark, sf):
    b = I.bars(spark, sf).withColumns({"body": F.col("close") - F.col("open"), "rng": F.col("high") - F.col("low")})
    return ML.robust_scaled(b, ["body", "rng"]).select("symbol", "bar_ts", F.round("body_scaled", 6).alias("body_scaled"), F.round("rng_scaled", 6).alias("rng_scaled"))


def _learner(name):
    @query(f"ml_3_{name}")
    def run(spark, sf):
        train, test = cut(data(spark, sf))
        model = ML.fit(train if name == "boosted" else ML.class_weights(train), FEATS, name, weight=None if name == "boosted" else "weight")
        return ML.score(model, test, FEATS).select("symbol", "bar_ts", "target", "prediction")
    return run


for _n in ML.LEARNERS:
    _learner(_n)


@query("ml_4_stacking")
def ml_4(spark, sf):
    train, test = cut(data(spark, sf))
    mid = F.lit("2024-01-15").cast("timestamp_ntz")
    base, meta = ML.stack(train.where(F.col("bar_ts") < mid), train.where(F.col("bar_ts") >= mid), FEATS)
    rows, _ = ML.stacked_inputs(base, test, FEATS)
    return meta.transform(rows).select("symbol", "bar_ts", "target", "prediction")


@query("ml_5_walk_forward_evaluation")
def ml_5(spark, sf):
    splits = materialize(FSL.walk_forward_splits(blocked(data(spark, sf)), 3, 50, 25))
    return ML.evaluate_folds(splits, (0, 1, 2), FEATS)


@query("ml_6_batch_scoring")
def ml_6(spark, sf):
    train, test = cut(data(spark, sf))
    return ML.score(ML.fit(ML.class_weights(train), FEATS), test, FEATS).select("symbol", "timeframe", "bar_ts", "p_flat", "p_long", "p_short", "prediction")


@query("fsl_6_select_by_importance")
def fsl_6(spark, sf):
    return ML.importances(ML.fit(data(spark, sf), FEATS, "forest", weight=None), FEATS, spark, 5)
