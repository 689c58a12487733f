"""From class probabilities to signals and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.rolling import div, flag


def edge() -> Column:
    """Gap between the two highest probabilities."""
    top = F.sort_array(F.array(F.col("p_flat"), F.col("p_long"), F.col("p_short")), asc=False)
    return top[0] - top[1]


def signal_from_probs(df: DataFrame) -> DataFrame:
    """A side must beat both others, else flat."""
    long, short = (F.col("p_long") > F.col("p_short")) & (F.col("p_long") > F.col("p_flat")), (F.col("p_short") > F.col("p_long")) & (F.col("p_short") > F.col("p_flat"))
    return df.withColumns({"signal": F.when(long, "long").when(short, "short").otherwise("flat"),
                           "confidence": F.when(long, F.col("p_long")).when(short, F.col("p_short")).otherwise(F.col("p_flat")), "edge": edge()})


def trade_filter(df: DataFrame, min_conf: float, min_edge: float) -> DataFrame:
    """Rows whose top class is a side, sure and clear enough; long is looked at first."""
    top = F.greatest(F.col("p_flat"), F.col("p_long"), F.col("p_short"))
    ok = (edge() >= min_edge) & (top >= min_conf)
    return df.withColumns({"long_signal": flag((F.col("p_long") == top) & ok), "short_signal": flag((F.col("p_long") != top) & (F.col("p_short") == top) & ok)})


def signal_quality(df: DataFrame, min_conf: float, min_edge: float) -> DataFrame:
    """Always a side, with a grade: high when it should be traded, medium when it leans, else low."""
    top = F.greatest(F.col("p_flat"), F.col("p_long"), F.col("p_short"))
    side = F.greatest(F.col("p_long"), F.col("p_short"))
    sig = F.when(F.col("p_flat") == top, "flat").when(F.col("p_long") == top, "long").otherwise("short")
    df = df.withColumns({"signal": sig, "directional_signal": F.when(F.col("p_long") > F.col("p_short"), "long").otherwise("short"),
                         "directional_confidence": side, "edge": edge()})
    trade = (F.col("signal") != "flat") & (top >= min_conf) & (F.col("edge") >= min_edge)
    return df.withColumn("signal_quality", F.when(trade, "high").when((side >= 0.40) & (F.col("edge") >= 0.05), "medium")
                         .otherwise("low"))


#: order that settles ties between sides
VOTE_ORDER = ("long", "short", "flat")


def _winner(scores: dict[str, Column]) -> Column:
    top = F.greatest(*scores.values())
    w = F.when(scores[VOTE_ORDER[0]] == top, VOTE_ORDER[0])
    for s in VOTE_ORDER[1:]:
        w = w.when(scores[s] == top, s)
    return w


def vote_majority(preds: DataFrame, keys=("symbol", "bar_ts")) -> DataFrame:
    """Most models win; ties go long, short, flat; confidence and edge are means."""
    g = preds.groupBy(*keys).agg(*(F.count_if(F.col("signal") == s).alias(f"votes_{s}") for s in VOTE_ORDER),
                                 F.avg("confidence").alias("confidence"), F.avg("edge").alias("edge"),
                                 F.count(F.lit(1)).alias("num_models"))
    return g.withColumn("signal", _winner({s: F.col(f"votes_{s}") for s in VOTE_ORDER}))


def vote_weighted(preds: DataFrame, weight: Column, keys=("symbol", "bar_ts")) -> DataFrame:
    """Sides share the models' weights; the winner's share is the confidence."""
    df = preds.withColumn("_w", weight)
    g = df.groupBy(*keys).agg(F.sum("_w").alias("_t"), F.count(F.lit(1)).alias("num_models"),
                              *(F.sum(F.when(F.col("signal") == s, F.col("_w")).otherwise(0.0)).alias(f"_{s}") for s in VOTE_ORDER))
    g = g.withColumns({f"score_{s}": F.coalesce(div(f"_{s}", "_t"), F.lit(0.0)) for s in VOTE_ORDER})
    sc = {s: F.col(f"score_{s}") for s in VOTE_ORDER}
    top = F.sort_array(F.array(*sc.values()), asc=False)
    return g.select(*keys, "num_models", *(f"score_{s}" for s in VOTE_ORDER), _winner(sc).alias("signal"),
                    top[0].alias("confidence"), (top[0] - top[1]).alias("edge"))


def vote_confidence_weighted(preds: DataFrame) -> DataFrame:
    return vote_weighted(preds, F.col("confidence"))


def vote_performance_weighted(preds: DataFrame, win_rates: DataFrame, on=("symbol", "model")) -> DataFrame:
    """Weight is the model's past win rate (half when unknown) times its confidence."""
    df = preds.join(win_rates.select(*on, "win_rate"), list(on), "left")
    return vote_weighted(df, F.coalesce(F.col("win_rate") / 100, F.lit(0.5)) * F.col("confidence"))


def blend_probs(preds: DataFrame, weights: dict[str, float], keys=("symbol", "bar_ts")) -> DataFrame:
    """Weighted mean of the models' probabilities; models without a weight are left out."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("model")]
    df = preds.withColumn("_w", w).where(F.col("_w").isNotNull())
    return df.groupBy(*keys).agg(*((F.sum(F.col(p) * F.col("_w")) / F.sum("_w")).alias(p) for p in ("p_flat", "p_long", "p_short")))


def confidence_histogram(preds: DataFrame, keys=("symbol", "model"), thresholds=(0.50, 0.55, 0.60, 0.70, 0.80)) -> DataFrame:
    """Share of rows at or above each confidence, mix of predictions, and how selective the model is."""
    n = F.count(F.lit(1))
    g = preds.groupBy(*keys).agg(
        n.alias("rows"), F.avg("confidence").alias("avg_confidence"), F.stddev_pop("confidence").alias("std_confidence"),
        *((F.count_if(F.col("confidence") >= t) * 100.0 / n).alias(f"pct_ge_{round(t * 100)}") for t in thresholds),
        *((F.count_if(F.col("signal") == s) * 100.0 / n).alias(f"pct_{s}") for s in VOTE_ORDER))
    p = F.col("pct_ge_55")
    return g.withColumn("verdict", F.when(p > 80, "not_selective").when(p > 50, "too_frequent").when(p > 20, "moderate")
                        .otherwise("selective"))


def regime_veto(df: DataFrame, bad: list[str]) -> DataFrame:
    """Signals in a bad regime become flat."""
    veto = F.array_contains(F.array(*(F.lit(b) for b in bad)), F.col("regime"))
    return df.withColumns({"vetoed": veto, "final_signal": F.when(veto, "flat").otherwise(F.col("signal"))})
