"""Sentiment per symbol from whole texts: keyword match, word scores, means per source, weighted total.

Keyword and score tables are small and fixed, so both are looked up inside the row: a text is read
once, in full, and only its score and symbols leave the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: words that name a symbol
KEYWORDS = {
    "XAUUSD": ("gold", "xau", "precious metals"),
    "XAGUSD": ("silver", "xag", "precious metals"),
    "EURUSD": ("euro", "eur", "european central bank", "ecb"),
    "GBPUSD": ("pound", "gbp", "sterling", "bank of england"),
    "AUDUSD": ("aussie", "aud", "australian dollar", "rba"),
    "NZDUSD": ("kiwi", "nzd", "new zealand dollar", "rbnz"),
}

#: word scores of our own
LEXICON = {
    "gain": 1.0, "gains": 1.0, "rise": 1.0, "rises": 1.0, "rally": 1.0, "strong": 1.0, "surge": 1.0, "bullish": 1.0, "good": 0.5, "up": 0.5, "growth": 0.5,
    "loss": -1.0, "losses": -1.0, "fall": -1.0, "falls": -1.0, "drop": -1.0, "weak": -1.0, "crash": -1.0, "bearish": -1.0, "bad": -0.5, "down": -0.5, "risk": -0.5,
    "worthless": -1.0, "trouble": -1.0,
}

#: fixed values: weight of a text by kind of source, and the bounds of a lean
SOURCE_WEIGHT = {"news": 0.6, "social": 0.4}
LEAN = 0.2


def polarity(low: Column, scores: Mapping[str, float]) -> Column:
    """Mean score of the scored words of a lower-case text; 0 without any. One pass finds just those, as whole words."""
    words = "|".join(sorted(scores, key=len, reverse=True))
    first = "".join(sorted({w[0] for w in scores}))
    found = F.regexp_extract_all(low, F.lit(f"(?=[{first}])(?<![a-z])(?:{words})(?![a-z])"), F.lit(0))
    table = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
    return F.coalesce(F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, w: a + table[w]), F.size(found)), F.lit(0.0))


def symbols_in(low: Column, keywords: Mapping[str, Sequence[str]]) -> Column:
    """Symbols any of whose keywords occurs in the lower-case text."""
    def found(words):
        c = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            c = c | F.contains(low, F.lit(w))
        return c
    return F.array_compact(F.array(*(F.when(found(ws), F.lit(s)) for s, ws in keywords.items())))


def sentiment_by_symbol(texts: DataFrame, kind: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS, scores: Mapping[str, float] = LEXICON) -> DataFrame:
    """Mean polarity of non-neutral texts per symbol and source kind, weighted total and lean."""
    t = texts.select(F.lower("text").alias("low"), kind.alias("kind"))  # once per text, not once per word
    t = t.select("low", "kind", symbols_in(F.col("low"), keywords).alias("symbols")).where(F.size("symbols") > 0)
    t = t.select(polarity(F.col("low"), scores).alias("p"), "kind", "symbols")
    # neutral texts are left out inside the aggregate: a filter on the score would be pushed down and score every text twice
    is_ = lambda k: (F.col("kind") == k) & (F.col("p") != 0)
    g = t.withColumn("symbol", F.explode("symbols")).groupBy("symbol").agg(
        *(F.count_if(is_(k)).alias(f"{k}_count") for k in SOURCE_WEIGHT),
        *(F.coalesce(F.avg(F.when(is_(k), F.col("p"))), F.lit(0.0)).alias(f"{k}_sentiment") for k in SOURCE_WEIGHT))
    g = g.where(sum((F.col(f"{k}_count") for k in list(SOURCE_WEIGHT)[1:]), F.col("news_count")) > 0)
    w = {k: F.col(f"{k}_count") * v for k, v in SOURCE_WEIGHT.items()}
    total = sum((F.col(f"{k}_sentiment") * w[k] for k in list(w)[1:]), F.col("news_sentiment") * w["news"])
    g = g.withColumn("aggregate_sentiment", F.coalesce(F.try_divide(total, w["news"] + w["social"]), F.lit(0.0)))
    a = F.col("aggregate_sentiment")
    return g.withColumn("interpretation", F.when(a > LEAN, "bullish").when(a < -LEAN, "bearish").otherwise("neutral"))
