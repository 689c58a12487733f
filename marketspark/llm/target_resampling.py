"""Target-distribution importance resampling over hashed word windows.

An untrained Split of the tokenizers library cuts the ASCII-lowered text into words with their offsets. Windows of
consecutive offset pairs are the features; their CRC picks a bucket. Documents and target texts are counted by bucket,
a bucket's gain says how much likelier the target makes it, and a document's weight is the mean gain of its windows.
The draw without replacement takes the largest weights after adding Gumbel noise that only the seed and the
identifier decide, so it is the same at every run and partitioning.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import shuffles, slices, stash

#: words: runs of ASCII letters, digits and all characters beyond ASCII
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: characters given to the tokenizer at a time; a longer single word widens the segment
SEGMENT = 1 << 15
_SPLITTERS: dict = {}


def splitter(pattern: str = WORD):
    """The library's Split that keeps what ``pattern`` matches."""
    if pattern not in _SPLITTERS:
        from tokenizers import Regex, pre_tokenizers
        _SPLITTERS[pattern] = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    return _SPLITTERS[pattern]


def _segments(text: str) -> Iterator[tuple[int, str]]:
    """``text`` in pieces that end behind an ASCII blank or line end, where no word can run on, and where they start."""
    lo = 0
    while lo < len(text):
        hi = lo + SEGMENT
        while hi < len(text):
            cut = max(text.rfind(" ", lo, hi), text.rfind("\n", lo, hi)) + 1
            if cut > lo:
                hi = cut
                break
            hi += SEGMENT
        yield lo, text[lo:hi]
        lo = hi


def words(text: str | None, pattern: str = WORD) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The lowered text in segments, each with the offsets of its words (in the segment). A-Z only are lowered."""
    split = splitter(pattern)
    for _, part in _segments((text or "").encode().lower().decode()):
        yield part, [at for _, at in split.pre_tokenize_str(part)]


def hashed(text: str | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every run of 1 to ``longest`` words, repeats included)."""
    n, held, out = 0, [], []
    for part, at in words(text):
        new = [part[a:b].encode() for a, b in at]
        run = held + new  # the last words of the segment before, whose runs may reach into this one
        joined = [b" " + w for w in run]
        sums = [zlib.crc32(w) for w in run]
        for k in range(longest):
            if k:  # a run's CRC goes on from that of the run without its last word
                sums = [zlib.crc32(w, c) for w, c in zip(joined[k:], sums)]
            out.append(np.array(sums[max(len(held) - k, 0):], np.int64) % buckets)
        n += len(new)
        held = run[max(len(run) - longest + 1, 0):] if longest > 1 else []
    return n, np.concatenate(out) if out else np.zeros(0, np.int64)


def _width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(docs: DataFrame, column: str, longest: int, buckets: int, keep: str | None = None) -> DataFrame:
    """(``keep``, n_words, hits): the buckets of every text's runs, packed into bytes."""
    own = [keep] if keep else []

    def run(batches):
        for batch in slices(batches, column):
            found = [hashed(t, longest, buckets) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([n for n, _ in found], pa.int64()),
                                              pa.array([h.astype(_width(buckets)).tobytes() for _, h in found], pa.binary())], names=[*own, "n_words", "hits"])
    return docs.select(*own, column).mapInArrow(run, "".join(f"{c} long, " for c in own) + "n_words long, hits binary")


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """Hits by bucket over all rows: each task adds up its own, so at most ``buckets`` rows a task are shuffled."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for hits in batch.column("hits"):
                total += np.bincount(np.frombuffer(hits.as_buffer(), _width(buckets)), minlength=buckets)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["bucket", "n"])
    rows = found.select("hits").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) (S + B) / ((s + 1) (T + B)))) by bucket, B buckets, in doubles."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + b) / (float(s + 1) * float(t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of sha256(``seed:doc_id``); a null id counts as no text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of ``found`` (doc_id, n_words, hits)."""
    shared, width = found.sparkSession.sparkContext.broadcast(gain), _width(len(gain))

    def run(batches):
        for batch in batches:
            n, weight = [], []
            for hits in batch.column("hits"):
                own = np.frombuffer(hits.as_buffer(), width)
                n.append(len(own))
                weight.append(int(shared.value[own].sum()) // len(own) if len(own) else 0)
            score = [w + noise(i, seed) for w, i in zip(weight, batch.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *(pa.array(c, pa.int64()) for c in (n, weight, score))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])
    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 ... over all of them: ranges of the order, sorted, counted and added up.

    Bounds of ranges are sampled anew at each reading, so the sorted ranges are written once; a count for each range
    is all that is joined.
    """
    spark = rows.sparkSession
    cut = rows.repartitionByRange(shuffles(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    cut = stash(cut.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    before, skip = 0, []
    for r in cut.groupBy("_part").count().orderBy("_part").collect():  # a row for each range
        skip.append((r["_part"], before))
        before += r["count"]
    skips = spark.createDataFrame(skip, "_part long, _skip long")
    return cut.join(F.broadcast(skips), "_part").withColumn("rank", F.col("_skip") + F.col("_at") + 1).drop("_part", "_skip", "_at")


def resample(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of ``docs`` (doc_id, text); ``target`` has a column text.

    Of the N rows with ``least_words`` words or more, floor(``percent`` * N / 100) with the highest scores are drawn and
    ranked by score, ties by the smaller doc_id (null last), then by features and weight; of the rest the rank is null.

    Null and empty texts have no words, weight 0 and are never drawn. Repeated rows are rows of their own, with one
    score. An empty ``target`` gives every bucket the gain of no hits; empty ``docs`` give no rows. Other columns are
    not read. Texts are hashed once, whole; very long ones go through in segments. Only bucket counts and one count for
    each range come to the driver.
    """
    found = stash(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", longest, buckets, "doc_id"), "features")
    gain = gains(histogram(found, buckets), histogram(features(target.select("text"), "text", longest, buckets), buckets))
    rows = stash(scored(found, gain, seed), "scores")
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    x = ranked(rows.where(able), *order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score"]
    return x.select(*names, "rank").union(rows.where(~able).select(*names, F.lit(None).cast("long")))
