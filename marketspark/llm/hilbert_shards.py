"""Sharding by Hilbert-curve order: documents near in several metadata dimensions come to lie in the same run."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.llm.common import shuffles, stash

_LOCAL = (1 << 33) - 1


def hilbert_index(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits``-bit integer coordinates.

    Works on whole columns: undo the excess rotations from the top bit down, Gray-code, and interleave.
    """
    x = [np.asarray(c, np.uint64).copy() for c in coords]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            on = (x[i] >> bit & one).astype(bool)
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> np.uint64(b) & one).astype(bool), np.uint64((1 << b) - 1), np.uint64(0))
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << one | ((c ^ flip) >> np.uint64(b) & one)
    return out


def text_cuts(rows: DataFrame, column: Column, cells: int) -> list[str]:
    """The ``cells - 1`` strings, sorted, at which ``column`` is cut into ``cells`` of about as many rows, by whole strings.

    Values are counted, cut into sorted ranges and added up; of all values only the cuts come to the driver, and a
    count for each range. A value with the rows of several cells is as many cuts, so that the others keep their places.
    """
    spark = rows.sparkSession
    v = rows.select(column.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    v = stash(v.repartitionByRange(shuffles(spark), "v").withColumn("part", F.spark_partition_id()), "values")
    skips, total = [], 0
    for r in v.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        skips.append((r["part"], total))
        total += r["n"]
    if not total:
        return []
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    v = v.withColumn("upto", upto).join(F.broadcast(spark.createDataFrame(skips, "part int, skip long")), "part")
    cell = lambda c: F.floor(c * cells / total)
    end = F.col("skip") + F.col("upto")
    v = v.withColumn("k", F.least(cell(end), F.lit(cells - 1)) - cell(end - F.col("n")))
    return sorted(s for r in v.where("k > 0").select("v", "k").collect() for s in [r["v"]] * r["k"])


def assign(rows: DataFrame, texts: dict[str, Column], dims: dict[str, Column], order: list[str], shards: int, bits: int = 6, accuracy: int = 10_000) -> DataFrame:
    """``rows`` with ``curve``, ``shard`` and ``slot``: runs of the curve order whose counts differ by one at most.

    ``texts`` are string columns, ``dims`` numeric ones (null counts as the smallest). Strings are cut by their whole
    length (:func:`text_cuts`). Each numeric one is cut at 2**bits - 1 quantiles from one mergeable
    sketch, so a value that holds a third of the rows takes a cell of its own and the rest still spreads. Rows sort by
    (curve, ``order``): equal curve places of any number are split between range partitions, no group is kept whole.
    The sorted rows are kept in the shared folder once, so a lost executor cannot change their order.
    """
    if (len(texts) + len(dims)) * bits > 62:
        raise ValueError("the curve index must fit 62 bits")
    spark = rows.sparkSession
    words = [text_cuts(rows, c, 1 << bits) for c in texts.values()]
    r = rows.select("*", *(c.alias(f"_t{i}") for i, c in enumerate(texts.values())), *(F.coalesce(c.cast("double"), F.lit(float("-inf"))).alias(f"_d{i}") for i, c in enumerate(dims.values())))
    at = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = r.agg(*(F.percentile_approx(f"_d{i}", at, accuracy).alias(f"_d{i}") for i in range(len(dims)))).first()
    edges = [np.sort(np.array(c, float)) if c else np.zeros(0) for c in cuts]

    @F.pandas_udf("long")
    def curve(cols: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in cols:
            cells = [s.map(lambda v, w=w: -1 if v is None else bisect_right(w, v)).to_numpy(np.int64) + 1 for w, s in zip(words, batch)]
            cells = [np.minimum(c, (1 << bits) - 1) for c in cells] + [np.searchsorted(e, s.to_numpy(), "right") for e, s in zip(edges, batch[len(words):])]
            yield pd.Series(hilbert_index(cells, bits).astype(np.int64))
    r = r.select(*rows.columns, curve(*(f"_t{i}" for i in range(len(texts))), *(f"_d{i}" for i in range(len(dims)))).alias("curve"))
    r = r.repartitionByRange(shuffles(spark), "curve", *order).sortWithinPartitions("curve", *order)
    r = stash(r.withColumn("_at", F.monotonically_increasing_id()), "curve")
    r = r.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit(_LOCAL))})
    # one row for each partition: as many as tasks, whatever the data
    sizes = r.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    if not sizes:
        return r.select(*rows.columns, "curve", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    start, total = {}, 0
    for s in sizes:
        start[s["_part"]] = total
        total += s["n"]
    offsets = spark.createDataFrame([(int(k), int(v)) for k, v in start.items()], "_part long, _start long")
    r = r.join(F.broadcast(offsets), "_part")
    rank = F.col("_start") + F.col("_in")
    shard = F.expr(f"int((_start + _in) * {shards} div {total})")
    first = F.expr(f"(int((_start + _in) * {shards} div {total}) * {total}L + {shards - 1}) div {shards}")
    return r.select(*rows.columns, "curve", shard.alias("shard"), (rank - first).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = 6) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) for each row of documents.

    Dimensions are source, language, size and identifier. The law is ``rows``: counts differ by one at most, whatever
    the texts. Null text has 0 bytes, null metadata sorts first; repeated rows all stay; empty table, no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    r = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.col("source").alias("_source"), F.col("lang").alias("_lang"))
    texts, dims = {"source": F.col("_source"), "lang": F.col("_lang")}, {"size": F.col("size"), "doc_id": F.col("doc_id")}
    out = assign(r, texts, dims, ["doc_id", "size", "text_crc32"], shards, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(rows: DataFrame, path: str, files: int) -> None:
    """Write the rows of :func:`assign` as ``shard=N`` folders, each file a run of the curve, ``files`` tasks in all."""
    rows.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
