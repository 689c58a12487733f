"""Shared helpers: tables kept in the shared folder, whole-column word hashing, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.session import scratch_path

#: splitmix64 and polynomial multipliers; any odd 64-bit numbers do
_A, _B, _M, _Q = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: bytes hashed at a time; a longer single word widens the tables
SEGMENT = 1 << 20


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, column-pruned, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffles(spark: SparkSession) -> int:
    """The partition count the session is sized for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a distinct number for each row, the same at every reading of a stored table."""
    return df.withColumn(name, F.monotonically_increasing_id())


def without(docs: DataFrame, rows: DataFrame, small: int = 1_000_000) -> DataFrame:
    """``docs`` less the rows numbered in ``rows`` (row), all columns; broadcast when there are at most ``small``."""
    name = "row"
    while name in docs.columns:
        name += "_"
    return numbered(docs, name).join(bounded(rows.select(F.col("row").alias(name)), small), name, "left_anti").select(*docs.columns)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond that Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with ``table`` (one row for each key); both stored, as they are read more than once.

    Keys that hold more than one in ``4 * shuffle partitions`` of the rows, of which there are at most that many, meet
    by a broadcast; the others by Spark's own choice, where no key is large any more.
    """
    most = 4 * shuffles(rows.sparkSession)
    hot = stash(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * most > rows.count()).select(*keys), "hot-keys")
    few = F.broadcast(table.join(F.broadcast(hot), keys, "left_semi"))
    return rows.join(few, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))


def is_training(doc_id: str, folds: int):
    """False for the held-out rows: crc32 of the id as text divisible by ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds != 0


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_B)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_M))
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _M), ("down", pow(_M, -1, 1 << 64))):
            p = np.full(max(n, SEGMENT), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    if not len(column) or bufs[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(bufs[2], np.uint8), off.astype(np.int64)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and each row's first word.

    A word's hash is a polynomial over random byte values, taken from one running sum over a segment of many
    rows; segments end between words.
    """
    hashes, places = [], []
    lo, top = int(offsets[0]), int(offsets[-1])
    while lo < top:
        hi, span = min(lo + SEGMENT, top), SEGMENT
        while hi < top:  # move to a place between words, else take more
            spaces = np.flatnonzero(_SPACE[buf[lo:hi]])
            row = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            cut = max(row, lo + int(spaces[-1]) + 1 if len(spaces) else lo)
            if cut > lo:
                hi = cut
                break
            span *= 2
            hi = min(lo + span, top)
        b = buf[lo:hi]
        n, word = hi - lo, ~_SPACE[b]
        rows = offsets[np.searchsorted(offsets, lo):np.searchsorted(offsets, hi)] - lo
        s, e = word.copy(), word.copy()
        s[1:] &= ~word[:-1]
        e[:-1] &= ~word[1:]
        s[rows] = word[rows]
        ends = rows[rows > 0] - 1
        e[ends] = word[ends]
        s, e = np.flatnonzero(s), np.flatnonzero(e) + 1
        up, down = _powers(n)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[:n], out=run[1:])
        hashes.append(mix((run[e] - run[s]) * down[s]))
        places.append(s + lo)
        lo = hi
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, np.searchsorted(at, offsets)


def chain(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long hash columns, order mattering."""
    out = np.zeros_like(parts[0])
    for p in parts:
        out = out * np.uint64(_Q) + p
    return mix(out)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles; of fewer words, one of the whole sequence."""
    grams = chain([h[j:len(h) - k + 1 + j] for j in range(k)]) if len(h) >= k else h[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(chain([h[i:i + 1] for i in range(a, b)] + [np.array([b - a], np.uint64)]))
        else:
            out.append(h[:0])
    return out


def slices(batches, column: str, limit: int = 4 << 20):
    """Arrow batches cut into pieces of at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        lens = np.diff(text_buffer(col)[1])
        lo, held = 0, 0
        for i, n in enumerate(lens.tolist()):
            if i > lo and held + n > limit:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < batch.num_rows:
            yield batch.slice(lo)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): for each node of undirected edges the smallest node reachable.

    Every round each node takes the smallest label of its neighbours and itself, then its label's label, so paths
    shorten by doubling. Rounds are kept in the shared folder; only a count of changes comes to the driver.
    """
    e = stash(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), "edges")
    both = e.union(e.select("y", "x"))
    lab = stash(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(lab.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("m"))
        step = lab.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("t"))
        jump = step.join(lab.select(F.col("node").alias("t"), F.col("comp").alias("far")), "t", "left")
        nxt = stash(jump.select("node", "was", F.coalesce("far", "t").alias("comp")), "labels")
        changed = nxt.where("comp <> was").limit(1).count()
        lab = nxt.select("node", "comp")
        if not changed:
            return lab
