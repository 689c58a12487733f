"""Toxicity: a linear classifier over character n-grams, features scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import _BYTE, _SPACE, bounded, is_training, slices, stash, text_buffer

ORDERS = (4, 5, 6)
#: hashed features; a fixed size for any corpus
BITS = 20
#: features whose counts travel together
_SPAN = 1 << 14
_RUN = 1 << 20


def _grams(buf: np.ndarray, order: int) -> np.ndarray:
    """Feature of the ``order`` bytes that start at each place; A-Z count as a-z and all white space as one."""
    n = len(buf) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    codes = _CODE[buf]
    h = np.zeros(n, np.uint32)
    for j in range(order):
        h = h * np.uint32(0x01000193) + codes[j:j + n]
    h ^= h >> np.uint32(15)
    h = (h + np.uint32(order)) * np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


_CODE = (_BYTE >> np.uint64(32)).astype(np.uint32)
_CODE[_SPACE] = _CODE[32]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by feature, log-count ratio times learnt coefficient; 0: not used
    bias: float


def _rows(batch: pa.RecordBatch, column: str):
    """(row, padded bytes) pieces; texts get a space on both sides, and long ones come in overlapping runs."""
    buf, off = text_buffer(batch.column(column))
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        whole = np.concatenate(([32], buf[a:b], [32])).astype(np.uint8)
        for lo in range(0, max(len(whole) - min(ORDERS) + 1, 1), _RUN):
            yield i, whole[lo:lo + _RUN + max(ORDERS) - 1]


def _sets(batch: pa.RecordBatch, text: str) -> list[np.ndarray]:
    """For each row the sorted distinct features of the whole text."""
    found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
    for i, piece in _rows(batch, text):
        found[i].append(np.unique(np.concatenate([_grams(piece, k) for k in ORDERS])))
    return [np.unique(np.concatenate(x)) if len(x) > 1 else x[0] for x in found]


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(text, label) of all labelled documents whose crc32(doc_id as text) is not divisible by ``folds``.

    A document with several labels counts as toxic when one says so; rows without label or id are left out.
    """
    y = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    y = y.where(is_training("doc_id", folds))
    return docs.select("doc_id", "text").join(bounded(y, 1_000_000), "doc_id").select("text", "label")


def feature_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rows by class and feature, rows by class) of all (text, label); the driver gets 2**BITS counts of each class."""
    ddl, width = "at long, n binary", 1 << BITS

    def run(batches):
        n, mass = np.zeros((2, width), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches, "text"):
            for y, own in zip((batch.column("label").to_numpy() > 0).astype(int).tolist(), _sets(batch, "text")):
                n[y, own] += 1
                mass[y] += 1
        if mass.any():
            at = range(0, width, _SPAN)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int64()), pa.array([mass.tobytes(), *(n[:, a:a + _SPAN].tobytes() for a in at)], pa.binary())], names=["at", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("n"))
        return pa.table({"at": table.column("at").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})
    n, mass = np.zeros((2, width), np.int64), np.zeros(2, np.int64)
    for r in rows.mapInArrow(run, ddl).groupBy("at").applyInArrow(add, ddl).collect():
        got = np.frombuffer(r["n"], np.int64).reshape(2, -1)
        if r["at"] < 0:
            mass = got[:, 0]
        else:
            n[:, r["at"]:r["at"] + _SPAN] = got
    return n, mass


def fit(rows: DataFrame, alpha: float = 1.0, least: int = 3, ratio: float = 1.0, c: float = 0.1, rounds: int = 40) -> Model:
    """Learn from every (text, label), read twice.

    r = ln((p + alpha) / |p|) - ln((q + alpha) / |q|) over documents that hold a feature, per class; features in
    at least ``least`` documents with \\|r\\| >= ``ratio`` form the input r * presence of a logistic regression (Spark's,
    fitted on distributed rows), its strength ``c`` of the L2 penalty on standardless inputs. With one class only, the
    score is that class's share. Only chosen features of a text are stored.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    (q, p), mass = feature_counts(rows)
    width = 1 << BITS
    if not mass[0] or not mass[1]:
        return Model(np.zeros(width, np.float32), 4.0 if mass[1] else -4.0)

    r = np.log((p + alpha) / (mass[1] + 2 * alpha)) - np.log((q + alpha) / (mass[0] + 2 * alpha))
    known = np.flatnonzero((p + q >= least) & (np.abs(r) >= ratio))
    scale, place = r[known], np.full(width, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    sc = rows.sparkSession.sparkContext
    places, scales = sc.broadcast(place), sc.broadcast(scale)

    def chosen(batches):
        for batch in slices(batches, "text"):
            found: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
            for i, piece in _rows(batch, "text"):
                own = places.value[np.concatenate([_grams(piece, k) for k in ORDERS])]
                found[i].append(own[own >= 0])  # few are chosen: distinct ones are sought among these
            sets = [np.unique(np.concatenate(x)) for x in found]
            off = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            label = pa.array((batch.column("label").to_numpy() > 0).astype(float))
            yield pa.RecordBatch.from_arrays([label, pa.ListArray.from_arrays(off, pa.array(np.concatenate(sets)))], names=["label", "at"])
    x = stash(rows.mapInArrow(chosen, "label double, at array<int>"), "toxic-train")
    many = len(known)

    @F.udf(VectorUDT())
    def scaled(at):
        at = np.asarray(at, np.int32)
        return Vectors.sparse(many, at, scales.value[at])
    model = LogisticRegression(maxIter=rounds, regParam=c, elasticNetParam=0.0, standardization=False).fit(x.select("label", scaled("at").alias("features")))
    w = np.zeros(width, np.float32)
    w[known] = scale * model.coefficients.toArray()
    return Model(w, float(model.intercept))


def _scores(batch: pa.RecordBatch, text: str, w: np.ndarray, bias: float) -> np.ndarray:
    used = w != 0
    hits: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
    for i, piece in _rows(batch, text):
        for k in ORDERS:
            g = _grams(piece, k)
            g = g[used[g]]
            if len(g):
                hits[i].append(g)
    z = np.array([bias + (float(w[np.unique(np.concatenate(x))].sum(dtype=np.float64)) if x else 0.0) for x in hits])
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` in 0 to 1 of the whole text in place of the text; null and empty texts get the bias's.

    A feature counts once however often it occurs. The model travels as a broadcast of 2**BITS floats.
    """
    keep = [c for c in docs.columns if c != text]
    shared, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches):
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_scores(batch, text, shared.value, bias), pa.float64())], names=[*keep, "score"])
    return docs.mapInArrow(run, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes if n != text), "score double"]))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    shared, bias = docs.sparkSession.sparkContext.broadcast(model.weights), model.bias

    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(_scores(batch, text, shared.value, bias) < threshold))
    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, whole texts; held out: not learnt from.

    Labels, lang, source and doc_id are no inputs of a score. Repeated rows score alike; an empty table gives no rows,
    and without usable labels every score says not toxic.
    """
    model = fit(training_rows(docs, labels, folds), **options)
    s = score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", (~is_training("doc_id", folds)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
