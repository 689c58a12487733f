"""Language-model scores by a weighted backoff automaton over smoothed word n-grams.

States are the histories of fewer than ``order`` words, the empty one the root; a history's state has an arc for each
word seen after it and a failure arc to the history without its first word. With prior strength K, counts c, the
additive unigram P(w) at the root, and h' the history h without its first word,

    arc h -> w:      log10((c(h w) + K P(w|h')) / (c(h) + K))     failure of h:  log10(K / (c(h) + K))
    root arc w:      log10 P(w),  P(w) = (c(w) + a) / (N + a (V + 1))

so a state's arcs and its failure sum to one over the vocabulary and one unknown word. Taking failure arcs and then an
arc multiplies their weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import chain, is_training, mix, shuffles, stash, text_buffer, word_hashes

ADD, PRIOR = 0.1, 20.0
#: bytes of text whose n-grams are counted, asked for and scored together
CHUNK = 8 << 20
_START, _END = (np.uint64(x) for x in mix(np.array([11, 13], np.uint64)))
_CHUNKS = 20  # a chunk's number is task * 2**_CHUNKS + place
_ROW = 16  # bytes that a row counts besides its text, so that chunks of empty texts end too


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences, byte planes together, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze_counts(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze_counts(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end token after each row's words, and each row's first token."""
    h, bounds = word_hashes(*text_buffer(batch.column("text")))
    at = bounds[1:]  # an end token goes before the next row's first word
    return np.insert(h, at, _END), bounds + np.arange(len(bounds))


def _histories(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each token the one before it in its row; the first has the start token."""
    u = np.empty_like(t)
    u[1:] = t[:-1]
    u[bounds[:-1]] = _START
    return u


def _grams(t: np.ndarray, bounds: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order`` the n-gram that ends at each token; start tokens stand before a row's first."""
    parts = [t]
    for _ in range(order - 1):
        parts.insert(0, _histories(parts[0], bounds))
    return [t, *(chain(parts[order - n:]) for n in range(2, order + 1))]


def _starts(order: int) -> list[np.uint64]:
    """For each length the n-gram of start tokens alone: the history of a row's first token."""
    return [_START, *(chain([np.array([_START])] * n)[0] for n in range(2, order + 1))]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct keys; for hashes sorting is far faster than ``np.unique``, which fills a hash table."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[:len(x)]]


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, the place of each of ``x`` in them)."""
    order = np.argsort(x)
    new = np.append(True, x[order[1:]] != x[order[:-1]])[:len(x)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[order[new]], at


def _asking(grams: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For each length the n-grams of a chunk and, last, its rows' start where that can be a history."""
    return [np.append(g, s) if n < order else g for n, (g, s) in enumerate(zip(grams, _starts(order)), 1)]


def _chunks(batches):
    """(chunk number, record batch) of at most CHUNK bytes (one row at least).

    The rows of the partition alone decide where a chunk ends; how Arrow batches them does not.
    """
    k, held, parts = 0, 0, []
    for batch in batches:
        lo = 0
        for i, n in enumerate((np.diff(text_buffer(batch.column("text"))[1]) + _ROW).tolist()):
            if held and held + n > CHUNK:
                yield _chunk(k, [*parts, batch.slice(lo, i - lo)])
                k, held, parts, lo = k + 1, 0, [], i
            held += n
        parts.append(batch.slice(lo))
    if held:
        yield _chunk(k, parts)


def _chunk(k: int, parts: list[pa.RecordBatch]) -> tuple[int, pa.RecordBatch]:
    parts = [p for p in parts if p.num_rows]
    batch = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    return (batch.column("part")[0].as_py() << _CHUNKS) + k, batch


def _train(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("train").to_numpy(zero_copy_only=False), bool)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_ASKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())])
_TEXTS = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("places", pa.binary())])
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _asked(buckets: int, order: int):
    """First pass: the distinct n-grams of each chunk with their counts in training rows, by range of the key.

    The kind is their length; the start of a row as a history counts once for each row.
    """
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def run(batches):
        for chunk, batch in _chunks(batches):
            t, bounds = _tokens(batch)
            grams, train = _grams(t, bounds, order), _train(batch)
            each = np.repeat(train, np.diff(bounds))
            out = []
            for kind, (g, all_, start) in enumerate(zip(grams, _asking(grams, order), _starts(order)), 1):
                keys, counted = _distinct(all_), np.sort(np.append(g[each], np.full(int(train.sum()) if kind < order else 0, start)))
                n = np.bincount(np.searchsorted(keys, counted), minlength=len(keys))
                cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                out += [(chunk, b, kind, squeeze(keys[i:j]), squeeze_counts(n[i:j])) for b, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
            yield _batch(out, _ASKED)
    return run


def _told(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Second pass, for one range of keys: whole counts, dealt back to each chunk in the order it asked."""
    bucket, kind = (k.as_py() for k in key)
    chunks = table.column("chunk").to_pylist()
    asked = [unsqueeze(k) for k in table.column("keys").to_pylist()]
    keys, n = np.concatenate(asked), np.concatenate([unsqueeze_counts(c) for c in table.column("counts").to_pylist()])
    order = np.argsort(keys)
    new = np.concatenate(([True], np.diff(keys[order]) != 0))
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    back = np.empty(len(keys), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    words = (keys[order][new] != _START) & (kind == 1)
    sums = [(int(total[words].sum()), int((total[words] > 0).sum()))] + [(0, 0)] * (len(chunks) - 1)
    at = np.cumsum([0, *map(len, asked)])
    return pa.Table.from_batches([_batch([(c, bucket, kind, squeeze_counts(back[i:j]), *s) for c, i, j, s in zip(chunks, at, at[1:], sums)], _TOLD)])


def _texts(batches):
    """Third pass, first half: each chunk's rows as places in its sorted distinct tokens."""
    for chunk, batch in _chunks(batches):
        t, bounds = _tokens(batch)
        words, places = _places(t)
        yield _batch([(chunk, batch.column("doc_id").to_pylist(), _train(batch).tolist(), np.diff(bounds).tolist(), squeeze(words), squeeze_counts(places))], _TEXTS)


class Automaton:
    """The states and arcs that one chunk can reach: what its distinct n-grams add to the counts, by length."""

    def __init__(self, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        self.counts, self.prior = counts, prior
        self.known, self.base = counts[0] > 0, np.log10((counts[0] + ADD) / (tokens + ADD * (types + 1)))  # root arcs

    def traverse(self, at: list[np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place in the words, and automaton weights of tokens read left to right, for all rows at once.

        ``at`` has the places of the n-grams that end at each token, by length, and after them, but for the longest,
        that of the rows' start. The state after a token is that of the n-gram that ends there, so the states of all
        places are known from the tokens before them; each place takes its state's arc, or else the failure arc (the
        same with no count) and the weight of the shorter history.
        """
        w = at[0][:bounds[-1]]
        p = 10.0 ** self.base[w]
        for n in range(1, len(at)):
            held = np.roll(at[n - 1], 1)[:bounds[-1]]  # the history: the n-gram that ends one token before
            held[bounds[:-1]] = at[n - 1][-1]
            p = (self.counts[n][at[n][:bounds[-1]]] + self.prior * p) / (self.counts[n - 1][held] + self.prior)
        return w, np.log10(p)


def _scored(tokens: int, types: int, prior: float, order: int):
    """Third pass, second half: build the automaton of a chunk from its counts and run its rows through it."""
    def run(batches):
        counts: dict[int, list[bytes]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] <= order:
                    counts.setdefault(r["kind"], []).append(r["counts"])
                    continue
                words, lengths = unsqueeze(r["words"]), np.array(r["lengths"], np.int64)
                t, bounds = words[unsqueeze_counts(r["places"])], np.concatenate(([0], np.cumsum(lengths)))
                grams = _grams(t, bounds, order)
                at = [_places(x) for x in _asking(grams, order)]
                whole = [np.concatenate([unsqueeze_counts(c) for c in counts.get(k, [])] or [np.zeros(0, np.int64)]) for k in range(1, order + 1)]
                if [len(k) for k, _ in at] != [*map(len, whole)]:
                    raise RuntimeError("the documents were not the same when read again; write them to a table first")
                a = Automaton(whole, tokens, types, prior)
                w, logs = a.traverse([x for _, x in at], bounds)
                at = bounds[:-1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(r["doc_ids"], pa.int64()), pa.array([not x for x in r["train"]]), pa.array(lengths), pa.array(np.add.reduceat(a.known[w].astype(np.int64), at)),
                    pa.array(np.add.reduceat(a.base[w], at)), pa.array(np.add.reduceat(logs, at))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
                counts = {}
    return run


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>", pa.list_(pa.bool_()): "array<boolean>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def score(docs: DataFrame, folds: int = 10, prior: float = PRIOR, order: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    N-grams are of up to ``order`` words. Learns from rows whose crc32(doc_id as text) is not divisible by ``folds``. Null text is empty: one end token.
    Repeated rows count as often as they come; an empty table gives no rows.

    The model is never in one place. Each chunk of documents asks for the n-grams it holds, once each; ranges of keys
    (as many as ``spark.sql.shuffle.partitions``) add up the counts of all chunks and answer every chunk in its own
    order; a chunk builds its part of the automaton from the answers. A common n-gram is one key for each chunk, so
    no range is hot, and memory is a chunk or a range. The documents are read twice, the same columns each time, and
    must be the same (a table on storage); a difference is an error.
    """
    spark = docs.sparkSession
    n = shuffles(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", is_training("doc_id", folds).alias("train"), F.spark_partition_id().cast("long").alias("part"))
    asked = d.mapInArrow(_asked(n, order), _ddl(_ASKED))
    told = stash(asked.groupBy("bucket", "kind").applyInArrow(_told, _ddl(_TOLD)), "lm-counts")
    sums = told.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = int(sums["n"] or 0), int(sums["v"] or 0)
    texts = d.mapInArrow(_texts, _ddl(_TEXTS)).withColumns({"kind": F.lit(order + 1), "bucket": F.lit(0)})
    both = told.select("chunk", "bucket", "kind", "counts").unionByName(texts, allowMissingColumns=True)
    both = both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return both.mapInArrow(_scored(tokens, types, prior, order), _SCORES).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
