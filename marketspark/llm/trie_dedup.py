"""Exact dedup by Patricia tries: terminal nodes own the smallest identifier of equal texts."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import shuffles, slices, stash, text_buffer

#: bytes of labels a trie holds before a subtree is spilled
BUDGET = 48 << 20
#: what a node costs besides its label
_NODE = 250
_WHITE = bytes([32, *range(9, 14)])


class Trie:
    """A compressed radix trie over byte strings. Nodes are [label, children by first byte, smallest identifier or None]."""

    def __init__(self, budget: int = BUDGET):
        self.root: list = [b"", {}, None]
        self.budget, self.held = budget, 0

    def insert(self, key: bytes, ident: int) -> int:
        """Set the terminal node of ``key`` to the smallest identifier so far, and return it."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = child = [key[at:], {}, None]
                self.held += len(key) - at + _NODE
            elif not key.startswith(child[0], at):
                k = _common(child[0], key, at)
                node[1][key[at]] = upper = [child[0][:k], {child[0][k]: child}, None]
                child[0] = child[0][k:]
                child, self.held = upper, self.held + _NODE
            node, at = child, at + len(child[0])
        node[2] = ident if node[2] is None else min(node[2], ident)
        return node[2]

    def find(self, key: bytes) -> int:
        """The smallest identifier of a string that was inserted."""
        node, at = self.root, 0
        while at < len(key):
            node = node[1][key[at]]
            at += len(node[0])
        return node[2]

    def evict(self) -> tuple[bytes, list] | None:
        """Take the largest subtree out, below the first node that branches: (what leads to it, the subtree)."""
        node, path = self.root, b""
        while len(node[1]) == 1 and node[2] is None:
            (node,) = node[1].values()
            path += node[0]
        if not node[1]:
            return None  # a single string: nothing to set aside
        sizes = {k: sum(len(n[0]) + _NODE for n in _nodes(c)) for k, c in node[1].items()}
        k = max(sizes, key=sizes.get)
        self.held -= sizes[k]
        return path, node[1].pop(k)


def _nodes(node: list) -> Iterator[list]:
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack += n[1].values()


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the longest common prefix of ``label`` and ``key[at:]`` (one byte at least), by bisection."""
    lo, hi = 1, min(len(label), len(key) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if label[:mid] == key[at:at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def owners(rows: Iterable[tuple[bytes, int]], budget: int = BUDGET) -> Iterator[tuple[int, int]]:
    """(identifier, smallest identifier of its string) for every (string, identifier).

    A full trie sets its largest subtree aside: its strings, and later ones of that branch, are left to a pass of
    their own. Strings wait in a temporary file of the task, so memory is bounded whatever the partition holds.
    """
    todo = [_Spill(rows)]
    while todo:
        trie, aside, source = Trie(budget), {}, todo.pop()
        for key, ident in source:
            if not any(key.startswith(lead) for lead in aside):
                trie.insert(key, ident)
                if trie.held > budget and (out := trie.evict()):
                    aside[out[0] + out[1][0][:1]] = _Spill()
        for key, ident in source:
            lead = next((a for a in aside if key.startswith(a)), None)
            if lead is None:
                yield ident, trie.find(key)
            else:
                aside[lead].add(key, ident)
        source.close()
        todo += aside.values()


class _Spill:
    """(string, identifier) pairs in a temporary file, read as often as wanted."""

    def __init__(self, rows: Iterable[tuple[bytes, int]] = ()):
        self.file, self.close = (f := tempfile.TemporaryFile()), f.close
        for key, ident in rows:
            self.add(key, ident)

    def add(self, key: bytes, ident: int):
        pickle.dump((key, ident), self.file, protocol=5)

    def __iter__(self):
        self.file.seek(0)
        while True:
            try:
                pair = pickle.load(self.file)
            except EOFError:
                return
            yield pair


_LOCAL = "doc_id long, row long, chars long, sha binary, ref long, size long, hash long, body binary"


def _local(budget: int):
    """First pass: equal texts of one input partition meet in its own trie; the first of them carries the bytes on."""
    def run(batches):
        trie = Trie(budget)
        for batch in slices(batches, "text"):
            buf, off = text_buffer(batch.column("text"))
            raw, off = memoryview(buf), off.tolist()
            sha, ref, size, body = [], [], [], []
            for i, row in enumerate(batch.column("row").to_pylist()):
                key = bytes(raw[off[i]:off[i + 1]]).translate(None, _WHITE)
                first = trie.insert(key, row)
                sha.append(hashlib.sha256(key).digest())
                ref.append(first)
                size.append(len(key))
                body.append(key if first == row else None)
                if trie.held > budget:
                    trie.evict()  # met again, its texts carry their bytes once more
            hashed = [int.from_bytes(d[:8], "little", signed=True) for d in sha]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "row", "chars")), pa.array(sha, pa.binary()), *(pa.array(x, pa.int64()) for x in (ref, size, hashed)),
                                              pa.array(body, pa.binary())], names=["doc_id", "row", "chars", "sha", "ref", "size", "hash", "body"])
    return run


def _global(budget: int):
    """Second pass: strings of one length and hash meet in the trie of their partition."""
    def strings(batches):
        for batch in batches:
            buf, off = text_buffer(batch.column("body"))
            raw, off = memoryview(buf), off.tolist()
            for i, ref in enumerate(batch.column("ref").to_pylist()):
                yield bytes(raw[off[i]:off[i + 1]]), ref

    def run(batches):
        refs, own = [], []
        for ref, owner in owners(strings(batches), budget):
            refs.append(ref)
            own.append(owner)
            if len(refs) == 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(own, pa.int64())], names=["ref", "owner"])
                refs, own = [], []
        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(own, pa.int64())], names=["ref", "owner"])
    return run


def dedup(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text, row).

    ``row`` is any distinct number of a row. Texts are equal when identical without white space; null counts as
    empty. Of equal texts the one with the most code points stays, then the smallest doc_id (null first), then the
    smallest row, so of repeated rows exactly one is kept. Empty table: no rows.

    Bytes move once: each input partition sends a text at most once (again only after its branch was evicted), so a
    group of any size reaches its owner as at most one string for each task. What follows moves numbers only, folded
    per (task, text) before they meet.
    """
    n = shuffles(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "text")
    m = stash(d.mapInArrow(_local(budget), _LOCAL), "trie-local")
    bodies = m.where("body IS NOT NULL").select("size", "hash", "ref", "body").repartition(n, "size", "hash")
    own = stash(bodies.select("ref", "body").mapInArrow(_global(budget), "ref long, owner long"), "trie-owner")
    best = F.min(F.struct((-F.col("chars")).alias("c"), "doc_id", "row")).alias("best")
    part = m.groupBy("ref").agg(best, F.count("*").alias("n")).join(own, "ref")
    whole = part.groupBy("owner").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))
    keep = own.join(whole, "owner").select("ref", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    return m.select("ref", "doc_id", "row", "sha").join(keep, "ref").select(
        "row", "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
