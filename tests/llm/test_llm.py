"""Training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marketspark.llm import backoff_lm, chat_prefix, hilbert_shards, jaccard_join, lp_packing, lsi_decontam, pii_disclosure, queries, toxicity, trie_dedup, url_vocab
from marketspark.llm.common import numbered, text_buffer, without, word_hashes
from marketspark.session import scratch_path

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def near(text, k):
    w = text.split()
    w[k % len(w)] = "changed"
    return " ".join(w)


BASE = prose(1, 120)
TEXTS = [BASE, near(BASE, 3), near(BASE, 60), near(near(BASE, 3), 90), BASE, BASE.upper() + " ", None, "", " \n", "one two", "one  two", "ONE TWO", prose(2, 3000), prose(3, 80), prose(4, 30),
         "mail a.b@c.de, b@c.d.e. x@y +1 (555) 123-4567 or 1.2.3.4.5 or 300.1.1.1 or 4111 1111 1111 1111", "é" * 20 + " 7.7.7.7 a@b..c a@b.c_x@d.e <|endoftext|>", prose(2, 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", "clash", 1.0, 0) for i, t in enumerate(TEXTS)] + [(None, BASE, None, None, None, None, None), (3, TEXTS[3], "en", "src0", "clash", 1.0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row string, score double, n int")
    path = scratch_path(spark, "docs")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def row_docs(docs):
    return numbered(docs.select("doc_id", "text"))


def sets(texts):
    def one(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return [one(t) for t in texts]


def classes(ids, s):
    own = list(range(len(ids)))
    while True:
        before = list(own)
        for i in range(len(s)):
            for j in range(len(s)):
                if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    own[i] = own[j] = min(own[i], own[j])
        if own == before:
            return own


@pytest.fixture(scope="module", params=[12, 1])
def small(request, monkeypatch_module):
    monkeypatch_module.setattr(jaccard_join, "SMALL", request.param)


@pytest.fixture(scope="module")
def monkeypatch_module():
    m = pytest.MonkeyPatch()
    yield m
    m.undo()


def test_jaccard_components(spark, docs, small):
    got = jaccard_join.linked(row_docs(docs)).collect()
    rows = {r["row"]: r for r in row_docs(docs).collect()}
    order = sorted(rows)
    s = sets([rows[r]["text"] for r in order])
    own = classes(order, s)
    assert len(got) == len(order)
    for r in got:
        k = order.index(r["row"])
        group = [rows[order[i]]["doc_id"] for i in range(len(own)) if own[i] == own[k]]
        assert r["n_shingles"] == len(s[k])
        assert r["component_id"] == min((g for g in group if g is not None), default=None)
    kept = without(docs, jaccard_join.linked(row_docs(docs)).where("row <> keep_row").select("row"))
    assert kept.count() == len(set(own)) and kept.columns == docs.columns


def test_jaccard_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = prose(9, 60)
    rows = [(i, near(near(base, 7 * i), 11 * i + 1)) for i in range(24)] + [(100 + i, base + " " + prose(50 + i, 10 + 6 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "blocks")
    df.write.parquet(path)
    d = numbered(spark.read.parquet(path))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(d).collect()}
    own = classes([i for i, _ in rows], sets([t for _, t in rows]))
    assert got == {i: rows[k][0] for (i, _), k in zip(rows, own)}
    assert jaccard_join.linked(d.limit(0)).collect() == []


def test_cell_counts_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 5, 400, 511, 512, 640, 3_000, 40_000):
        base = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        sets.append(base)
        for share in (0.05, 0.1, 0.3):  # near and far copies, some smaller than the next number of cells asks for
            sets.append(np.unique(base[rng.random(len(base)) >= share]))
            sets.append(np.union1d(sets[-1], rng.integers(0, 1 << 64, int(n * share), dtype=np.uint64)))
    sets.append(np.arange(2_000, dtype=np.uint64))  # all in one cell, past the largest count
    sets.append(np.arange(1_900, dtype=np.uint64))
    cells = jaccard_join._Cells([jaccard_join._cells(s) for s in sets])
    assert len(set(cells.width.tolist())) > 4
    everything = np.arange(len(sets))
    for i, s in enumerate(sets):
        true = np.array([len(np.setxor1d(s, o)) for o in sets])
        j, differ = cells.differ(i, everything, true)
        assert j.tolist() == everything.tolist() and (differ <= true).all()
        none, _ = cells.differ(i, everything, differ - 1)
        assert len(none) == 0


def test_jaccard_rounds_send_no_region_lists(spark, monkeypatch):
    """What a member takes along does not grow with its regions; a pair that many regions share is tried once."""
    plans, block_pairs = [], jaccard_join._block_pairs
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "_block_pairs", lambda *a: plans.append(x := block_pairs(*a)) or x)
    base = prose(9, 60)
    rows = [(i, near(base, 7 * i)) for i in range(8)] + [(100 + i, base + " " + prose(50 + i, 10 + 6 * i)) for i in range(6)]
    path = scratch_path(spark, "lists")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    jaccard_join.linked(numbered(spark.read.parquet(path))).collect()
    assert plans and not any("collect_list" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)
    s = [np.unique(np.random.default_rng(5).integers(0, 1 << 64, 40, dtype=np.uint64))] * 3
    held = [{"p": 0, "part": 0, "lo": 0, "hi": 0, "s": r, "ref": i, "n": 40, "comp": i, "block": 0, "low": 0.0, "high": 1.0, "cells": jaccard_join._cells(s[i])} for r in range(20) for i in range(3)]
    batch = pa.RecordBatch.from_pylist(held)
    got = [tuple(r.values()) for most in (None, 1) for b in jaccard_join._candidates(80, most)([batch.slice(0, 31), batch.slice(31)]) for r in b.to_pylist()]
    assert sorted(got) == sorted([(0, 1), (0, 2), (1, 2)] * 2)


def test_jaccard_later_rounds_read_unfinished_regions(spark, monkeypatch):
    """A region whose members had no more partners than their round takes is sent to no later round; none is lost."""
    calls, block_pairs = [], jaccard_join._block_pairs
    monkeypatch.setattr(jaccard_join, "SMALL", 2)
    monkeypatch.setattr(jaccard_join, "_block_pairs", lambda m, *a: calls.append(m.count()) or block_pairs(m, *a))
    base = prose(9, 60)
    rows = [(i, near(near(base, 7 * i), 11 * i + 1)) for i in range(24)] + [(100 + i, base + " " + prose(50 + i, 10 + 6 * i)) for i in range(10)]
    path = scratch_path(spark, "later")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    own = classes([i for i, _ in rows], sets([t for _, t in rows]))
    for rounds, most in (((64, None), 1), ((1, None), 2)):
        calls.clear()
        monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.linked(numbered(spark.read.parquet(path))).collect()}
        assert got == {i: rows[k][0] for (i, _), k in zip(rows, own)}
        assert len(calls) <= most and calls[0] > 0 and calls[1:] <= calls[:1]
    s = np.unique(np.random.default_rng(5).integers(0, 1 << 64, 40, dtype=np.uint64))
    held = [{"p": 0, "part": 0, "lo": 0, "hi": 0, "s": r, "ref": i, "n": 40, "comp": i, "block": 0, "low": 0.0, "high": 1.0, "cells": jaccard_join._cells(s)} for r, k in ((7, 4), (8, 2)) for i in range(k)]
    found = {most: {tuple(r.values()) for b in jaccard_join._candidates(80, most, left=True)([pa.RecordBatch.from_pylist(held)]) for r in b.to_pylist()} for most in (1, 3, None)}
    assert {r for r in found[1] if r[0] is None} == {(None, 7)}
    assert found[3] == found[None] == {(i, j) for j in range(4) for i in range(j)}


def test_jaccard_first_of_equal_sets_groups_numbers_only(spark):
    rows = [(i, f"d{i % 3}".encode(), [i, 7], b"c" * i) for i in range(12)] + [(40, b"only", [1], b"x")]
    path = scratch_path(spark, "first")
    spark.createDataFrame(rows, "row long, dig binary, window array<long>, cells binary").write.parquet(path)
    for small in (100, 1):
        got = jaccard_join._first(spark.read.parquet(path), small)
        assert sorted((r["row"], bytes(r["dig"]), r["window"], bytes(r["cells"])) for r in got.collect()) == [*rows[:3], rows[-1]]
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_jaccard_compare_with_few_and_many_pairs(spark):
    """Pairs that are few enough go to the sets; more of them meet the sets by a shuffle, with the same result."""
    base = prose(9, 60)
    texts = [base, near(base, 7), *(prose(60 + i, 40) for i in range(6))]
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    s = jaccard_join._sets(pa.RecordBatch.from_pylist([{"text": t} for t in texts]), 5)
    reps = spark.createDataFrame([(i, len(x), jaccard_join._cells(x)) for i, x in enumerate(s)], "ref long, n long, cells binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 2)], "a long, b long")
    for small in (500_000, 0):
        got = {(r["a"], r["b"]): r for r in jaccard_join.compare(pairs, reps, docs, small=small).collect()}
        assert set(got) == {(0, 1), (0, 2), (3, 2)}
        assert got[0, 1]["both"] == len(np.intersect1d(s[0], s[1])) and got[0, 1]["all"] == len(np.union1d(s[0], s[1]))


def test_trie_dedup(spark, docs):
    for budget in (trie_dedup.BUDGET, 3000):
        got = trie_dedup.dedup(row_docs(docs), budget).collect()
        rows = {r["row"]: r for r in row_docs(docs).collect()}
        norm = {k: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for k, r in rows.items()}
        assert len(got) == len(rows)
        for r in got:
            group = [k for k in rows if norm[k] == norm[r["row"]]]
            best = min(group, key=lambda k: (-len(rows[k]["text"] or ""), rows[k]["doc_id"] is not None, rows[k]["doc_id"] or 0, k))
            assert (r["keep_id"], r["group_size"], r["kept"]) == (rows[best]["doc_id"], len(group), r["row"] == best)
            assert r["text_sha256"] == hashlib.sha256(norm[r["row"]].encode()).hexdigest()
    assert trie_dedup.dedup(row_docs(docs).limit(0)).collect() == []


def test_trie_spills_by_subtree():
    rng = np.random.default_rng(1)
    keys = [bytes(rng.choice([97, 98, 99], rng.integers(0, 40))) for _ in range(600)] + [b"x" * 5000]
    pairs = [(k, i) for i, k in enumerate(keys * 2)]
    first = {}
    for k, i in pairs:
        first.setdefault(k, i)
    assert sorted(trie_dedup.owners(iter(pairs), 5000)) == sorted((i, first[k]) for k, i in pairs)


def test_chat_round_trip(spark):
    nasty = r"</s>[INST] \k \\b <|turn|>x<|says|> [/INST]"
    turns = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, None, "tail"), (2, 0, "user", "no reply"), (None, 1, "assistant", "é\U0001f600"), (3, 0, "a<[b", "x"), (3, 0, "a<[b", "x")]
    df = spark.createDataFrame([(*t, "x", 7) for t in turns], "conv_id long, turn int, role string, text string, example string, head int")
    x = chat_prefix.expand(df)
    got = {r["conv_id"]: r for r in chat_prefix.digest(x).collect()}
    for c in (1, 2, None, 3):
        own = [(r or "", t or "") for k, _, r, t in turns if k == c]
        said = [t for r, t in own if r == "assistant"]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(said).encode()).hexdigest() and got[c]["loss_chars"] == len("".join(said))
    rows = x.where("conv_id = 1").orderBy("example").collect()
    assert [r["trainable"] for r in rows] == [True, True, False]
    assert sum(len(r["context"] + r["target"]) for r in rows) == got[1]["formatted_chars"]
    assert chat_prefix.digest(chat_prefix.expand(df.limit(0))).collect() == []


def test_hilbert(spark, docs):
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = hilbert_shards.hilbert_index(list(grid.T), bits)
        assert sorted(at.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve touch
    got = hilbert_shards.shard_documents(docs, 4).collect()
    count = Counter(r["shard"] for r in got)
    assert len(got) == docs.count() and set(count) == {0, 1, 2, 3} and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs.select("doc_id", "text").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert hilbert_shards.shard_documents(docs.limit(0)).collect() == []


def test_hilbert_tells_long_names_apart(spark):
    """Sources that share twenty bytes and more: each lies in few shards, so the others' files can be left out."""
    names = [f"https://crawl.example.org/2024/part-{i:02d}" for i in range(8)]
    rows = [(i, "t" * (i % 50), "en", names[i % 8]) for i in range(4000)] + [(None, None, None, None)] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    cuts = hilbert_shards.text_cuts(d, d["source"], 64)
    assert cuts == sorted(cuts) and set(cuts) == set(names) and len(cuts) == 63
    out = hilbert_shards.assign(d, {"source": F.col("source")}, {"doc_id": F.col("doc_id")}, ["doc_id"], 64, 6)
    path = scratch_path(spark, "shards")
    hilbert_shards.write_shards(out, path, 64)
    held = spark.read.parquet(path).groupBy("source").agg(F.countDistinct("shard").alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in held) == len(rows) and all(r["n"] <= 24 for r in held)
    skewed = spark.createDataFrame([("hot",)] * 500 + [(f"cold{i}",) for i in range(500)], "s string")
    cuts = hilbert_shards.text_cuts(skewed, skewed["s"], 8)
    assert len(cuts) == 7 and cuts.count("hot") in (3, 4)
    assert hilbert_shards.text_cuts(skewed.limit(0), skewed["s"], 8) == []


def test_toxicity_held_out(spark, docs):
    bad = ["vilest", "rottener", "scummy"]
    rows = [(i, prose(i, 60) + (" " + " ".join(np.random.default_rng(i).choice(bad, 4)) if i % 4 == 0 else "")) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text").where("doc_id IS NULL OR text IS NULL"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), i) for i in range(600)] + [(None, 1, 0), (5, None, 0)], "doc_id long, toxic int, score int")
    got = toxicity.classify(d, labels).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert len(held) > 50 and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in held)
    none = toxicity.classify(docs, labels.limit(0)).collect()
    assert {r["predicted"] for r in none} == {0}
    kept = toxicity.reject(docs, toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_urls(spark):
    urls = ["https://www.Example.ORG/es/1", "http://example.org/en/12?x", "http://a.b.com/fr/", "http://com/de/", "http://x.net/adult/x", "http://x.net/free-bets", "http://x.net/freebets/free", None, "", "no-scheme/adult", "http://x.org", "ftp://org/?a", "http://x.net/free/free"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_vocab.judge(df, queries.RULES).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "block", "allow", "block", "block", "block", "allow", "allow", "allow", "block", "allow", "allow", "allow"]
    assert [r["rule"] for r in got[:4]] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert sorted(con.execute(url_vocab.judge_sql(queries.RULES)).fetchall()) == sorted(tuple(r) for r in got)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = lp_packing.pack(docs, queries.ranks_path(), keep_ids=True).collect()
    want = Counter()
    for i, x in docs.select("doc_id", "text").collect():
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[i, len(ids)] += 1
        if i not in (None, 3):  # ids that come once
            own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
            assert [k for r in own for k in r["ids"]] == ids and [r["start"] for r in own] == np.cumsum([0, *[r["length"] for r in own]])[:-1].tolist()
    seqs: dict = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] <= 1024
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist() and sum(n for _, n in s) <= 1024
    assert sum(r["length"] for r in got) == sum(n * k for (_, n), k in want.items())
    assert len(seqs) <= math.ceil(sum(r["length"] for r in got) / 1024) + 1
    assert lp_packing.pack(docs.limit(0), queries.ranks_path()).collect() == []


@pytest.mark.parametrize("kind", ["lognormal", "two", "uniform"])
def test_little_is_left_to_best_fit_of_millions_of_pieces(kind, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = {"lognormal": np.clip(rng.lognormal(5.5, 1, 200_000).astype(int), 1, 1024), "two": rng.choice([342, 341, 683], 200_000), "uniform": rng.integers(1, 1025, 200_000)}[kind]
    demand = {int(k): 100 * int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
    rest = []
    plain = lp_packing.best_fit
    monkeypatch.setattr(lp_packing, "best_fit", lambda left, capacity: rest.append(left.total()) or plain(left, capacity))
    out = lp_packing.fillings(demand)
    used = Counter()
    for f, q in out:
        assert sum(f) <= 1024
        for s in f:
            used[s] += q
    assert used == Counter(demand)
    # of two sizes, each 683 goes with a 341 at best, and then two of 342 together
    best = demand[683] + demand[342] / 2 if kind == "two" else lp_packing.solve(demand)[1]
    assert sum(q for _, q in out) <= (1.02 if kind == "uniform" else 1.005) * best
    assert kind != "lognormal" or rest[0] <= len(out)


def test_best_fit_by_counts_equals_piece_by_piece():
    rng = np.random.default_rng(6)
    for _ in range(60):
        cap = int(rng.integers(5, 40))
        left = Counter(rng.integers(1, cap + 1, rng.integers(0, 60)).tolist())
        room: list = []
        for s in sorted(left.elements(), reverse=True):
            fit = min((r for r in room if r >= s), default=cap)
            if fit in room:
                room.remove(fit)
            room.append(fit - s)
        got = lp_packing.best_fit(left, cap)
        assert Counter(s for f, q in got.items() for s in f * q) == left
        assert Counter(cap - sum(f) for f, q in got.items() for _ in range(q)) == Counter(room)


def test_fillings_near_the_bound():
    rng = np.random.default_rng(3)
    lengths = np.clip(rng.lognormal(5.5, 1, 40_000).astype(int), 1, 1024)
    demand = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    out = lp_packing.fillings(demand)
    used = Counter()
    for f, q in out:
        assert sum(f) <= 1024
        for s in f:
            used[s] += q
    _, bound = lp_packing.solve(demand)
    assert used == Counter(demand) and sum(q for _, q in out) <= 1.005 * bound + 2
    assert lp_packing.fillings({600: 7}) == [((600,), 7)] and lp_packing.fillings({}) == []


def test_lm_equals_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(backoff_lm, "CHUNK", 2000)
    got = backoff_lm.score(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    toks = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in rows]
    c = Counter(w for t, on in zip(toks, learn) if on for w in t)
    pairs = Counter(p for t, on in zip(toks, learn) if on for p in zip(["<"] + t, t))
    n, v = sum(c.values()), len(c)
    hist = Counter(c)
    hist["<"] = sum(learn)
    p = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    want = sorted((len(t), sum(c[w] > 0 for w in t), round(sum(math.log10(p(w)) for w in t), 6), round(sum(math.log10((pairs[u, w] + 20 * p(w)) / (hist[u] + 20)) for u, w in zip(["<"] + t, t)), 6)) for t in toks)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert backoff_lm.score(docs.limit(0)).collect() == []


def test_lm_order_three_on_long_texts(spark, monkeypatch):
    """Chunks end by the rows alone, whatever Arrow batches; texts of 20 KB close Arrow batches by their bytes."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice(WORDS, 4500 if i % 3 else 40))) for i in range(120)]
    path = scratch_path(spark, "long")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    d = spark.read.parquet(path)
    monkeypatch.setattr(backoff_lm, "CHUNK", 100_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "300000")
    try:
        got = {r["doc_id"]: r["score"] for r in backoff_lm.score(d, order=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    toks = {i: [*t.encode().split(), None] for i, t in rows}
    c = [Counter() for _ in range(4)]
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            s = ["<", "<", *t]
            for n in (1, 2, 3):
                c[n].update(tuple(s[k - n + 1:k + 1]) for k in range(2, len(s)))
            c[1][("<",)] += 1
            c[2][("<", "<")] += 1
    total = sum(c[1].values()) - c[1][("<",)]

    def p(g):
        if len(g) == 1:
            return (c[1][g] + 0.1) / (total + 0.1 * len(c[1]))
        return (c[len(g)][g] + 20 * p(g[1:])) / (c[len(g) - 1][g[:-1]] + 20)
    for i, t in toks.items():
        s = ["<", "<", *t]
        assert got[i] == pytest.approx(sum(math.log10(p(tuple(s[k - 2:k + 1]))) for k in range(2, len(s))), abs=1e-6)


def test_lm_chunks_do_not_follow_arrow_batches(monkeypatch):
    texts = ["x" * n for n in (20_000, 3, 0, 90_000, 20_000, 250_000, 1, 20_000, 60_000)]
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([4] * len(texts))], names=["text", "part"])
    monkeypatch.setattr(backoff_lm, "CHUNK", 100_000)
    cuts = [[(k, b.column("text").to_pylist()) for k, b in backoff_lm._chunks(iter([whole.slice(i, n) for i in range(0, len(texts), n)]))] for n in (1, 2, 4, 9)]
    assert all(c == cuts[0] for c in cuts) and [len(t) for _, t in cuts[0]] == [3, 1, 1, 1, 3] and [t for _, ts in cuts[0] for t in ts] == texts


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 10 <= len(d) <= 15
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if good(kind, m.group()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def test_pii_base_spans(spark, docs):
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(list("ab1.@-+_ ()4"), 60)) for _ in range(300)] + ["".join(rng.choice(list("0123456789 -"), 80)) for _ in range(100)] + ["4111-1111 11111111", "1" * 3000 + ".1.1.1", "a" * 4000 + "@b.c", "\U0001f600 a@b.co +49 (0) 30 123456-7"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    path = scratch_path(spark, "pii")
    df.write.parquet(path)
    d = numbered(spark.read.parquet(path))
    found = pii_disclosure.find(d)
    got = pii_disclosure.digest(found).collect()
    want = Counter((i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in df.collect())
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    clean = {r["doc_id"]: r["text"] for r in pii_disclosure.sanitise(d, found).collect()}
    assert clean[15].startswith("mail <EMAIL>, <EMAIL>. x@y <PHONE> or <IP>.5 or 300.1.1.1 or <CARD>") and clean[0] == TEXTS[0] and clean[6] == ""
    assert pii_disclosure.find(d.limit(0)).collect() == []


def test_pii_terms_that_reveal(spark):
    rows = [(i, f"{prose(i, 10)} write Zebulon at z@q.example {prose(i + 50, 10)}") for i in range(6)] + [(100 + i, prose(200 + i, 40) + " write") for i in range(30)] + [(200, "so said Zebulon!")]
    path = scratch_path(spark, "terms")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    d = numbered(spark.read.parquet(path))
    base = pii_disclosure.base_spans(d)
    terms = {r["term"]: r for r in pii_disclosure.disclosing_terms(d, base).collect()}
    assert terms["zebulon"]["entity"] == "z@q.example" and terms["zebulon"]["left_bits"] == pytest.approx(math.log2(7 / 6)) and "write" not in terms
    spans = {r["doc_id"]: r["spans"] for r in pii_disclosure.digest(pii_disclosure.find(d)).collect()}
    assert "term:8:15" in spans[200] and spans[100] == ""


def test_pii_words_of_any_length_between_name_and_address(spark):
    far = "x" * 64
    rows = [(i, f"{prose(i, 10)} write Zebulon {far}{i} at z@q.example {prose(i + 50, 10)} z@q.example,") for i in range(6)] + [(100 + i, prose(200 + i, 40)) for i in range(30)] + [(200, "so said Zebulon!")]
    path = scratch_path(spark, "far")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    d = numbered(spark.read.parquet(path))
    spans = pii_disclosure.base_spans(d).where("kind = 'email'").orderBy("row", "start").collect()
    assert spans[0]["before"][:2] == ["write", "Zebulon"] and spans[0]["before"][2].startswith(far) and spans[0]["before"][3:] == ["at"] and len(spans[0]["after"]) == 4 and spans[1]["after"] == [","]
    got = {r["doc_id"]: r["spans"] for r in pii_disclosure.digest(pii_disclosure.find(d)).collect()}
    assert "term:8:15" in got[200]


def test_pii_names_with_digits_reveal(spark):
    rows = [(i, f"{prose(i, 10)} user Max1990 at m@q.example or +49 30 12345678 {prose(i + 50, 10)}") for i in range(6)] + [(100 + i, prose(200 + i, 40)) for i in range(30)] + [(200, "so said max1990!")]
    path = scratch_path(spark, "names")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    spans = {r["doc_id"]: r["spans"] for r in pii_disclosure.digest(pii_disclosure.find(numbered(spark.read.parquet(path)))).collect()}
    assert spans[200] == "term:8:15"
    for doc, text in rows[:6]:
        a, b = text.index("m@q.example"), text.index("+49")
        found = [s.split(":") for s in spans[doc].split(",")]
        terms = [(int(x), int(y)) for k, x, y in found if k == "term"]
        assert (text.index("Max1990"), text.index("Max1990") + 7) in terms and not any(x < q and p < y for x, y in terms for p, q in ((a, a + 11), (b, b + 15)))


def test_decontamination(spark, docs):
    items = [(i, prose(900 + i, 12 + 2 * i)) for i in range(20)] + [(50, "one two"), (51, None), (52, ""), (53, prose(999, 150))]
    para = items[5][1].split()
    para[2] = para[9] = "other"
    rows = [(i, f"{prose(i, 90)} {items[i][1].upper()} {prose(i + 300, 40)}") for i in range(20)] + [(30, prose(30, 50) + " " + " ".join(para)), (31, items[19][1][:60]), (32, prose(33, 200)), (33, items[23][1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, row string")
    d = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text").where("text IS NULL OR doc_id IS NULL"))
    path = scratch_path(spark, "leaks")
    d.write.parquet(path)
    got = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.leaks(numbered(spark.read.parquet(path)), bench).collect()}
    assert got == {(i, i) for i in range(20)} | {(30, 5), (33, 53)}
    assert lsi_decontam.leaks(numbered(spark.read.parquet(path)).limit(0), bench).collect() == []
    assert lsi_decontam.leaks(numbered(spark.read.parquet(path)), bench.limit(0)).collect() == []


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 90)), rng.integers(0, 6, rng.integers(0, 90))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert lsi_decontam.common_subsequence(a, b) == t[-1, -1]


def test_latent_vectors_do_not_depend_on_what_comes_before():
    rng = np.random.default_rng(7)
    vocabulary = np.sort(rng.integers(0, 1 << 64, 50, dtype=np.uint64))
    basis = (3 + rng.random((50, 8))).astype(np.float32)  # sums over all words grow large
    lengths = [5, 16, 17, 31, 32, 33, 4, 0, 48, 700, 2, *([400] * 150)]
    h = vocabulary[rng.integers(0, 50, sum(lengths))]
    h[rng.random(len(h)) < 0.3] = 1  # in no item
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    _, starts, ends = lsi_decontam._windows(bounds)
    v, size = lsi_decontam._latent(h, starts, ends, lsi_decontam.Terms(vocabulary), basis)
    place = {w: k for k, w in enumerate(vocabulary.tolist())}
    for x, n, a, b in zip(v, size, starts.tolist(), ends.tolist()):
        true = sum((basis[place[w]].astype(float) for w in h[a:b].tolist() if w in place), np.zeros(8))
        assert np.allclose(x, true, rtol=2e-6, atol=1e-6) and np.isclose(n, max(np.linalg.norm(true), 1e-6), rtol=2e-6)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P
    d, kept = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, d, SF)
        assert kept.columns == d.columns
        d = queries.lp_packing.stash(kept, name)
    texts = [r["text"] for r in d.collect()]
    s = sets(texts)
    assert len(set(classes(range(len(s)), s))) == len(texts)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r["text"] or "").split()) >= 5]
    assert not any(i in " ".join(t.lower().split()) for t in texts for i in items)
    out = P.STAGES[-1][1](spark, d, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in d.select("doc_id").collect()}
    clash = P.drop_near_copies(spark, P.drop_copies(spark, docs, SF), SF)
    assert clash.columns == docs.columns and clash.count() == len(set(classes(range(docs.count()), sets([r["text"] for r in docs.select("text").collect()])))) - 2  # of the three without words two go as copies


def test_registered():
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()} and "pipeline" in entry.queries()


def test_latent_space_counts_every_document(spark, monkeypatch):
    """the space is fitted to all passages, whatever FIT_DOCS is; before, to those of FIT_DOCS documents."""
    rows = [(i, f"{prose(i, 5 + 7 * i)} w{i}") for i in range(40)] + [(100, None), (101, ""), (102, "one two")]
    path = scratch_path(spark, "space")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    items = lsi_decontam.Items.of([(i, f"{prose(i, 30)} w{i}") for i in range(0, 40, 3)])
    held, df, n = lsi_decontam.occurrences(numbered(spark.read.parquet(path)), items)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    got = sum(lsi_decontam.moments(np.frombuffer(r.words, np.uint32).astype(np.int64), np.frombuffer(r.found, np.uint8), np.frombuffer(r.ends, np.uint8), idf, np.eye(len(idf))) for r in held.collect())
    want, docs_with = np.zeros((len(idf), len(idf))), np.zeros(len(idf), int)
    for _, text in rows:
        h, at = word_hashes(*text_buffer(pa.array([text], pa.string())))
        k = [int(np.searchsorted(items.vocabulary, x)) if x in items.vocabulary else -1 for x in h]
        docs_with[list({x for x in k if x >= 0})] += 1
        for s in range(0, max(len(k) - 16, 1), 16) if len(k) >= 5 else ():
            own = [x for x in k[s:s + 32] if x >= 0]
            w = np.bincount(own, minlength=len(idf)) * idf
            if own:
                want += np.outer(w, w) / (w @ w)
    assert n == len(rows) and (df == docs_with).all()
    np.testing.assert_allclose(got, want, atol=1e-4)
    bases = []
    for many in (2, 1000):
        monkeypatch.setattr(lsi_decontam, "FIT_DOCS", many)
        monkeypatch.setattr(lsi_decontam, "ITEM_WEIGHT", 0.0)
        b = lsi_decontam.fit(held, n, items, idf).astype(float)[:, :8]
        bases.append(b / np.linalg.norm(b, axis=0))
    assert np.abs(np.abs((bases[0] * bases[1]).sum(axis=0)) - 1).max() < 1e-3


def test_toxicity_learns_from_every_labelled_document(spark):
    """counts are those of all labelled rows; before, of the 12,000 with the smallest hash."""
    d = spark.range(16_000).selectExpr("id AS doc_id", "concat('plain ', CASE WHEN id % 4 = 0 THEN 'nasty' ELSE 'nice' END) AS text")
    labels = d.selectExpr("doc_id", "int(doc_id % 4 = 0) AS toxic")
    rows = toxicity.training_rows(d, labels, folds=1_000_003)
    n, mass = toxicity.feature_counts(rows)
    assert mass.sum() == rows.count() > 15_000
    assert n[1, toxicity._grams(np.frombuffer(b"nasty", np.uint8), 5)[0]] == mass[1] and n[0].max() == mass[0]
