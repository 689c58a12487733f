"""Resampling, WARC archives and collocations against brute force: nulls, empty, long, repeated and clashing input."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from marketspark.llm import queries, son_collocations, target_resampling, warc_chain
from marketspark.llm.common import numbered, spread_join
from marketspark.session import scratch_path

WORDS = [f"w{i}" for i in range(60)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def stored(spark, df, parts=3):
    path = scratch_path(spark, "given")
    df.repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# ---- resampling --------------------------------------------------------------------------
DOCS = [(i, prose(i, 5 * i)) for i in range(40)] + [(50, None), (51, ""), (None, prose(7, 35)), (3, prose(3, 15)), (3, prose(3, 15)), (60, "É\x00éA-b_c \U0001f600Z9" * 30), (61, "x" * 70_000), (62, "A B " * 40_000), (63, "long" * 9_000 + " tail " + "long" * 9_000)]


def resampled(docs, target, longest=2, buckets=10_000, percent=25, least=20, seed=7):
    def hits(t):
        w = [m.encode() for m in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())]
        return len(w), [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]
    found = [(i, *hits(t)) for i, t in docs]
    s, t = Counter(b for _, _, h in found for b in h), Counter(b for x in target for b in hits(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, n, h in found:
        u = (int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(map(gain, h)) // len(h) if h else 0
        rows.append((n >= least, i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log(u)))))
    able = sorted((r for r in rows if r[0]), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    drawn = len(able) * percent // 100
    return Counter([(*r[1:], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[1:], None) for r in rows if not r[0]])


@pytest.mark.parametrize("args", [{}, {"longest": 4, "buckets": 70_000, "percent": 60, "least_words": 1, "seed": 3}, {"longest": 1, "buckets": 1, "percent": 100}])
def test_resampling(spark, args, monkeypatch):
    monkeypatch.setattr(target_resampling, "SEGMENT", 4096)
    docs = stored(spark, spark.createDataFrame([(*r, "c", 1) for r in DOCS], "doc_id long, text string, score string, hits int"))
    target = [prose(100 + i, 12) for i in range(5)] + [None, "", "W1 w1 É"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, n_words int")
    want = resampled(DOCS, target, args.get("longest", 2), args.get("buckets", 10_000), args.get("percent", 25), args.get("least_words", 20), args.get("seed", 7))
    assert Counter(tuple(r) for r in target_resampling.resample(docs, bench, **args).collect()) == want
    if not args:
        assert target_resampling.resample(docs.limit(0), bench).collect() == []
        assert Counter(tuple(r) for r in target_resampling.resample(docs, bench.limit(0)).collect()) == resampled(DOCS, [])


def test_segments_keep_words_whole():
    rng = np.random.default_rng(4)
    for _ in range(40):
        text = "".join(rng.choice(list("aB9é \n.-\x00\U0001f600"), rng.integers(0, 400)))
        whole = target_resampling.hashed(text, 3, 1 << 20)
        old, target_resampling.SEGMENT = target_resampling.SEGMENT, 7
        try:
            cut = target_resampling.hashed(text, 3, 1 << 20)
        finally:
            target_resampling.SEGMENT = old
        assert cut[0] == whole[0] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower().decode())) and sorted(cut[1]) == sorted(whole[1])


def test_ranks_are_gapless(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "score long, id long")
    got = target_resampling.ranked(df, df["score"].desc(), df["id"]).collect()
    order = sorted(got, key=lambda r: (-r["score"], r["id"]))
    assert [r["rank"] for r in order] == list(range(1, 501))


# ---- archives ----------------------------------------------------------------------------
NASTY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.1\r\nbroken"
PAGES = [(i, f"http://a/{i}", h) for i, h in enumerate(["a", "b", "a", None, "", NASTY, NASTY + "y", "é\U0001f600" * 5000, NASTY * 60, "a", "\r\n\r\n", "WARC/1.1\r\n"])] + [(None, None, "a"), (3, "u\r\nX: y", None), (21, "q", "z"), (21, "q", "z"), (None, "n", "n"), (None, "n", "n")]


def archived(pages, least=0):
    rows = [(i, (h or "").encode()) for i, _, h in pages]
    best = {}
    for i, h in rows:
        best[h] = max(best.get(h, -1), -1 if i is None else i)
    out, met = [], set()
    for i, h in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True):
        again = len(h) >= least and h in met
        met.add(h)
        refers = best[h] if again and best[h] >= 0 else None
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", refers))
    return Counter(out)


@pytest.fixture(scope="module")
def pages(spark):
    return stored(spark, spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, type int"))


@pytest.mark.parametrize(("span", "least"), [(warc_chain.RANGE, 0), (50, 0), (997, 2)])
def test_archives(spark, pages, span, least):
    assert Counter(tuple(r) for r in warc_chain.round_trip(numbered(pages), least, span).collect()) == archived(PAGES, least)
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = Counter((None if i != i else i, n, d, t, None if r != r else r) for i, n, d, t, r in con.execute(warc_chain.round_trip_sql(least)).fetchall())
    assert want == archived(PAGES, least)
    assert warc_chain.round_trip(numbered(pages).limit(0)).collect() == []


def test_archive_payloads_and_heads(spark, pages):
    path = scratch_path(spark, "archive")
    warc_chain.write(numbered(pages), path)
    got = warc_chain.read(spark, path, 700, payloads=True).collect()
    assert Counter(bytes(r["payload"]) for r in got if r["type"] == "response") == Counter({(h or "").encode() for _, _, h in PAGES})
    assert all(bytes(r["payload"]) == b"" for r in got if r["type"] == "revisit") and len({r["id"] for r in got}) == len(PAGES)
    assert {r["url"] for r in got} == {u if u is None or "\r" not in u else "u%0D%0AX: y" for _, u, _ in PAGES}
    assert {r["refers"] for r in got if r["type"] == "revisit"} <= {r["id"] for r in got if r["type"] == "response"}


def test_damaged_archive_ends_at_the_damage(spark, tmp_path):
    good = [(i, "u", f"page {i} " + NASTY) for i in range(30)]
    src = scratch_path(spark, "archive")
    warc_chain.write(numbered(stored(spark, spark.createDataFrame(good, "page_id long, url string, html string"), 1)), src)
    name = next(r["path"] for r in spark.read.format("binaryFile").load(src).select("path", "length").where("length > 0").collect()).removeprefix("file:")
    data = open(name, "rb").read()
    order = [r["at"] for r in warc_chain.read(spark, src).orderBy("at").collect()]
    assert len(order) == 30 and order[0] == 0
    for at, text in (("cut", data[:order[20] - 3]), ("hole", data[:order[19] + 3] + b"#" + data[order[19] + 4:])):
        (tmp_path / at).mkdir()
        (tmp_path / at / "a.warc").write_bytes(text)
        (tmp_path / at / "empty.warc").write_bytes(b"")
        assert sorted(r["at"] for r in warc_chain.read(spark, str(tmp_path / at), 512).collect()) == order[:19]


def test_pointer_jumping(spark):
    chain = [("f", i, i + 1) for i in range(37)] + [("f", 100, 5), ("g", 0, None), ("g", 1, 2)]
    jumps = spark.createDataFrame(chain, "path string, at long, leaves long")
    start = spark.createDataFrame([("f", 3), ("g", 0)], "path string, at long")
    assert {tuple(r) for r in warc_chain.reachable(jumps, start).collect()} == {("f", i) for i in range(3, 38)} | {("g", 0)}


def test_spread_join(spark):
    rows = stored(spark, spark.createDataFrame([(i, 0 if i % 3 else i % 40) for i in range(900)] + [(-1, None)], "id long, k long"))
    table = spark.createDataFrame([(k, k * 2) for k in range(0, 40, 2)], "k long, v long")
    got = spread_join(rows, table, ["k"])
    assert Counter(tuple(r) for r in got.select("id", "k", "v").collect()) == Counter((i, k, 2 * k) for i, k in ((i, 0 if i % 3 else i % 40) for i in range(900)) if k % 2 == 0)


# ---- collocations ------------------------------------------------------------------------
def mined(docs, support, longest=5, percent=100, limit=2000):
    pieces: dict = {}
    for lang, t in docs:
        for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").encode().lower().decode()):
            pieces.setdefault(lang or "und" if lang != "" else "", []).append(re.findall(r"[^\x20\x09]+", p))
    out = []
    for lang, ps in pieces.items():
        f = Counter(tuple(w[i:i + k]) for w in ps for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(v for g, v in f.items() if len(g) == 1)
        c = {g: v for g, v in f.items() if len(g) > 1 and v >= support}
        rows = []
        for g, a in c.items():
            if any(len(h) > len(g) and 100 * b >= percent * a and any(h[i:i + len(g)] == g for i in range(len(h))) for h, b in c.items()):
                continue
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((" ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:limit])]
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(11)
    small = [f"v{i}" for i in range(9)] + ["Ä", "ß\x00", "\U0001f600"]
    rows = [(str(rng.choice(["en", "de", "fr"], p=[0.8, 0.15, 0.05])), "".join(x + str(rng.choice([" ", "  ", "\t", ". ", ",", "\n", " V1 v2 v3 v4 V5 v6 "])) for x in rng.choice(small, rng.integers(1, 120)))) for _ in range(150)]
    return rows + [(None, "a b " * 40), (None, None), ("en", ""), ("en", " .,; \r\n"), ("", "x y " * 30), ("en", "deep sea fish " * 3000), rows[0], rows[0]]


@pytest.mark.parametrize(("support", "longest", "percent", "limit", "shard"), [(10, 5, 100, 2000, 32 << 20), (10, 5, 100, 2000, 600), (3, 5, 70, 15, 3000), (25, 3, 50, 7, 5000)])
def test_collocations(spark, texts, support, longest, percent, limit, shard):
    docs = stored(spark, spark.createDataFrame([(*r, "x", 1) for r in texts], "lang string, text string, phrase string, n int"))
    got = son_collocations.collocations(docs, support, longest, percent, limit, shard)
    assert Counter(tuple(r) for r in got.collect()) == mined(texts, support, longest, percent, limit)


def test_collocations_sql_and_empty(spark, texts):
    docs = spark.createDataFrame(texts, "lang string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = mined(texts, 10, 5, 70, 40)
    assert Counter(con.execute(son_collocations.collocations_sql(10, 5, 70, 40)).fetchall()) == want
    assert son_collocations.collocations(docs.limit(0)).collect() == []
    assert son_collocations.collocations(docs.where("text = ''"), 1).collect() == []


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", 0, "", 900_000_000_000_000), ("en", 1, "a", big + 7), ("en", 1, "b", big + 1), ("en", 2, "a b", big)]
    got = son_collocations.weakest_cuts(stored(spark, spark.createDataFrame(rows, "lang string, k int, phrase string, n long"))).collect()
    assert [r["score"] for r in got] == [1000 * big * rows[0][3] // ((big + 7) * (big + 1))]


def test_tokens():
    texts = [None, "", "A b.c", "d", "  e\tF\ng", ",", "é,É"]
    words, begins = son_collocations.tokens(pa.array(texts))
    assert [w.decode() for w in words.to_pylist()] == ["a", "b", "c", "d", "e", "f", "g", "é", "É"]
    assert begins.tolist() == [True, False, True, True, True, False, True, True, True]


def test_new_queries_have_sql():
    assert {"op11_target_resampling", "op12_warc_chain", "op13_son_collocations"} <= queries.ORACLES.keys() & queries.QUERIES.keys()
