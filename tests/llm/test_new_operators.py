"""Nearest vectors, runs of words and the audit of sources against brute force."""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexspan.llm import lyndon_runs, posting_lists, source_audit
from lexspan.llm import queries as llm
from tests.oracle import differences

SF = "/root/testdata/sf0.001"

# Nearest vectors


def brute_nearest(rows, asks, k):
    """rows (id, vector or None) in order; {row: [(id, score)]} of the asking rows."""
    good = [(i, n, np.array(v, float)) for i, (n, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, n, v in good:
        if asks(n):
            m = lambda u: functools.reduce(lambda s, ab: s + ab[0] * ab[1], zip(v, u, strict=False), 0.0)
            scored = sorted(((-m(u), j is None, j or 0, r) for r, j, u in good if r != i), key=lambda x: x)
            out[i] = [(None if none else j, -s) for s, none, j, _ in scored[:k]]
    return out


def asked(spark, rows, k=5, settings=posting_lists.Settings()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("digest", F.lit(1)).withColumn("rank", F.lit("x"))
    found = posting_lists.nearest(df, F.col("vec_id") % 20 == 0, k, settings=settings).collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_nearest_defined_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, -0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 0.0]), (None, [1.0, 0.0]), (7, []), (8, [3.0]), (9, [-1.0, 5.0, 7.0]), (20, [0.0, 1.0, float("inf")]), (40, [0.5, 0.5])]
    got = asked(spark, rows, 20)
    want = brute_nearest(rows, lambda n: n is not None and n % 20 == 0, 20)
    assert got == {0: want[0], 40: want[12]}
    assert got[0][:3] == [(8, 3.0), (1, 2.0), (6, 1.0)] and got[0][3] == (None, 1.0)
    assert asked(spark, [], 3) == {} and asked(spark, [(0, [1.0])], 3) == {}


def test_of_equal_vectors_the_smallest_ids_come_and_repeated_ids_are_rows(spark):
    rng = np.random.default_rng(5)
    common = [0.6, 0.8, 0.0]
    rows = [(i, common if i % 3 else rng.normal(size=3).tolist()) for i in range(300)] + [(20, common), (20, common)]
    got = asked(spark, rows, 5, posting_lists.Settings(reach=99.0))
    want = brute_nearest(rows, lambda n: n % 20 == 0, 5)
    together: dict = {}
    for i, found in want.items():
        together.setdefault(rows[i][0], []).extend(found)
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(v) for n, v in together.items()}
    assert len(got[20]) == 15  # three rows ask


def test_large_cells_are_cut_without_loss(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 3)).tolist()) for i in range(600)]
    whole = posting_lists.Settings(reach=99.0)
    cut = posting_lists.Settings(reach=99.0, cell_values=64, max_lists=3)
    want = brute_nearest(rows, lambda n: n % 20 == 0, 5)
    for settings in (whole, cut):
        got = asked(spark, rows, 5, settings)
        assert {n: [i for i, _ in v] for n, v in got.items()} == {rows[i][0]: [j for j, _ in v] for i, v in want.items()}


def test_nearest_recall_without_clusters(spark):
    """The given vectors have no clusters, which is the hardest case: recall is 0.9 or more against brute force."""
    sf = "/root/testdata/sf0.1"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.stack(t["embedding"].to_numpy()).astype(float)
    found: dict = {}
    for r in llm.op11_balanced_postings(spark, sf).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    at, hits = {int(n): i for i, n in enumerate(ids)}, 0
    for n, best in found.items():
        scores = x @ x[at[n]]
        scores[at[n]] = -9
        top = np.lexsort((ids, -scores))[:20]
        hits += len(set(ids[top].tolist()) & set(best))
        assert len(best) == 20 and all(abs(scores[at[m]] - s) < 1e-12 for m, s in best.items())
    assert set(found) == {int(n) for n in ids if n % 20 == 0}
    assert hits >= 0.9 * 20 * len(found)


def test_nearest_recall_with_clusters_and_norms_of_all_sizes(spark):
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(40, 6))
    x = (middle[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 6))) * 2.0 ** rng.integers(-3, 4, 4000)[:, None]
    got = asked(spark, [(i, v) for i, v in enumerate(x.tolist())], 10)
    hits = 0
    for n in range(0, 4000, 20):
        scores = x @ x[n]
        scores[n] = -np.inf
        hits += len(set(np.argsort(-scores)[:10].tolist()) & {m for m, _ in got[n]})
    assert hits >= 0.9 * 10 * 200


def test_the_walk_finds_the_near_centroids():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(4000, 16)).astype(np.float32)
    centroids = posting_lists.balanced_centroids(points, 300)
    sizes = np.bincount(posting_lists.distances(points, centroids).argmin(1), minlength=len(centroids))
    assert len(centroids) == pytest.approx(300, abs=30) and sizes.max() < 5 * sizes.mean()
    graph = posting_lists.Centroids(centroids, 16)
    asks = rng.normal(size=(200, 16)).astype(np.float32)
    row, node, d = graph.near(asks, 0.1)
    exact = posting_lists.distances(asks, centroids)
    want = exact <= 1.1 * exact.min(1)[:, None]
    assert want[row, node].sum() >= 0.95 * max(len(row), want.sum())
    assert np.allclose(d, exact[row, node], atol=1e-3)


# Runs


def brute_runs(words, exponent=4, least=6):
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a, out, known = np.array([code[w] for w in words], int), [], set()
    for p in range(1, len(a) // 2 + 1):
        same = np.concatenate(([0], (a[:-p] == a[p:]).astype(int), [0]))
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1), strict=True):
            if e - s >= p and (int(s), int(e - s + p)) not in known:  # the smallest period comes first
                known.add((int(s), int(e - s + p)))
                out.append((int(s), int(e - s + p), p))
    return sorted((r for r in out if r[1] >= max(least, exponent * r[2])), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(120):
        texts = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 150))
            w = [b"%d" % x for x in rng.integers(0, rng.choice([1, 2, 3, 8]), n)]
            if n and rng.random() < 0.5:
                w = llm.periodic_tail(w, 10 * int(rng.integers(0, 1000)))
            texts.append(w)
        for exponent, least in ((4, 6), (3, 1), (2, 1)):
            assert lyndon_runs.runs_of_texts(texts, exponent, least) == [brute_runs(w, exponent, least) for w in texts]


@pytest.mark.parametrize("text", ["a " * 3000 + "b", "b " + "a " * 3000, "a b " * 1000 + "c", "a a b " * 700 + "a a a b b", "b a " * 500 + "x " + "a b " * 500])
def test_long_repeats(text):
    words = text.encode().split()
    assert lyndon_runs.runs_of_texts([words, words[:7], words]) == [brute_runs(words), brute_runs(words[:7]), brute_runs(words)]


def test_lyndon_array_of_both_orders():
    rng = np.random.default_rng(9)
    for _ in range(200):
        letters = np.concatenate(([0], rng.integers(1, 4, rng.integers(1, 30)), [0]))
        end, group = lyndon_runs.lyndon_groups(letters, np.argsort(letters, kind="stable"))
        n = len(letters) - 1
        word = [tuple(letters[i : end[i]]) for i in range(1, n)]
        for i in range(1, n):
            suffixes = [tuple(letters[j:n]) for j in range(n + 1)]
            assert end[i] == next(j for j in range(i + 1, n + 1) if j == n or suffixes[j] < suffixes[i])
        for i in range(1, n):
            for j in range(1, n):
                assert (group[i] == group[j]) == (word[i - 1] == word[j - 1]) and (group[i] < group[j]) == (word[i - 1] < word[j - 1])


def run_rows(docs):
    """The query's rows by brute force."""
    out = []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        n = len(words)
        if h % 10 == 0 and n:
            a, g = (h // 10) % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        digest = hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest, hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def query_rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_run_query_equals_brute_force(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert query_rows(llm.op12_lyndon_runs(spark, SF)) == run_rows([(d["doc_id"], d["text"]) for d in docs])


def test_run_query_defined_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a a a a a a"), (None, None), (3, "x y " * 4 + "z z z z z z"), (3, "x y " * 4 + "z z z z z z"), (4, "p q r " * 9 + " s"), (5, "q " * 20000), (11, "a b " * 30 + "c d " * 30), (6, " \t\n")]
    rows += [(i, "one two three four five six seven eight nine ten " * 3) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("id", F.lit(2)).repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert query_rows(llm.op12_lyndon_runs(spark, str(tmp_path))) == run_rows(rows)
    assert lyndon_runs.find_runs(df.limit(0)).collect() == []


# Sources


def test_audit_defined_cases(spark, tmp_path):
    rows = [(f"Alpha beta {'gamma ' * (i % 4)} z{i}", "en" if i % 3 else None, f"s{i % 5}" if i % 7 else None) for i in range(90)]
    rows += [(None, "en", "s1"), ("", "en", "empty"), ("1 2 3", None, "digits"), ("É é été ÀB", "fr", "f1")] * 2
    rows += [(f"été École {'mot ' * 40} A_b", "fr", f"f{i % 2}") for i in range(12)] + [("one of a kind", "xx", "a"), ("another", "xx", "b"), ("Beta " * 20000, "en", "s2")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("block", F.lit("x")).withColumn("value", F.lit(1)).repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert differences(llm.op13_source_divergence(spark, str(tmp_path)), llm.OP13_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"), SF) == ""
    assert source_audit.divergence(df.limit(0)).collect() == []


def test_audit_in_small_cells(spark, monkeypatch):
    """Cells, blocks and held counts of a few rows give the same rows."""
    for name, value in (("CELL", 300), ("BLOCK", 50), ("HELD", 100)):
        monkeypatch.setattr(source_audit, name, value)
    assert differences(source_audit.divergence(spark.read.parquet(f"{SF}/documents.parquet")), llm.OP13_SQL, SF) == ""


def test_shares_do_not_overflow():
    rng = np.random.default_rng(10)
    total = rng.integers(1, 10**14, 100)
    count = (total * rng.random(100)).astype(np.int64)
    assert source_audit.scaled(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total, strict=True)]
