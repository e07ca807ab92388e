"""SimHash components against brute force, and the search's parts."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lexspan.llm import simhash_vptree as sv


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(ids))]


def texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choices(vocab, k=rng.randint(40, 160))))
    return out


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sv, "SHARD_POINTS", 8)  # many shards on a small table
    monkeypatch.setattr(sv, "HOME_POINTS", 12)  # and cut ones
    monkeypatch.setattr(sv, "VISIT_POINTS", 40)
    ids = [*range(100, 340), 340, 340, None, 5, 6]
    body = [*texts(1, 240), "", None, " \t ", "ÀB c", "only"]
    rows = [(i, t, "x") for i, t in zip(ids, body, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    got = sorted(map(tuple, sv.simhash_components(df).collect()), key=str)
    fps = [brute_fingerprint(t) for t in body]
    comp = brute_components(ids, fps)
    want = sorted(((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, comp, strict=True)), key=str)
    assert got == want
    assert len(set(comp)) < len(ids) - 40


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sv.simhash_components(df).collect() == []


@pytest.mark.parametrize("radius", [1, 2])
def test_routing_and_cell_search_find_all_close_words(radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**32, 300, dtype=np.uint32)
    words = np.concatenate([base, base ^ (np.uint32(1) << rng.integers(0, 32, 300).astype(np.uint32)), base[:50]])
    vantage, median = sv.fit_tree(words[::3], 4)
    row, shard, home = sv.route(words, vantage, median, radius)
    assert np.array_equal(np.bincount(row[home], minlength=len(words)), np.ones(len(words)))
    seen = set()
    for s in np.unique(shard):
        at = row[shard == s]
        own = home[shard == s]
        for a, b in sv.close_pairs(words[at[own]], words[at], radius):
            seen |= set(zip(at[own][a].tolist(), at[b].tolist(), strict=True))
    i, j = np.nonzero(sv.popcount(words[:, None] ^ words[None]) <= radius)
    assert seen == set(zip(i.tolist(), j.tolist(), strict=True))


def test_large_dense_group_is_one_component():
    rng = np.random.default_rng(1)
    bits = np.repeat(rng.integers(0, 256, (1, 8), dtype=np.uint8), 3000, 0)
    flip = rng.integers(0, 64, 3000)
    bits[np.arange(3000), flip // 8] ^= (1 << (flip % 8)).astype(np.uint8)
    both, home = np.concatenate([bits, bits]), np.arange(6000) < 3000
    a, b = sv.cell_edges(both, home, 0, sv.EXACT3)
    points = len(np.unique(bits, axis=0))
    forest = sv.Forest(6000)
    assert len(a) == points - len({x.tobytes() for x in bits} - {both[i].tobytes() for i in [*a, *b]}) - 1
    forest.join(a, b)


def test_similar_texts_are_grouped_and_others_kept_apart(spark):
    rng = random.Random(5)
    vocab = [f"word{i}" for i in range(3000)]
    rows, group = [], []
    for g in range(40):
        base = rng.choices(vocab, k=300)
        for c in range(3):
            words = list(base)
            for _ in range(2 * c):  # at most 4 of 300 words: similarity 0.87 or more
                words[rng.randrange(300)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
            group.append(3 * g)
    got = {r["doc_id"]: r["component_id"] for r in sv.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == group[i] for i in range(120)) >= 116
    assert all(got[i] // 3 * 3 == group[i] for i in range(120))


def check_by_brute_force(spark, rows):
    """Groups of ``rows`` against all pairs; returns the number of linked pairs and the groups."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in rows)]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                linked += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    want = {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in sv.near_duplicates(df).collect()} == want
    return linked, set(want.values())


def test_near_duplicates_equal_brute_force_with_word_and_block_edits(spark):
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(4000)]
    bodies = []
    for g in range(60):
        base = rng.choices(vocab, k=rng.randint(20, 240))
        n = len(base)
        block = lambda share: [f"new{rng.randrange(10**6)}" for _ in range(round(share * n))]  # noqa: E731, B023
        scattered = list(base)
        for _ in range(max(1, n // 50)):
            scattered[rng.randrange(n)] = rng.choice(vocab)
        bodies += [base, scattered, base + block(0.1), base + block(0.24), block(0.2) + base, base + block(0.27), base[: round(0.82 * n)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(bodies)] + [(1000, ""), (1001, None), (1002, "a b c"), (1003, "A b  c")]
    linked, groups = check_by_brute_force(spark, rows)
    assert linked > 200 and len(groups) > 100


def test_a_large_group_of_texts_that_are_almost_alike_equals_brute_force(spark):
    rng = random.Random(13)
    vocab = [f"word{i}" for i in range(4000)]
    base = rng.choices(vocab, k=150)
    rows = []
    for d in range(260):
        words = list(base)
        for _ in range(rng.randint(0, 6)):  # two of three edits each are 0.7 alike, one with one 0.88
            words[rng.randrange(150)] = rng.choice(vocab)
        rows.append((d, " ".join(words)))
    linked, groups = check_by_brute_force(spark, rows)
    assert linked < 260 * 259 // 4 and 20 < len(groups) < 200


def test_folded_sets_differ_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for n, edits in ((1, 0), (30, 3), (150, 20), (150, 60), (5000, 400)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 63, edits, dtype=np.uint64) << np.uint64(1)]))
        apart = (int.from_bytes(sv.folded(a), "big") ^ int.from_bytes(sv.folded(b), "big")).bit_count()
        assert apart <= len(np.setxor1d(a, b)) and len(sv.folded(a)) == sv.FOLDED_BITS // 8
        assert apart > 0 or edits == 0


@pytest.mark.parametrize("n", [150, 300])
def test_pairs_of_a_group_almost_alike_grow_no_faster_than_it(spark, monkeypatch, n):
    """The first texts lie aside: each is alike to few others, whose pairs were all made before."""
    rng = random.Random(21)
    vocab = [f"word{i}" for i in range(4000)]
    base, rows = rng.choices(vocab, k=150), []
    for d in range(n):
        words = list(base)
        for at in rng.sample(range(150), 3 if d < n // 5 else rng.randint(1, 2)):
            words[at] = rng.choice(vocab)
        rows.append((d, " ".join(words)))
    rows.append((n, " ".join(base)))
    sizes, write = {}, sv.materialise
    monkeypatch.setattr(sv, "find_links", lambda points, layout: spark.createDataFrame([], "a binary, b binary"))  # trees that find nothing

    def counted(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(sv, "materialise", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["component_id"] for r in sv.near_duplicates(df).collect()} == {0}
    assert sizes["star_pairs"] <= (sv.HUBS + 1) * len(rows) and sizes["missing_pairs"] <= len(rows)
