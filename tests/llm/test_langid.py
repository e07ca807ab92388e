"""Language ID: n-gram counting and ranking against brute force, defined results, held-out accuracy."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.llm import langid_rank as lr

SF = "/root/testdata/sf0.01"


def brute_ngrams(text):
    out = Counter()
    low = []
    for ch in text:
        c = ch.lower() if ch.isalpha() else None
        low.append(None if c is None else ord(c) if len(c) == 1 else ord(ch))
    low = [None, *low, None]
    for i in range(1, len(low) - 1):
        if low[i] is None:
            continue
        out[(low[i - 1] or 1) << 42 | low[i] << 21 | (low[i + 1] or 1)] += 1
        out[low[i] << 42] += 1
        if low[i + 1]:
            out[low[i] << 42 | low[i + 1] << 21] += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abÉé ß\n.1İ中", max_size=40))
def test_ngrams_equal_brute_force(text):
    codes, counts = lr.ngram_counts(text)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == brute_ngrams(text)


def test_blocks_do_not_change_counts(monkeypatch):
    text = "Über den Wolken muß die Freiheit " * 5
    want = brute_ngrams(text)
    monkeypatch.setattr(lr, "BLOCK", 7)
    codes, counts = lr.ngram_counts(text)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == want


def test_defined_results(spark):
    rows = [(1, "the cat and the dog", "en", "a"), (2, "der Hund und die Katze", "de", "b"), (3, None, "en", "c"), (4, "12 + 3", None, "d"), (5, "", "de", "e"), (None, "der Hund", "de", "f"), (1, "the cat and the dog", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [tuple(r) for r in lr.identify(df, lr.train_profiles(df)).select("doc_id", "lang_pred", F.col("score").between(0, 1)).collect()]
    assert sorted(got, key=str) == sorted([(1, "en", True), (2, "de", True), (3, "und", True), (4, "und", True), (5, "und", True), (None, "de", True), (1, "en", True)], key=str)
    assert lr.train_profiles(df.limit(0)) == {}
    assert {r["lang_pred"] for r in lr.identify(df, {}).collect()} == {"und"}
    with pytest.raises(ValueError):
        lr.train_profiles(df, max_langs=1)


def test_profiles_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120").repartition(5)
    profiles = lr.train_profiles(docs)
    for lang in ("en", "fr"):
        total = Counter()
        for r in docs.where(F.col("lang") == lang).collect():
            total += brute_ngrams(r["text"])
        assert profiles[lang].tolist() == [c for c, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[: lr.PROFILE]]


def test_held_out_accuracy(spark):
    from lexspan.llm.queries import op8_langid_rank_order

    got = op8_langid_rank_order(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
