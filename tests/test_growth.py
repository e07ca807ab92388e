"""Work that must not grow faster than its input."""

from __future__ import annotations

import hashlib

import numpy as np

from lexspan.operators import evaluate, search
from lexspan.plans import catalog

QUERIES = catalog.queries()


def test_numbered_digests_are_md5():
    for heads in ([b"boot|1|", b"boot|7|"], [b"x" * 52], [b"y" * 53], [b""]):
        got = evaluate.numbered_md5(heads, 1203)
        for j, head in enumerate(heads):
            for i in (0, 9, 10, 999, 1202):
                assert "".join(f"{int(x):08x}" for x in got[:, j, i]) == hashlib.md5(head + str(i).encode()).hexdigest()


def test_sign_bootstrap_equals_row_by_row_draws(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "GROUPS", 2)
    rows = [(g, k * 7919, 40 + g, 9, 4 + g) for g in range(4) for k in range(40 + g)]
    got = {r["g"]: r for r in evaluate.sign_bootstrap(spark.createDataFrame(rows, "g int, k long, n long, b long, c long").repartition(3), "g", "k", "s", 50).collect()}
    for g in range(4):
        means = []
        for r in range(50):
            draws = [int(hashlib.md5(f"s|{k}|{r}".encode()).hexdigest()[:8], 16) % n for h, k, n, _, _ in rows if h == g]
            means.append(sum(-1 if i < 4 + g else i >= 40 + g - 9 for i in draws) / len(draws))
        assert got[g]["p_one_sided"] == round(sum(m <= 0 for m in means) / 50, 6)
        assert [got[g]["lo"], got[g]["hi"]] == np.percentile(means, [2.5, 97.5]).round(6).tolist()


def test_texts_are_read_once_for_all_models(spark):
    """The scores come from a written table, so no later step reads a text again."""
    for name in ("bootstrap_ci", "bootstrap_gaps", "error_rows"):
        assert not any("documents.parquet" in f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()), name


def test_classifiers_train_on_written_features(spark):
    """No pass of a model reads a text again."""
    for name in ("quality_classifier", "voting_classifier"):
        assert not any("documents.parquet" in f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()), name


def test_one_round_finds_the_best_by_words_and_vectors(spark, monkeypatch):
    """The depth, and with it what a task holds, does not grow until two separate streams meet."""
    names, write = [], search.materialise
    monkeypatch.setattr(search, "materialise", lambda df, name: names.append(name) or write(df, name))
    for name in ("low_confidence_gate", "boosted_topk"):
        names.clear()
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0
        assert names.count("candidates") == 1, name
