"""Every query of the library against its SQL on the small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lexspan.operators import evaluate, features
from lexspan.plans import catalog, retrieval
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), SQL[name], SF) == ""


def test_queries_without_sql(spark):
    assert sorted(set(QUERIES) - set(SQL)) == ["classifier_rerank", "quality_classifier", "stacked_scores", "voting_classifier"]
    rows = QUERIES["quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 399
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "doc", "score", "rank"] and df.count() > 0


def test_some_results_are_not_empty(spark):
    """Queries whose rules could match nothing on these tables do match something."""
    for name in ("near_dup_leakage", "citation_extract", "entity_extract", "cleaner_v2", "levenshtein_suggest", "prefix_match_join", "set_difference", "law_sections", "context_snippets", "error_rows"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0, name


def test_scores_err_in_both_ways(spark):
    c = QUERIES["confusion_metrics"](spark, "/root/testdata/sf0.01").first()
    assert c["tp"] > c["fn"] and c["tn"] > 0 and c["fp"] + c["fn"] > 0
    assert [r["best"] for r in QUERIES["weight_grid"](spark, SF).collect()].count(True) == 1


def test_voting_is_right_mostly_and_reranking_permutes(spark):
    rows = QUERIES["voting_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 399 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    top = QUERIES["classifier_rerank"](spark, SF).collect()
    assert {r["rank"] for r in top} == {1, 2, 3, 4, 5} and all(1 <= r["old_rank"] <= 10 for r in top)
    assert len({(r["query"], r["doc"]) for r in top}) == len(top)


def test_gold_is_containment_whatever_surrounds_the_item(spark, tmp_path):
    items = [(0, "one two three four five six"), (1, "red green blue"), (2, "a  b\nc d e"), (3, None)] + [(10 + i, f"s{i}z") for i in range(1500)]
    texts = ['he said "one two three four five six" twice', "(one two three four five six).", "x\tone two three four five six\ry", "red green blue.", "za  b\nc d ef", "a b c d e", None, " ".join(f"s{i}z" for i in range(1500))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, retrieval.gold(spark, str(tmp_path)).collect()))
    assert got == sorted((q, d) for q, i in items for d, t in enumerate(texts) if i is not None and t is not None and i in t)


def test_strata_are_cut_exactly_whatever_the_ranges(spark):
    rows = [(i, None if i % 5 == 0 else i % 3 == 0) for i in range(400)] + [(7, True)] * 9 + [(None, False)]
    df = spark.createDataFrame(rows, "k long, label boolean").repartition(3)
    for buckets in (1, 4, 1 << 14):
        got = [tuple(r) for r in features.stratified(df, "label", "k", 25, "x", buckets).collect()]
        assert sorted(map(str, [r[:2] for r in got])) == sorted(map(str, rows))
        for c in (None, True, False):
            n = sum(r[1] is c for r in rows)
            assert sum(p == "test" for _, x, p in got if x is c) == -(-n // 4), (buckets, c)
    assert features.stratified(df.limit(0), "label", "k", 25, "x").count() == 0


def test_bootstrap_holds_the_mean_of_any_differences(spark):
    gaps = [(g, i, (i * 37 % 101 - 40) * 10_000 if g else None if i == 3 else 500_000) for g in (0, 1) for i in range(150)]
    got = {r["g"]: r for r in evaluate.paired_bootstrap(spark.createDataFrame(gaps, "g int, k long, gap long"), "g", "k", "gap", "x", 999).collect()}
    values = [v / 1e6 for g, _, v in gaps if g]
    mean = sum(values) / len(values)
    error = (sum((v - mean) ** 2 for v in values) / len(values) ** 2) ** 0.5
    assert (got[0]["lo"], got[0]["hi"], got[0]["p_one_sided"]) == (0.5, 0.5, 0.0)
    assert abs(got[1]["lo"] - (mean - 1.96 * error)) < 0.4 * error and abs(got[1]["hi"] - (mean + 1.96 * error)) < 0.4 * error
