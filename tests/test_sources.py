"""Readers and writers against files with awkward content."""

from __future__ import annotations

import json

from lexspan.sources import files


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿section,text\n67C,"says ""hi"",\nthen leaves"\n3,\n', encoding="utf-8")
    df = files.read_csv(spark, str(p), "section string, text string")
    assert [tuple(r) for r in df.collect()] == [("67C", 'says "hi",\nthen leaves'), ("3", None)]
    assert files.read_csv(spark, str(p)).columns == ["section", "text"]
    files.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "out"), "section string, text string").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": "x", "n": 1}\n\n{broken\n{"q": "y", "n": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"q": "z", "n": 3}\n')
    assert sorted(tuple(r) for r in files.read_json_lines(spark, str(tmp_path / "*.jsonl"), "q string, n int").collect()) == [("x", 1), ("y", 2), ("z", 3)]
    (tmp_path / "t.json").write_text(json.dumps([["how", "Act", "3"], ["why", "Code", "4A"]]))
    assert [tuple(r) for r in files.read_json_tuples(spark, str(tmp_path / "t.json"), ["query", "act", "section"]).collect()] == [("how", "Act", "3"), ("why", "Code", "4A")]
    (tmp_path / "m.json").write_text(json.dumps({"7": {"act": "A", "section": "1"}}))
    assert [(r["key"], r["value"]["act"]) for r in files.read_json_map(spark, str(tmp_path / "m.json"), "struct<act:string,section:string>").collect()] == [("7", "A")]
    (tmp_path / "o.json").write_text(json.dumps([{"q": "x", "gold": ["1", "2"]}]))
    df = files.read_json_array(spark, str(tmp_path / "o.json"), "q string, gold array<string>")
    assert [tuple(r) for r in df.collect()] == [("x", ["1", "2"])]
    for _ in range(2):
        files.append_json_lines(df, str(tmp_path / "log"))
    assert files.read_json_array(spark, str(tmp_path / "log"), "q string, gold array<string>").count() == 2


def test_texts_and_listing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    (tmp_path / "in" / "b.bin").write_bytes(b"123")
    rows = files.read_texts(spark, str(tmp_path / "in" / "*.txt")).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["text"]) for r in rows] == [("a.txt", "one\ntwo")]
    assert [r["length"] for r in files.list_files(spark, str(tmp_path / "in"), "*.bin").collect()] == [3]


def test_years_are_pruned(spark, tmp_path):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    files.write_by_year(orders, str(tmp_path / "o"), "o_orderdate")
    df = files.read_by_year(spark, str(tmp_path / "o"), 1994, 1995)
    assert df.count() == orders.where("year(o_orderdate) BETWEEN 1994 AND 1995").count() > 0
    assert "PartitionFilters: [isnotnull(year" in df._jdf.queryExecution().toString()


def test_years_with_drifting_columns(spark, tmp_path):
    spark.range(2).selectExpr("cast(id as int) AS n", "'a' AS name", "1.5F AS x", "date'2020-01-01' AS d").write.parquet(f"{tmp_path}/2020")
    spark.range(2).selectExpr("id AS n", "'b' AS name", "2.5D AS x", "timestamp'2021-01-01 00:00:00' AS d", "true AS late").write.parquet(f"{tmp_path}/2021")
    spark.range(1).selectExpr("'z9' AS n", "3 AS x", "false AS late").write.parquet(f"{tmp_path}/2022")
    df = files.read_drifting(spark, [f"{tmp_path}/{y}" for y in (2020, 2021, 2022, 2020)])
    assert dict(df.dtypes) == {"n": "string", "name": "string", "x": "double", "d": "timestamp", "late": "boolean"}
    rows = sorted(((r["n"], r["name"], r["x"], r["late"]) for r in df.collect()), key=str)
    assert rows == sorted([("0", "a", 1.5, None), ("1", "a", 1.5, None)] * 2 + [("0", "b", 2.5, True), ("1", "b", 2.5, True), ("z9", None, 3.0, False)], key=str)


def test_a_repeated_flush_adds_nothing(spark, tmp_path):
    """The last batch's commit is lost, as in a crash between write and commit: the batch comes again, its rows do not."""
    import os

    from lexspan.streaming.sinks import flush_each

    spark.range(0, 10).write.mode("append").json(f"{tmp_path}/in")
    run = lambda: flush_each(spark.readStream.schema("id long").json(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination(120)
    run()
    spark.range(10, 20).write.mode("append").json(f"{tmp_path}/in")
    run()
    commits = sorted(f for f in os.listdir(f"{tmp_path}/cp/commits") if f.isdigit())
    for f in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{tmp_path}/cp/commits/{f}")
    run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["id"] for r in out.collect()) == list(range(20)) and out.select("batch").distinct().count() == len(commits)
