"""Literal cases of the text functions, extraction, statistics and streams."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.functions import text as T
from lexspan.operators import evaluate, features
from lexspan.operators.extract import extract_references, split_sections, suggest_spelling
from lexspan.operators.search import BM25, search
from lexspan.streaming import limits, windows


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


def test_tokens(spark):
    got = one(spark, ["What is the Punishment under Section 302 a I.P.C.?", None, "É 7 x"], T.tokens)
    assert got == [["punishment", "under", "302"], [], ["7"]]


def test_names_and_numbers(spark):
    assert one(spark, [" The  Arms Act, ", "of Evidence"], T.clean_name) == ["Arms Act", "Evidence"]
    assert one(spark, ["Arms Act, 1959", "Arms Act"], T.name_without_year) == ["Arms Act", "Arms Act"]
    assert one(spark, ["12345", "302(2)", "1a2b3c45"], T.low_confidence) == [True, False, True]
    assert one(spark, ["3.0", " 66C "], T.number_key) == ["3", "66C"]


def test_scripts(spark):
    assert one(spark, ["ನಮಸ್ಕಾರ धारा", "धारा ३", "section 3", None], T.script_of) == ["kn", "hi", "en", "en"]
    assert one(spark, ["धारा ಕನ್ನಡ ok — end"], lambda c: T.stray_words(c, T.SCRIPTS["hi"])) == [["ಕನ್ನಡ"]]
    words = {"kn": ("nanna", "hege"), "hi": ("mera", "kya")}
    assert one(spark, ["nanna mera", "Mera kya nanna", "plain"], lambda c: T.romanised(c, words)) == ["kn", "hi", None]


def test_query_and_question_rules(spark):
    assert one(spark, ["  ", " ab ", "x" * 2001, "fine one", None], T.query_problem) == ["blank", "too_short", "too_long", "ok", "blank"]
    asked = ["What does the Act say?", "may I act alone?", "does section 12 apply", "see sec. 4", "word " * 26, "what does this law mean", ""]
    assert one(spark, asked, T.question_problem) == ["points at a statute", None, "cites a section", "cites a section", "too long", "points at a statute", "empty"]
    assert one(spark, ["Is a Domestic Violence Act order final?", None], T.question_problem) == ["points at a statute", "empty"]
    assert one(spark, [" (Hello  World)-“ ", None], T.cache_key) == ["hello world", ""]


def test_html_titles_and_forms(spark):
    html = '<html><script>var t="</p>";</script><p>a &lt;b&gt;<!-- no --> c&amp;nbsp;</p></html>'
    assert one(spark, [html, None], T.html_text) == ["a <b> c&nbsp;", ""]
    assert one(spark, ["Short title—body", "First. Second", "x" * 200], T.title_of) == ["Short title", "First", "x" * 150]
    got = one(spark, ["Name: A\nBad line\nName: B\nTotal sum: 3:4\nEmpty:"], T.key_values)
    assert [(e["k"], e["v"]) for e in got[0]] == [("name", "B"), ("total_sum", "3:4")]
    assert one(spark, ['```json\n[1]\n```', "[2]"], T.fenced_json) == ["[1]", "[2]"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Motor Vehicles Act, 1988 – s. 48", {("Motor Vehicles Act, 1988", "48", "name_first")}),
        ("Motor Vehicles Act, 1988 - s. 48", {("Motor Vehicles Act, 1988", "48", "name_first")}),
        ("Motor Vehicles Act 1988: Sections 48/49", {("Motor Vehicles Act, 1988", n, "name_first") for n in ("48", "49")}),
        ("the Unlawful Activities (Prevention) Act, ss. 15 and 18(b)", {("Unlawful Activities (Prevention) Act", n, "name_first") for n in ("15", "18(b)")}),
        ("u/ss 3, 4 and 5A of the Arms Act", {("Arms Act", s, "number_first") for s in ("3", "4", "5A")}),
        ("IPC s. 302/34", {("Indian Penal Code", s, "name_first") for s in ("302", "34")}),
        ("Cr.P.C. Section 482", {("Code of Criminal Procedure", "482", "name_first")}),
        ("under Section 482 Cr.P.C. it may", {("Code of Criminal Procedure", "482", "number_first")}),
        ("sec. 9 of the Code of Civil Procedure, 1908", {("Code of Civil Procedure, 1908", "9", "number_first")}),
        ("Section 9 of the Act; This Act, s. 4", set()),
        ("Article 21 of the Constitution, Arts. 14 & 19", {("Constitution of India", f"Art. {n}", "article") for n in (21, 14, 19)}),
        ("class. 5 of Acts and IPCX s. 5", set()),
        (None, set()),
    ],
)
def test_references(spark, text, want):
    rows = extract_references(spark.createDataFrame([(1, text)], "i int, t string"), "t").collect()
    assert {(r["name"], r["section"], r["source"]) for r in rows} == want


def test_sections_and_spelling(spark):
    got = split_sections(spark.createDataFrame([("head\n1. One. text\nmore\n2A. Two",)], "t string"), "t").collect()
    assert [(r["ordinal"], r["section_number"], r["body"]) for r in got] == [(1, "1", "One. text\nmore"), (2, "2A", "Two")]
    asked = spark.createDataFrame([("tenent",), ("landlrod",), ("cat",), ("tenant",), ("zzzzzz",)], "w string")
    known = spark.createDataFrame([("tenant",), ("landlord",)], "w string")
    assert {tuple(r) for r in suggest_spelling(asked, known, "w").collect()} == {("tenent", "tenant", 1), ("landlrod", "landlord", 2)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abc the12 É.!\n", max_size=30), min_size=1, max_size=8))
def test_tokens_equal_a_plain_rule(spark, values):
    plain = [[w for w in re.findall(r"[a-z0-9]+", v.lower()) if w not in T.STOP_WORDS and not re.fullmatch("[a-z]", w)] for v in values]
    assert one(spark, values, T.tokens) == plain


def test_mcnemar_and_holm(spark):
    got = {r["b"]: r for r in evaluate.mcnemar(spark.createDataFrame([(5, 1), (0, 0), (10, 2)], "b long, c long")).collect()}
    assert (got[5]["p_exact"], got[0]["p_exact"], got[10]["p_exact"]) == (0.21875, 1.0, 0.038574)
    assert got[10]["chi2"] == round(49 / 12, 6)
    ps = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03)], "f int, n string, p double")
    assert {r["n"]: r["p_holm"] for r in evaluate.holm(ps, "p", "f", "n").collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}


def test_average_precision_and_empty_confusion(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0)], "s double, y int")
    assert evaluate.average_precision(df, "s", "y").first()["ap"] == 0.75
    none = features.confusion(spark.createDataFrame([(0, 0)], "y int, p int"), F.col("y"), F.col("p")).first()
    assert (none["tn"], none["precision"], none["recall"], none["f1"]) == (1, 0.0, 0.0, 0.0)


def test_bm25_negative_idf_floor(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple plum"), (3, "apple fig fig")], "doc long, text string")
    asked = spark.createDataFrame([(1, "apple fig fig")], "query long, text string")
    scores = {r["doc"]: r["score"] for r in search(docs, asked, [BM25], 5, matching_only=True).collect()}
    assert scores[3] > scores[1] == scores[2] != 0


def test_rate_limit_does_not_record_refusals(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 10, 20, 61, 65, 71])]
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long").select("user_id", "event_id", F.timestamp_seconds("t").alias("ts"))
    got = {r["event_id"]: r["admitted"] for r in limits.admissions(df, 60, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}


@pytest.mark.parametrize("kind", ["tumbling", "sessions", "admissions"])
def test_streams(spark, tmp_path, kind):
    """The operators on a file stream read in one go give what they give on the table."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 6")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    make = {"tumbling": lambda e, late: windows.tumbling(e, "1 day", late), "sessions": lambda e, late: windows.sessions(e, "4 hours", late), "admissions": lambda e, late: limits.admissions_stream(e, 86400, 3) if late else limits.admissions(e, 86400, 3)}[kind]
    mode = "append" if kind == "admissions" else "complete"
    q = make(stream, "1 hour").writeStream.format("memory").queryName(f"out_{kind}").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table(f"out_{kind}").collect())) == sorted(map(tuple, make(events, None).collect()))
