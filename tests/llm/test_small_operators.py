"""Chat rendering, WARC archives, mixing, the temporal list, quality rules and the class model on small fixtures."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexspan.llm import brown_lm, chat_render, mixing, quality_rules, url_asof, warc_zstd
from lexspan.llm import queries as llm
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    assert differences(llm.queries()[name](spark, SF), llm.oracle_sql()[name], SF) == ""


# Chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>[]/sINTROLE\\ a\n", max_size=30), st.sampled_from(["user", "assistant", "system", "", "[/ROLE] x"]))
def test_template_is_reversible_and_hides_control_strings(text, role):
    t = chat_render.InstTemplate()
    assert t.read(t.render([(role, text)])) == (role, text)
    assert not re.search(r"</?s>|\[/?(INST|ROLE)\]", t.escape(text))


def test_spans_and_digests(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "[INST] no"), (1, 2, "assistant", "[INST] no"), (None, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).repartition(3)
    rendered = chat_render.render_conversations(df)
    got = {r["conv_id"]: r for r in chat_render.read_back(rendered).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[None]["loss_chars"], got[2]["n_turns"]) == (4, 18, 0, 2)
    assert got[1]["loss_sha256"] == hashlib.sha256(b"[INST] no[INST] no").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\nx\nassistant\n\n").hexdigest()
    assert not any(r["rewrites"] for r in rendered.collect())
    assert chat_render.read_back(chat_render.render_conversations(df.limit(0))).collect() == []


class Rewriting(chat_render.InstTemplate):
    """Drops all but the last assistant text, as some templates do with reasoning."""

    def render(self, turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return super().render([(r, t if r != "assistant" or i == last else "...") for i, (r, t) in enumerate(turns)])


def test_a_template_that_rewrites_history_is_found(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"text {i}") for i in range(6)]
    out = chat_render.render_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Rewriting()).orderBy("turn").collect()
    assert [r["rewrites"] for r in out] == [False, False, False, True, False, True]
    assert out[3]["loss_start"] is None and out[1]["loss_start"] is not None
    df = spark.createDataFrame([*rows, (2, 0, "user", "q"), (2, 1, "assistant", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y" * 300_000)], "conv_id long, turn long, role string, text string")
    read = chat_render.read_back(chat_render.render_conversations(df, Rewriting()), Rewriting()).collect()
    by = {(r["conv_id"], r["n_turns"]): r for r in read if r["conv_id"] is not None}
    assert by[1, 6]["turns_sha256"] is None and by[1, 6]["rewritten_turns"] == 2 and by[2, 2]["loss_chars"] == 1
    assert sorted((r["n_turns"], r["loss_chars"]) for r in read if r["conv_id"] is None) == [(1, 0), (1, 300_000)]


class Twice(chat_render.InstTemplate):
    """Says each text twice, so that a probe cannot tell its place."""

    def render(self, turns):
        return super().render([(r, f"{t}|{t}") for r, t in turns])


def test_texts_that_cannot_be_located_are_flagged(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    out = chat_render.render_conversations(df, Twice()).orderBy("turn").collect()
    assert [(r["unlocated"], r["loss_start"]) for r in out] == [(False, None), (True, None)]
    assert chat_render.read_back(chat_render.render_conversations(df, Twice()), Twice()).first()["unlocated_turns"] == 1


# WARC


def test_archives_round_trip(spark, monkeypatch):
    same = "<p>" + "gleich " * 40 + "</p>"
    rows = [(i, f"http://h/{i}\n x", f"<html><body>{'wort ' * (i % 9)}{i}{'ende ' * 20}</body></html>") for i in range(60)]
    rows += [(100, None, same), (70, "http://d/", same), (100, None, same), (None, "http://n/", same), (90, "u", None), (91, "u", ""), (92, "u", "short"), (93, "v", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 600)
    folder, report = warc_zstd.write_warc(df)
    got = warc_zstd.read_warc(spark, folder, report).collect()
    assert len(got) == len(rows) == sum(r["n_records"] for r in report.collect()) and all(r["intact"] for r in got)
    bodies = {r["page_id"]: bytes(r["payload"]).decode() for r in got if r["record_type"] == "response"}
    assert all(bodies[i] == h for i, _, h in rows[:60])
    copies = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got if r["payload_digest"] == hashlib.sha256(same.encode()).hexdigest())
    n = len(same.encode())
    assert copies == [("100", "revisit", 70, n), ("100", "revisit", 70, n), ("70", "response", None, n), ("None", "revisit", 70, n)]
    assert {r["record_type"] for r in got if r["payload_bytes"] < 100 and r["page_id"] in (90, 91, 92, 93)} == {"response"}
    path = folder.removeprefix("file://")
    data = open(os.path.join(path, sorted(os.listdir(path))[0]), "rb").read()
    size = int.from_bytes(data[4:8], "little")
    assert data[:4] == bytes.fromhex("5d2a4d18") and int.from_bytes(data[8:12], "little") == warc_zstd.DICT_MAGIC and size > 500
    empty = warc_zstd.write_warc(df.limit(0))
    assert warc_zstd.read_warc(spark, *empty).collect() == []


@pytest.mark.parametrize(("most", "bits"), [(0, 1 << 25), (0, 64), (2, 1 << 25), (2, 64), (50_000, 64)])
def test_hot_and_other_digests_mark_the_same_revisits(spark, monkeypatch, most, bits):
    monkeypatch.setattr(warc_zstd, "BROADCAST_DIGESTS", most)
    monkeypatch.setattr(warc_zstd, "SIEVE_BITS", bits)
    long, short = "<p>" + "gleich " * 40, "kurz"
    rows = [(i, "u", long if i % 3 else f"{long}{i}") for i in range(30)] + [(40 + i, None, short if i % 2 else None) for i in range(20)] + [(90, "w", "x" * 400_000)]
    rows += [(100 + i, "v", f"{long}, {i % 10}") for i in range(25)] + [(None, "n", f"{long} ohne"), (None, "n", f"{long} ohne")]
    got = warc_zstd.mark_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == {(i, 1) for i in range(2, 30) if i % 3} | {(100 + i, 100 + i % 10) for i in range(10, 25)}
    assert all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"] for r in got)
    folder, report = warc_zstd.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    back = warc_zstd.read_warc(spark, folder, report).collect()
    assert len(back) == len(rows) and all(r["intact"] for r in back) and {len(r["payload"]) for r in back if r["page_id"] == 90} == {400_000}


def test_broken_archives_are_refused():
    data = warc_zstd.archive_head(b"") + warc_zstd.zstandard.ZstdCompressor().compress(b"x" * 100)
    assert list(warc_zstd.split_frames(data)) == [b"x" * 100]
    with pytest.raises(ValueError):
        list(warc_zstd.split_frames(data[:-3]))
    with pytest.raises(ValueError):
        list(warc_zstd.split_frames(b"\x00" * 20))


# Mixing


@pytest.mark.parametrize("rate", [0.0, 0.2, 1.0, 7.5])
def test_poisson_inversion(rate):
    steps = mixing.poisson_steps(rate)
    n = 20000
    counts = [sum(s <= (i + 0.5) / n for s in steps) for i in range(n)]
    assert abs(sum(counts) / n - rate) < 0.01 and abs(np.var(counts) - rate) < 0.05
    assert math.isclose(steps[0], math.exp(-rate))


def test_mixture_meets_its_targets(spark):
    rows = [(i, "a" if i % 10 else "b", f"t{i}") for i in range(20000)] + [(None, None, None), (5, "a", "again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, copy string")
    out = mixing.mix_sources(df, {"a": 1.0, "b": 1.0, "absent": 3.0, mixing.OTHERS: 0.0})
    n = Counter(r["source"] for r in out.select("source").collect())
    assert abs(n["a"] - 10000) < 400 and abs(n["b"] - 10000) < 400 and n[None] == 0
    again = mixing.mix_sources(df.repartition(7), {"a": 1.0, "b": 1.0, "absent": 3.0, mixing.OTHERS: 0.0})
    assert Counter(map(tuple, out.select("doc_id", "copy").collect())) == Counter(map(tuple, again.select("doc_id", "copy").collect()))
    assert out.where("n_copies < copy").count() == 0 and mixing.mix_sources(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"a": -1.0})


def test_a_small_source_beside_a_large_one_meets_its_target(spark):
    rows = [(i, "a" if i % 2000 else "b") for i in range(40000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix_sources(df, {"a": 1.0, "b": 1.0}).select("doc_id", "source", "rate", "n_copies", "copy").collect()
    n, of_b = Counter(r["source"] for r in out), {r["doc_id"]: r["n_copies"] for r in out if r["source"] == "b"}
    assert {r["rate"] for r in out if r["source"] == "b"} == {1000.0}
    assert abs(n["a"] - 20000) < 700 and abs(n["b"] - 20000) < 700
    assert len(of_b) == 20 and len(set(of_b.values())) > 10 and all(800 < c < 1200 for c in of_b.values())
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out)


def test_null_ids_are_drawn_apart(spark):
    df = spark.createDataFrame([(None, "a", f"text {i}", 1) for i in range(3000)] + [(1, "a", "same", 2)] * 2, "doc_id long, source string, text string, _point int")
    out = mixing.mix_sources(df, {"a": 1.0})
    assert out.columns[:4] == df.columns and {r["_point"] for r in out.select("_point").collect()} <= {1, 2}
    copies = Counter(r["text"] for r in out.where("doc_id IS NULL").select("text").collect())
    assert abs(sum(copies.values()) - 3000) < 250 and len(set(copies.values())) > 2
    assert out.where("doc_id IS NULL").select("shuffle_key").distinct().count() == sum(copies.values())
    with pytest.raises(ValueError):
        mixing.poisson_steps(800.0)


# Temporal list


def test_entries_active_at_fetch_time(spark):
    day = lambda m, d: dt.date(2024, m, d)
    entries = [("bad.example.com", day(1, 10), "add", "x"), ("bad.example.com", day(2, 10), "remove", "x"), ("example.com", day(3, 1), "add", "y"), ("bad.example.com/p", day(1, 1), "add", "z"), (None, day(1, 1), "add", "n"), ("same.org", day(5, 5), "add", "s"), ("same.org", day(5, 5), "remove", "s")]
    captures = [(1, "http://BAD.example.com:80/q", day(1, 9)), (2, "http://bad.example.com/q", day(1, 10)), (3, "http://u@bad.example.com./q", day(2, 9)), (4, "http://bad.example.com/q", day(2, 10)), (5, "http://bad.example.com/q", day(3, 2)), (6, "https://bad.example.com/p?x", day(6, 1)), (7, None, day(6, 1)), (8, "http://bad.example.com/", None), (9, "http://same.org/", day(5, 5)), (2, "http://bad.example.com/q", day(1, 10)), (10, "nonsense", day(1, 1))]
    e = spark.createDataFrame(entries, "pattern string, listed_on date, action string, category string")
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_on date").withColumn("level", F.lit(0))
    out = url_asof.temporal_filter(c, e).collect()
    assert len(out) == len(captures)
    assert sorted({(r["page_id"], r["blocked"], r["level"]) for r in out}) == [(1, False, None), (2, True, "host"), (3, True, "host"), (4, False, None), (5, True, "parent"), (6, True, "path"), (7, False, None), (8, False, None), (9, False, None), (10, False, None)]
    assert url_asof.temporal_filter(c.limit(0), e).collect() == []
    more = [("deep.org", day(1, 1), "add", "spam"), ("deep.org", day(1, 1), "add", "adult"), ("deep.org", day(2, 1), "remove", "spam"), ("a.deep.org/x/y", day(1, 1), "add", None), ("0.0.1", day(1, 1), "add", "n")]
    asked = [(1, "http://z.b.a.deep.org/", day(2, 2)), (2, "http://z.b.a.deep.org/", day(1, 2)), (3, "http://a.deep.org/x/y/z?q", day(3, 1)), (4, "http://a.deep.org/x", day(3, 1)), (5, "http://10.0.0.1/", day(3, 1)), (6, None, None), (6, None, None)]
    e, c = spark.createDataFrame(more, "pattern string, listed_on date, action string, category string"), spark.createDataFrame(asked, "page_id long, url string, fetched_on date").withColumn("_hit", F.lit(7))
    out = url_asof.temporal_filter(c, e).orderBy("page_id").collect()
    assert [(r["level"], r["pattern"], r["category"], r["_hit"]) for r in out] == [("parent", "deep.org", "adult", 7), ("parent", "deep.org", "adult", 7), ("path", "a.deep.org/x/y", None, 7), ("parent", "deep.org", "adult", 7), *[(None, None, None, 7)] * 3]
    assert {r["blocked"] for r in url_asof.temporal_filter(c, e.limit(0)).collect()} == {False}
    listed = spark.createDataFrame([(" Deep.ORG ", day(1, 1), "add", "s"), ("A.Deep.org/X/y", day(1, 1), "add", "t")], "pattern string, listed_on date, action string, category string")
    asked = spark.createDataFrame([(1, "https://DEEP.org/A", day(2, 2)), (2, "http://a.deep.ORG/X/y", day(2, 2)), (3, "http://a.deep.org/x/y", day(2, 2))], "page_id long, url string, fetched_on date")
    assert [r["pattern"] for r in url_asof.temporal_filter(asked, listed).orderBy("page_id").collect()] == ["deep.org", "a.deep.org/X/y", "deep.org"]


# Quality rules


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é 😀", max_size=60), min_size=1, max_size=12))
def test_measures_equal_brute_force(spark, texts):
    rows = list(enumerate([*texts, None, "a b c a b c a b c d", "x " * 3000]))
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("kept", F.lit("clash"))
    out = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(df).collect()}
    for i, t in rows:
        got = out[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == brute_quality(t), t
        assert not got["kept"]


def test_helper_names_of_the_input_survive(spark):
    df = spark.createDataFrame([("der the and of " * 30, 1, 2, 3, 4, "x")], "text string, words int, row int, __x int, _text int, Whole string")
    out = quality_rules.apply_quality_rules(df)
    assert out.columns[:6] == df.columns and tuple(out.select(*df.columns).first()) == tuple(df.first())


def test_clean_labelled_documents_stay(spark):
    out = llm.op10_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    long_enough = [r for r in out if r["n_words"] >= 50]
    assert sum(r["kept"] == bool(r["quality"]) for r in long_enough) >= 0.98 * len(long_enough)


# Class model


def test_exchange_separates_alternating_classes():
    table = np.zeros((8, 8))
    table[:4, 4:] = 5
    table[4:, :4] = 5
    cls = brown_lm.exchange_classes(table, 2)
    assert len(set(cls[:4])) == len(set(cls[4:])) == 1 and cls[0] != cls[4]


def test_own_moves_raise_mutual_information_most(spark):
    rng = np.random.default_rng(4)
    m, k = 12, 3
    table, cls = rng.integers(0, 6, (m, m)), rng.integers(0, k, m)
    rows = [(int(a * m + b), int(table[a, b])) for a in range(m) for b in range(m) if table[a, b]]
    place, best = brown_lm.own_moves(spark.createDataFrame(rows, "code long, n long").repartition(3), cls, k, 4, 10)
    f = lambda x: x * math.log(max(x, 1))

    def information(c):
        t = np.eye(k)[c].T @ table @ np.eye(k)[c]
        return sum(map(f, t.ravel())) - sum(map(f, t.sum(0))) - sum(map(f, t.sum(1)))

    assert sorted(place.tolist()) == list(range(4, 10))
    for w, c in zip(place.tolist(), best.tolist(), strict=True):
        tried = [information(np.where(np.arange(m) == w, x, cls)) for x in range(k)]
        assert tried[c] >= max(tried) - 1e-6


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "HELD", 7)
    texts = ["the cat sat on the mat", "The dog sat", "der hund und die katze", None, "", "die katze und der hund saß", "the  dog\tand the cat"] * 3
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "the cat und new words"), (2, None), (None, "the cat und new words"), (1, "der Hund")], "doc_id long, text string").withColumn("score", F.lit("x"))
    model = brown_lm.train(train, core=5, suffixes=4, classes=3, head=6)
    words = lambda t: [w.encode() for w in (t or "").lower().split()] + [b""]
    counts = Counter(w for t in texts for w in words(t))
    n, v = sum(counts.values()), len(counts)
    places = brown_lm.Places(list(model.head), model.suffixes)
    cls = lambda w: int(model.classes[places[w]])
    pairs = Counter((cls(a), cls(b)) for t in texts for a, b in zip([b"", *words(t)], words(t), strict=False))
    k = len(model.transitions)
    into = [sum(pairs[a, b] for a in range(k)) for b in range(k)]
    for a in range(k):
        for b in range(k):
            share = (into[b] + 1) / (sum(into) + k)
            assert math.isclose(10 ** model.transitions[a, b], (pairs[a, b] + brown_lm.BACKOFF * share) / (sum(pairs[a, c] for c in range(k)) + brown_lm.BACKOFF))
    size = Counter()
    for w, c in counts.items():
        size[cls(w)] += c + 1
    got = {(r["doc_id"], r["n_tokens"]): r for r in brown_lm.score(asked, model).collect()}
    assert len(got) == 4 and (model.tokens, model.vocabulary) == (n, v)
    for d, t in ((1, "the cat und new words"), (2, None), (None, "the cat und new words"), (1, "der Hund")):
        w = words(t)
        r = got[d, len(w)]
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs_tol=1e-9)
        before = [cls(b""), *map(cls, w)]
        want = sum(model.transitions[a, cls(x)] + math.log10((counts[x] + 1) / (size[cls(x)] + 1)) for a, x in zip(before, w, strict=False))
        assert math.isclose(r["score"], want, abs_tol=1e-9)
        assert r["n_known"] == sum(counts[x] > 0 for x in w)
    assert np.allclose((10**model.transitions).sum(1), 1)


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = llm.op9_brown_class_lm(spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.97 * sum(r["base_score"] for r in held)
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = brown_lm.train(empty)
    assert [(r["score"], r["base_score"], r["n_known"]) for r in brown_lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).collect()] == [(0.0, 0.0, 0)]


def test_the_head_is_cut_inside_equal_counts(spark):
    words = [f"w{i:03d}" for i in range(400)]
    docs = spark.createDataFrame([(" ".join(words),)] * 3 + [("w000 w001",)], "text string")
    model = brown_lm.train(docs, head=100, core=50)
    assert set(list(model.head)[:3]) == {brown_lm.END, b"w000", b"w001"} and set(model.head) == {brown_lm.END, *(w.encode() for w in words[:99])}


def test_equal_rows_are_dealt_apart(spark):
    """Rows that repeat a null id and an empty text share their keys, but no task takes them all."""
    df = spark.createDataFrame([(None, "", "en", "src1")] * 4000, "doc_id long, text string, lang string, source string").repartition(8)
    out = mixing.mix_sources(df)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert out.select("shuffle_key").distinct().count() < 10 and len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
