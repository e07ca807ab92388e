"""Edit-aware counts against encoding the edited text whole."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lexspan.llm import token_tree as tt

TOK = tt.tokenizer(tt.default_vocabulary())
EDIT = st.tuples(st.integers(-3, 400), st.integers(0, 60), st.text(alphabet="ab Z'1\n\té.<中", max_size=12))


def check(text, edits):
    tree = tt.TokenTree.build(TOK, text)
    for at, drop, put in edits:
        tree.edit(at, drop, put)
        at = min(max(at, 0), len(text))
        text = text[:at] + put + text[max(at, min(at + drop, len(text))) :]
        assert tree.text() == text
        assert tree.tokens[1] == len(TOK.encoding.encode_ordinary(text))
        assert tree.chars[1] == len(text)
        again = tt.TokenTree.load(TOK, tree.text(), list(map(len, tree.texts)), tree.tokens[tree.width : tree.width + len(tree.texts)])
        assert again.tokens[1] == tree.tokens[1]
    return tree


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab cZ'sl1 \n\té.,<", max_size=300), st.lists(EDIT, max_size=6))
def test_small_texts(text, edits):
    check(text, edits)


def test_long_texts_and_locality():
    rng = random.Random(2)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "'s", "12", "é", ",", "Token", "don't", " a"]) for _ in range(6000))
    edits = [(rng.randrange(len(text)), rng.choice([0, 1, 3, 400]), rng.choice(["", " x", "  ", "'", "new words here", "\n\n"])) for _ in range(60)]
    tree = check(text, edits)
    assert tree.reencoded < 60 * 3 * tt.LEAF


def test_long_pre_tokens_and_large_edits_leave_the_rest_alone():
    rng = random.Random(6)
    text = "some words before it " * 400 + "q" * 20_000 + " and some words after it" * 400
    at = text.index("qqq")
    tree = check(text, [(at - 3, 0, "x"), (at + 20_010, 1, ""), (at - 5, 1, "y"), (at + 9_000, 0, " "), (at - 2, 2, "zz")])
    assert tree.reencoded < 5 * 4 * tt.LEAF
    tree = check(text[:5000], [(2500, 0, " ".join(rng.choice(["new", "words", "12"]) for _ in range(900))), (2600, 3, "a"), (10, 1, "b")])
    assert tree.reencoded < 2 * 900 + 12 * tt.LEAF and max(len(TOK.split(t)) for t in tree.texts) <= 2 * tt.LEAF


def test_operator_against_whole_encoding(spark):
    rows = [(1, "Mail a.b@c.org now\nor 10.0.0.1 ### end", "x"), (2, None, "y"), (3, "", None), (3, "plain text", "z"), (None, "call +49 30 1234567 $$$$ " * 90, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = tt.apply_edits(tt.build_trees(df), edits_of=tt.masking_edits).collect()
    assert len(out) == 5
    for r in out:
        assert r["n_tokens"] == len(TOK.encoding.encode_ordinary(r["text"] or "")) == sum(r["leaf_tokens"])
        assert r["n_chars"] == len(r["text"] or "") == sum(r["leaf_chars"])
    assert {r["text"] for r in out if r["doc_id"] == 1} == {"Mail <MAIL> now\nor <IP>  end"}
    assert tt.apply_edits(tt.build_trees(df.limit(0)), edits_of=tt.masking_edits).collect() == []


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, "other"), (None, "none")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 0, "Oh, "), (1, 1, 5, 6, "!"), (None, 1, 9, 9, None), (7, 1, 0, 1, "x")], "doc_id long, seq int, at int, drop int, put string")
    out = {r["doc_id"]: r for r in tt.apply_edits(tt.build_trees(tt.attach_edits(docs, edits))).collect()}
    assert out[1]["text"] == "Oh, hello!" and out[2]["text"] == "other" and out[None]["text"] == "none"
    assert [out[k]["n_edits"] for k in (1, 2, None)] == [2, 0, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z'1²½Ⅷ٣_\x1c\x1f\n\téß.<中\u0301\u00a0", max_size=40))
def test_both_splits_agree(text):
    assert TOK.split(text) == TOK.pattern.findall(text)
    assert sum(map(TOK.count, TOK.split(text))) == len(TOK.encoding.encode_ordinary(text))
