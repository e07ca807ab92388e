"""Section numbers of a repealed law in questions and documents, and the numbers that replaced them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OldLaw:
    """How a law is named, by expressions in lower case; its last number; other laws; numbers that are known without its name, with words that must stand by."""

    names: tuple[str, ...]
    label: str
    new_label: str
    last: int
    others: tuple[str, ...] = ()
    famous: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def name(self) -> str:
        return "|".join(self.names)


# The penal code of 1860, the code that replaced it, and laws with sections of their own.
PENAL_CODE = OldLaw(
    names=("indian penal code", "ipc"),
    label="IPC",
    new_label="BNS",
    last=511,
    others=("code of criminal procedure", r"cr\.?p\.?c\.?", "evidence act", "contract act"),
    famous=(("420", ("cheat", "fraud", "section", "what is", "case")),),
)


def number_map(rows: DataFrame, old: str, new: str, relation: str, order: str) -> DataFrame:
    """(old, ordinal, new): what each old number became, in the order of the rows, each once; a number that was omitted has no new one.

    Rows of relation ``direct`` or ``split`` map, ``omitted`` ones tell that nothing does; others, and blank
    numbers or n/a, say nothing.
    """
    clean = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    said = lambda c: c.isNotNull() & ~c.isin("", "n/a")
    known = rows.select(clean(old).alias("old"), F.when(F.col(relation) != "omitted", F.trim(F.col(new).cast("string"))).alias("new"), F.col(relation).alias("r"), F.col(order).alias("o")).where(F.col("r").isin("direct", "split", "omitted") & said(F.col("old")))
    firsts = known.withColumn("new", F.when(said(F.lower("new")), F.col("new"))).groupBy("old", "new").agg(F.min("o").alias("o"))
    place = F.row_number().over(Window.partitionBy("old").orderBy(F.col("new").isNull(), "o"))
    return firsts.withColumn("ordinal", place).where("new IS NOT NULL OR ordinal = 1").select("old", "ordinal", "new")


def numbers_in_query(text: Column, law: OldLaw) -> Column:
    """Candidate numbers of the law in a question, each once, as mentioned.

    A letter after a blank belongs to its number (``302 a``). Where the law is named all numbers count,
    elsewhere those with letters, which other laws seldom have, and the famous ones beside their words.
    """
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b(\d+)\s+([a-z]{1,2})\b", "$1$2")
    every = lambda rx: F.regexp_extract_all(low, F.lit(rx), F.lit(1))
    none = F.array().cast("array<string>")
    famous = [F.when(F.rlike(low, F.lit(rf"\b{n}\b")) & F.rlike(low, F.lit("|".join(words))), F.array(F.lit(n))).otherwise(none) for n, words in law.famous]
    return F.array_distinct(F.when(F.rlike(low, F.lit(rf"\b(?:{law.name})\b")), every(r"\b(\d+[a-z]*)\b")).otherwise(F.concat(every(r"\b(\d+[a-z]+)\b"), *famous)))


def numbers_in_document(text: Column, law: OldLaw) -> Column:
    """Candidate numbers that a document gives to the law: lists before its name, then numbers right after it, then right before it; each once.

    A list is cut at another law's name, so that the numbers before that are not taken for this one's.
    """
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    every = lambda rx: F.regexp_extract_all(flat, F.lit(rx), F.lit(1))
    mark = r"(?:sections?|sec\.?|s\.?)"
    lists = every(rf"\b{mark}\s+([0-9a-z\s,/&–-]+?)\s*(?:of\s+the\s+)?(?:{law.name})\b")
    own = lambda part: F.element_at(F.split(part, rf"\b(?:{'|'.join(law.others)})\b"), -1) if law.others else part
    listed = F.flatten(F.transform(lists, lambda part: F.regexp_extract_all(own(part), F.lit(r"\b(\d+[a-z]*)\b"), F.lit(1))))
    short = law.names[-1]
    return F.array_distinct(F.concat(listed, every(rf"\b{short}\s*{mark}?\s*(\d+[a-z]*)\b"), every(rf"\b(\d+[a-z]*)\s*(?:\([a-z0-9\s]+\)\s*)?{short}\b")))


def in_range(number: Column, last: int) -> Column:
    return F.coalesce(F.regexp_extract(number, r"^(\d+)", 1).try_cast("int").between(1, last), F.lit(False))


def _mentions(df: DataFrame, key: str, numbers: Column, mapping: DataFrame) -> DataFrame:
    """(key, place, number, known, ordinal, new): a row for each mention and what it became."""
    said = df.select(key, F.posexplode(numbers).alias("place", "number"))
    return said.join(mapping.withColumn("known", F.lit(True)), said["number"] == mapping["old"], "left").select(key, "place", "number", F.coalesce("known", F.lit(False)).alias("known"), "ordinal", "new")


def expand_query_numbers(df: DataFrame, key: str, text: str, mapping: DataFrame, law: OldLaw = PENAL_CODE) -> DataFrame:
    """(key, numbers, expanded): the law's known numbers in a question, and the question with their new numbers added in order of mention."""
    rows = _mentions(df, key, numbers_in_query(F.col(text), law), mapping).where("known")
    phrase = F.lit(f"{law.new_label.lower()} section ")
    found = rows.groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct("place", "number"))).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("new").isNotNull(), F.struct("place", "ordinal", "new")))).alias("x"),
    )
    none = F.array().cast("array<string>")
    out = df.select(key, text).join(found, key, "left")
    added = F.transform("x", lambda x: F.concat(phrase, x["new"]))
    expanded = F.when(F.size("x") > 0, F.concat(F.coalesce(F.col(text), F.lit("")), F.lit(" "), F.array_join(added, " "))).otherwise(F.col(text))
    return out.select(key, F.coalesce(F.col("n.number"), none).alias("numbers"), expanded.alias("expanded"))


def law_references(df: DataFrame, key: str, text: str, mapping: DataFrame, law: OldLaw = PENAL_CODE) -> DataFrame:
    """(key, place, cited, now): the law's numbers in a document in order of mention; ``now`` is the first new number, null where none is known. No number is guessed."""
    rows = _mentions(df, key, numbers_in_document(F.col(text), law), mapping).where(F.col("known") | in_range(F.col("number"), law.last))
    firsts = rows.groupBy(key, "place", "number").agg(F.min_by("new", F.coalesce("ordinal", F.lit(0))).alias("new"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("place"))
    return firsts.select(key, place.alias("place"), F.concat(F.lit(law.label + " "), F.upper("number")).alias("cited"), F.when(F.col("new").isNotNull(), F.concat(F.lit(law.new_label + " "), F.col("new"))).alias("now"))


def split_in_range(df: DataFrame, text: str, heading: str, first: int, last: int, noise: Sequence[str] = ()) -> DataFrame:
    """(columns, section_number, ordinal, body): the sections ``first`` to ``last`` of a law's text from its anchor on.

    The text starts at the second ``heading`` (the first stands over the table of contents), else at
    the only one. A section starts at a number of one to three digits with a full stop before a capital or
    bracket, after an optional footnote mark, and ends at the next such number. Numbers out of range
    start no section of their own but end the one before; of a repeated number the first comes. Lines that
    are only a number are page marks; they and the ``noise`` expressions are taken out.
    """
    keep = [c for c in df.columns if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    second = F.locate(heading, whole, 1)
    after = F.when(second > 0, F.expr(f"locate('{heading}', coalesce(`{text}`, ''), locate('{heading}', coalesce(`{text}`, '')) + 1)")).otherwise(0)
    start = F.greatest(second, after)
    clean = F.regexp_replace(F.substr(whole, start), r"\n[ \t]*\d+[ \t]*(?=\n)", "")
    for expression in noise:
        clean = F.regexp_replace(clean, expression, " ")
    number = r"\d{1,3}\.\s+(?:\d+\s*)?(?=[A-Z\[])"
    pieces = F.filter(F.split(clean, rf"(?<!\d)(?={number})"), lambda p: F.rlike(p, F.lit(rf"^{number}")))
    rows = df.where(start > 0).select(*keep, F.posexplode(pieces).alias("__p", "__s"))
    own = F.regexp_extract("__s", r"^(\d{1,3})\.", 1).cast("int")
    rows = rows.withColumn("section_number", own).where(F.col("section_number").between(first, last))
    seen = F.row_number().over(Window.partitionBy(*keep, "section_number").orderBy("__p"))
    rows = rows.withColumn("__n", seen).where("__n = 1")
    body = F.trim(F.regexp_replace(F.regexp_replace("__s", r"^\d{1,3}\.\s+(?:\d+\s*)?", ""), r"\s+", " "))
    place = F.row_number().over(Window.partitionBy(*keep).orderBy("section_number"))
    return rows.select(*keep, "section_number", place.alias("ordinal"), body.alias("body"))
