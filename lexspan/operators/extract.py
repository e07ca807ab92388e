"""Extraction: a pattern table applied to texts, numbered sections, spelling suggestions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import clean_name, low_confidence

# Short names of statutes and what they stand for, in alphabetical order.
SHORT_NAMES = {
    "C.P.C.": "Code of Civil Procedure",
    "CPC": "Code of Civil Procedure",
    "Cr.P.C.": "Code of Criminal Procedure",
    "CrPC": "Code of Criminal Procedure",
    "I.P.C.": "Indian Penal Code",
    "IBC": "Insolvency and Bankruptcy Code",
    "IPC": "Indian Penal Code",
    "NDPS Act": "Narcotic Drugs and Psychotropic Substances Act",
    "NGT Act": "National Green Tribunal Act",
    "NI Act": "Negotiable Instruments Act",
    "POCSO": "Protection of Children from Sexual Offences Act",
    "SARFAESI Act": "SARFAESI Act",
    "UAPA": "Unlawful Activities (Prevention) Act",
}
#: Words before Act or Code that make no name of it.
POINTING_WORDS = ("any", "every", "said", "such", "that", "the", "this")


@dataclass(frozen=True)
class Layout:
    """One order of a reference's parts: an expression, its groups for name, year and numbers (0 for none), the name if the text gives none, and what precedes a number."""

    kind: str
    regex: str
    numbers: int
    name: int = 0
    year: int = 0
    fixed_name: str = ""
    prefix: str = ""


def reference_layouts() -> list[Layout]:
    """The grammar of references.

    number   digits, a letter, clauses in brackets:       5A, 138(b)(ii)
    numbers  numbers parted by comma, and, & or slash:    3, 4 and 5A; 302/34
    mark     Section(s), sec(s)., s., ss., u/s, u/ss
    name     a short name; capitalised words before Code, or Code of ...; capitalised words, small
             words and brackets between the first of them and Act
    year     four digits after the name

    A reference has the name first, or the numbers first with of or under between, or is an article.
    """
    number = r"\d+[A-Za-z]?(?:\([0-9A-Za-z]+\))*"
    numbers = rf"({number}(?:\s*(?:,|/|&|and)\s*{number})*)"
    mark = r"\b(?:[Ss]ections?|[Ss]ecs?\.|u/ss?\.?|ss?\.)\s*"
    word = r"[A-Z][A-Za-z'&-]*"
    short = "|".join(n.replace(".", r"\.") + (r"\b" if n[-1].isalpha() else "") for n in sorted(SHORT_NAMES, key=len, reverse=True))
    code = rf"(?:{word}\s+)+Code\b|Code\s+of\s+{word}(?:\s+{word})?"
    act = rf"{word}(?:\s+(?:{word}|of|and|the|for|in|to|from|\([^()]{{1,60}}\)))*?\s+Act\b"
    name = rf"({short}|{code}|{act})(?:,?\s*(\d{{4}})\b)?"
    return [
        Layout("name_first", rf"\b{name}\s*[:,.–—-]?\s*{mark}{numbers}", name=1, year=2, numbers=3),
        Layout("number_first", rf"{mark}{numbers}\s+(?:(?:of|under)\s+)?(?:the\s+)?{name}", numbers=1, name=2, year=3),
        Layout("article", rf"\bArt(?:icles?|s?\.)\s*{numbers}", numbers=1, fixed_name="Constitution of India", prefix="Art. "),
    ]


#: What parts the numbers of a list.
NUMBER_BREAK = r"\s*(?:,|/|&|and)\s*"


def _found(text: Column, layout: Layout) -> Column:
    """References of one layout as an array of (name, section, source); each group is extracted once for the whole text."""
    group = lambda k: F.regexp_extract_all(text, F.lit(layout.regex), F.lit(k))
    rows = F.arrays_zip(*[group(k).alias(c) for c, k in (("numbers", layout.numbers), ("name", layout.name), ("year", layout.year))])

    def entries(row: Column) -> Column:
        if layout.fixed_name:
            name = F.lit(layout.fixed_name)
        else:
            own = clean_name(row["name"])
            full = F.coalesce(*[F.when(row["name"] == k, v) for k, v in SHORT_NAMES.items()], own)
            name = F.when(row["year"] != "", F.concat(full, F.lit(", "), row["year"])).otherwise(full)
        kept = F.when(F.lower(name).rlike(rf"^(?:{'|'.join(POINTING_WORDS)}) (?:act|code)\b"), F.array().cast("array<string>")).otherwise(F.split(row["numbers"], NUMBER_BREAK))
        return F.transform(kept, lambda s: F.struct(name.alias("name"), F.concat(F.lit(layout.prefix), s).alias("section"), F.lit(layout.kind).alias("source")))

    return F.flatten(F.transform(rows, entries))


def extract_references(df: DataFrame, text: str) -> DataFrame:
    """``df`` without its text, a row for each reference found: name, section, source, low_confidence. One pass, one explode, no Python."""
    found = F.concat(*[_found(F.coalesce(F.col(text), F.lit("")), layout) for layout in reference_layouts()])
    rows = df.withColumn("__r", F.explode(found))
    return rows.select(*[c for c in df.columns if c != text], "__r.*").withColumn("low_confidence", low_confidence(F.col("section")))


def extract_entities(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """A row for each match of each named pattern: kind, value."""


    def found_as(kind: str, regex: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("value")))

    found = F.concat(*[found_as(kind, regex) for kind, regex in patterns.items()])
    return df.withColumn("__r", F.explode(found)).select(*[c for c in df.columns if c != text], "__r.*")


def split_sections(df: DataFrame, text: str) -> DataFrame:
    """A row for each numbered section: ordinal, section_number, body. Headings are lines that start with a number, an optional letter and a full stop."""
    pieces = F.split(F.col(text), r"(?m)^(?=\d+[A-Z]?\.\s)")
    kept = F.filter(pieces, lambda s: s.rlike(r"^\d+[A-Z]?\.\s"))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(kept).alias("__p", "__s"))
    body = F.trim(F.regexp_replace(F.regexp_replace("__s", r"^\d+[A-Z]?\.\s+", ""), r"\s+$", ""))
    return rows.select("*", (F.col("__p") + 1).alias("ordinal"), F.regexp_extract("__s", r"^(\d+[A-Z]?)\.", 1).alias("section_number"), body.alias("body")).drop("__p", "__s")


def _deletions(word: Column) -> Column:
    """A word and all that is left of it after one or two deletions."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = once(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, lambda w: F.when(F.length(w) > 0, once(w)).otherwise(F.array(w))))))


#: Letters from which on words meet by their parts: a word's forms with letters left out grow with the square of its length.
LONG = 20


def _parts(length: Column, k: int) -> tuple[Column, Column]:
    """(start, length) of the k-th third of a word of that length, from 0."""
    start = F.floor(length * k / 3).cast("int")
    return start, F.floor(length * (k + 1) / 3).cast("int") - start


def _own_parts(word: Column) -> Column:
    """(length, third, letters) of a known word."""
    n = F.length(word)
    part = lambda k: F.struct(n.alias("n"), F.lit(k).alias("k"), F.substr(word, _parts(n, k)[0] + 1, _parts(n, k)[1]).alias("s"))
    return F.array(*map(part, range(3)))


def _sought_parts(word: Column) -> Column:
    """The same of all words that two edits can make of a word: one of their thirds is whole, at most two places off."""
    n = F.length(word)

    def at(gap: int, k: int, shift: int) -> Column:
        start, size = _parts(n + gap, k)
        return F.when((start + shift >= 0) & (start + shift + size <= n), F.struct((n + gap).alias("n"), F.lit(k).alias("k"), F.substr(word, start + shift + 1, size).alias("s")))

    return F.array_distinct(F.filter(F.array(*[at(gap, k, shift) for gap in range(-2, 3) for k in range(3) for shift in range(-2, 3)]), lambda x: x.isNotNull()))


def suggest_spelling(asked: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """(word, suggestion, distance) for asked words of 4 letters or more that are not known: distance 1, or 2 from 7 letters on; ties by the word.

    Words within two edits share a form with at most two letters left out, so candidates come from an
    equi-join on those forms; words of LONG letters or more share a third instead, which takes space in
    proportion to them. The exact distance decides.
    """
    unknown = asked.join(known, col, "left_anti").where(F.length(col) >= 4).select(F.col(col).alias("word"))
    right = known.select(F.col(col).alias("suggestion"))
    short, long = unknown.where(F.length("word") < LONG), unknown.where(F.length("word") >= LONG)
    by_form = short.withColumn("form", F.explode(_deletions(F.col("word")))).join(right.where(F.length("suggestion") < LONG + 2).withColumn("form", F.explode(_deletions(F.col("suggestion")))), "form")
    by_part = long.withColumn("part", F.explode(_sought_parts(F.col("word")))).join(right.where(F.length("suggestion") > LONG - 3).withColumn("part", F.explode(_own_parts(F.col("suggestion")))), "part")
    pairs = by_form.select("word", "suggestion").union(by_part.select("word", "suggestion")).distinct().withColumn("distance", F.levenshtein("word", "suggestion", 2))
    near = pairs.where((F.col("distance") >= 0) & (F.col("distance") <= F.when(F.length("word") >= 7, 2).otherwise(1)))
    best = near.groupBy("word").agg(F.min(F.struct("distance", "suggestion")).alias("b"))
    return best.select("word", "b.suggestion", "b.distance")
