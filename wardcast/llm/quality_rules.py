"""Line-first quality rules, in column expressions only.

Each line is held against the rules on punctuation, navigation and boilerplate; lines that
fail are removed, and a document that loses too much of its text goes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import SEPARATOR_CLASS, count_of, trimmed, words_of

SYMBOLS = "[#*$%&|<>]"
#: Marks a sentence, a heading with a list, or a quotation may end in.
END_MARKS = ".!?:;\"')]…。！？"
#: Separators of menus and breadcrumbs.
MENU_MARKS = "[|»›•·]"
RULES = ("punctuation", "navigation", "boilerplate")
BOILERPLATE = (
    r"(?i)(cookie policy|uses cookies|accept cookies|privacy policy|terms of (use|service)|all rights reserved"
    r"|enable javascript|javascript is disabled|lorem ipsum|click here|read more|sign in|log in|sign up"
    r"|subscribe to|back to top|skip to content|share this|follow us)"
)


@dataclass(frozen=True)
class LineRules:
    """Shares are percentages of a line's characters, ``most_lost`` of a document's."""

    most_symbols: int = 10
    menu_marks: int = 3
    most_menu: int = 4
    most_shouts: int = 4
    boilerplate_words: int = 12
    most_lost: int = 50
    least_words: int = 10
    most_repeated: int = 20
    window: int = 5


def marks(text: Column, some: str) -> Column:
    """How many characters of the class ``some`` a text has."""
    return F.when(text.rlike(some), F.length(text) - F.length(F.regexp_replace(text, some, ""))).otherwise(0)


def judged(line: Column, text: Column, rules: LineRules) -> Column:
    """The line of a text, and whether it has a word and breaks each rule. ``text`` has the
    fields symbols, menus and shouts: whether it has any such marks at all."""
    n = F.length(line)
    menu = marks(line, MENU_MARKS)
    few_words = n - F.length(F.replace(line, F.lit(" "), F.lit(""))) < rules.boilerplate_words
    ends = F.right(line, F.lit(1)).isin(*END_MARKS) | line.rlike(f"[{re.escape(END_MARKS)}]{SEPARATOR_CLASS}+\\z")
    punctuation = (
        ~ends
        | (text["symbols"] & (100 * marks(line, SYMBOLS) > rules.most_symbols * n))
        | (text["shouts"] & (100 * count_of(line, "!!") > rules.most_shouts * n))
    )
    return F.struct(
        line.alias("line"),
        line.rlike(r"[^\x20\x09-\x0D]").alias("words"),
        punctuation.alias("punctuation"),
        (text["menus"] & (menu >= rules.menu_marks) & (100 * menu > rules.most_menu * n)).alias("navigation"),
        (few_words & line.rlike(BOILERPLATE)).alias("boilerplate"),
    )


def quality(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``row`` (all columns of a document as they came) with its measures and verdict.

    Adds the counts n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, the
    verdict of the counts ``base_failed``, the text ``cleaned`` of failing lines, the
    characters of lines with a word before and after (line_chars, kept_chars), the number
    of lines that break each rule, and ``kept``.

    A null text counts as empty; a text without words fails. Blank lines stay and count for
    nothing. Equal rows get equal results, an empty table an empty one. Names of further
    columns cannot clash, they are inside ``row``. Two different windows of words are taken
    for equal if their 64-bit hashes agree.
    """
    k = rules.window
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = df.select("*", trimmed(F.col("text")).alias("core"))
    df = df.select(
        "row",
        "text",
        words_of(F.col("core")).alias("words"),
        F.struct(
            F.col("text").rlike(SYMBOLS).alias("symbols"),
            F.col("text").rlike(MENU_MARKS).alias("menus"),
            F.col("text").contains("!!").alias("shouts"),
        ).alias("has"),
    )
    lines = F.split("text", "\n", -1)
    df = df.select("*", F.transform(lines, lambda x: judged(x, F.col("has"), rules)).alias("judged"))
    df = df.select("*", F.size("words").alias("n"), F.filter("judged", lambda x: x["words"]).alias("told"))
    df = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("each"))
    windows = F.transform(
        F.sequence(F.lit(0), F.col("n") - k), lambda i: F.xxhash64(*[F.get("each", i + j) for j in range(k)])
    )
    df = df.select("*", F.when(F.col("n") > k, windows).alias("hashes"))
    # Only a text that repeats a window goes on: its windows are sorted, and of those equal
    # to a neighbour the places are kept.
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    placed = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(repeats, placed).alias("placed"))
    same = F.filter(
        "placed",
        lambda x, i: F.coalesce(F.get("placed", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("placed", i + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.select("*", F.sort_array(F.transform(same, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda p, i: F.least(F.coalesce(F.get("starts", i + 1) - p, F.lit(k)), F.lit(k))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    rows = df.select(
        "row",
        "told",
        F.transform("told", lambda x: x["line"]).alias("lines"),
        F.filter("judged", lambda x: ~x["words"] | ~_any(x)).alias("left"),
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        marks(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")
    )
    rows = rows.select(
        "*",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[F.size(F.filter("told", _field(rule))).alias(f"n_{rule}") for rule in RULES],
        failed.alias("base_failed"),
        F.length(F.array_join("lines", "")).cast("long").alias("line_chars"),
        F.length(F.array_join(F.transform(F.filter("left", _field("words")), _field("line")), "")).cast("long").alias("kept_chars"),
    )
    lost = 100 * (F.col("line_chars") - F.col("kept_chars")) > rules.most_lost * F.col("line_chars")
    return rows.select(
        "row",
        F.array_join(F.transform("left", _field("line")), "\n").alias("cleaned"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        *[f"n_{rule}" for rule in RULES],
        "line_chars",
        "kept_chars",
        "base_failed",
        (~F.col("base_failed") & ~lost).alias("kept"),
    )


def _field(name: str):
    return lambda x: x[name]


def _any(line: Column) -> Column:
    out = F.lit(False)
    for rule in RULES:
        out = out | line[rule]
    return out
