"""Personal data in texts, in column expressions only.

Regular expressions propose spans, checksums confirm them, words nearby adjust the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import running

#: Kinds in the order in which spans are listed. The first four are the base: a match whose
#: form is confirmed is always reported, the score only ranks it.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

#: What proposes a span. Look-behinds with ``\G`` and possessive repeats change no match;
#: they keep long runs of one kind of character from being searched again from each place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]+(?:-[0-9]+)++",
}

#: Characters of an account number by country.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_NATIONAL = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in _LENGTHS.items())
#: Only the start of an account number is a match, what follows is looked at: groups that
#: belong to the next word or number must not hide a number, nor the next one.
_IBAN_START = r"([A-Z]{2}[0-9]{2})(?=(" + PATTERNS["iban"].removeprefix("[A-Z]{2}[0-9]{2}") + "))"

_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: Score of a confirmed match, and the words nearby that add to it.
SCORES = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 80, "ssn": 30}
CONTEXT = {
    "email": "e-?mail|contact|write to|@",
    "ip": "address|host|server|ip",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank",
    "ssn": "ssn|social security|social-security",
}
CONTEXT_GAIN = 20
#: A span beyond the base is reported from this score on.
THRESHOLD = 50
#: Characters before and after a match that are searched for context.
BEFORE, AFTER = 40, 20
#: Texts are cut into pieces of so many characters, from which those are taken.
NEAR_CHUNK = 256


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 1, F.get(doubled, d.cast("int"))).otherwise(d.cast("int")),
        ),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the mod-97 check; letters count from 10."""
    turned = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97,
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return match.rlike(rf"\A{_OCTET}(\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(F.lit(False))
    if kind == "ssn":
        return match.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z") & ~match.rlike(r"\A(000|666|9)|-00-|-0000\z")
    return F.lit(True)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns as they came), ``text``, and ``spans`` of each document.

    ``spans`` is an array of (kind, start, end, score) by kind as in ``KINDS``, then start;
    places are code points, the end exclusive. Matches of one kind are the leftmost ones
    that do not overlap; one that is not confirmed is dropped and not tried again further on.
    An account number is tried from each place, with all groups that follow, then with as
    many characters as its country has; the leftmost confirmed ones are taken. Context is
    searched in the whole text around a span, over other matches as well.

    A null text counts as empty and has no spans. Equal rows get equal results, an empty
    table an empty one. Names of further columns cannot clash, they are inside ``row``.
    """
    df = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = PATTERNS | {"iban": _IBAN_START}
    found = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()}
    df = df.select("*", *[c.alias(f"m_{k}") for k, c in found.items()])
    matched = F.greatest(*[F.size(f"m_{k}") for k in KINDS]) > 0
    follows = F.regexp_extract_all("text", F.lit(_IBAN_START), F.lit(2))
    df = df.select(
        "*",
        F.when(F.size("m_iban") > 0, follows).alias("follows"),
        F.when(matched, _chunks("text", NEAR_CHUNK)).alias("near"),
        F.length("text").cast("bigint").alias("chars"),
    )
    # The text between the matches gives their places.
    df = df.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, p in patterns.items()])
    df = df.select("*", F.transform("m_iban", lambda m, i: F.concat(m, F.get("follows", i))).alias("whole"))
    df = df.select("*", F.transform("whole", lambda x: F.regexp_extract(x, rf"\A(?:{_NATIONAL})", 0)).alias("short"))
    sure = lambda x: F.when(confirmed("iban", x), F.length(x)).otherwise(0)
    df = df.select(
        "*",
        F.zip_with(F.transform("whole", sure), F.transform("short", sure), lambda a, b: F.greatest(a, b)).alias("long"),
        *[F.transform(f"m_{k}", _width(f"p_{k}")).alias(f"w_{k}") for k in KINDS],
    )
    zero = F.lit(0).cast("bigint")
    df = df.select("*", *[running(F.col(f"w_{k}"), lambda a, x: a + x, zero).alias(f"b_{k}") for k in KINDS])

    def spans(kind: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = (F.get(f"b_{kind}", i) + F.length(F.get(f"p_{kind}", i))).cast("bigint")
            end = start + (F.get("long", i) if kind == "iban" else F.length(m))
            holds = F.get("long", i) > 0 if kind == "iban" else confirmed(kind, m)
            around = (
                _part("near", NEAR_CHUNK, F.greatest(start - BEFORE, F.lit(0)), start),
                _part("near", NEAR_CHUNK, end, F.least(end + AFTER, F.col("chars"))),
            )
            near = around[0].rlike(f"(?i)({CONTEXT[kind]})") | around[1].rlike(f"(?i)({CONTEXT[kind]})")
            score = F.lit(SCORES[kind]) + F.when(near, CONTEXT_GAIN).otherwise(0)
            return F.struct(
                F.lit(kind).alias("kind"),
                start.alias("start"),
                end.cast("bigint").alias("end"),
                F.when(holds, score).otherwise(F.lit(-1)).alias("score"),
            )

        least = 0 if kind in BASE else THRESHOLD
        kept = F.filter(F.transform(f"m_{kind}", one), lambda x: x["score"] >= least)
        return _apart(kept) if kind == "iban" else kept

    return df.select("row", "text", F.concat(*[spans(k) for k in KINDS]).alias("spans"))


def _apart(spans: Column) -> Column:
    """The leftmost spans that do not overlap."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:int>>")
    free = lambda kept, x: (F.size(kept) == 0) | (x["start"] >= F.get(kept, F.size(kept) - 1)["end"])
    return F.aggregate(spans, none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def _chunks(text: str, chunk: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))


def _part(chunks: str, chunk: int, a: Column, b: Column) -> Column:
    """Characters a to b, put together from the chunks they lie in."""
    first = F.floor(a / chunk).cast("int")
    last = F.floor((b - 1) / chunk).cast("int")
    whole = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return F.when(b > a, F.substring(whole, (a % chunk + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))


def _width(before: str):
    """Characters of a match and of the text between it and the one before."""
    return lambda m, i: (F.length(m) + F.length(F.get(before, i))).cast("bigint")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def base_of(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redact(found: DataFrame, chunk: int = 2048) -> DataFrame:
    """The result of :func:`find` with ``redacted``: each span, or run of spans that
    overlap, replaced by the kind of its first one in brackets. Texts without spans stay."""
    df = found.select("*", F.size("spans").alias("found"))
    df = df.select(
        "*",
        F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("kind")))).alias("sorted"),
        F.when(F.col("found") > 0, _chunks("text", chunk)).alias("chunks"),
    )
    df = df.select("*", F.transform("sorted", lambda s: s["b"]).alias("ends"))
    df = df.select("*", running(F.col("ends"), lambda a, b: F.greatest(a, b), F.lit(0).cast("bigint")).alias("reached"))
    # A span that starts at or after all ends so far opens a masked stretch.
    opens = F.filter(
        F.transform("sorted", lambda s, i: F.struct(s["a"].alias("a"), s["kind"].alias("kind"), F.get("reached", i).alias("from"))),
        lambda s: s["a"] >= s["from"],
    )

    part = lambda a, b: _part("chunks", chunk, a, b)
    masked = F.transform(opens, lambda s: F.concat(part(s["from"], s["a"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = part(F.array_max("ends"), F.length("text").cast("bigint"))
    return df.select(
        "row",
        "text",
        "spans",
        F.when(F.col("found") > 0, F.concat(F.array_join(masked, ""), tail)).otherwise(F.col("text")).alias("redacted"),
    )
