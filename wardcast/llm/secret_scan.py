"""Secrets in texts: known forms, and strings that a battery of tests finds random.

A candidate is a long run of code characters. Its encoding is inferred, and the uniformity of
its alphabet (chi-squared), its runs and its serial correlation are tested: the battery. How
surprising it would be in ordinary text is told by a model of text, with the letter pairs of the
whole corpus: if text makes the string so many times less likely than drawing from its alphabet
does, that is its chance there at most. Which candidates are reported is settled over all
that were tried, by the false discovery rate with weights: the longer a string, and the better
it stands the battery, the more; one that the battery finds not random has none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm.shared import Scratch, by_chars

#: Known forms, in the order in which spans of one place are listed.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_KEYWORD = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
_PADDING = "(?:={1,6}(?![A-Za-z0-9+/_=-]))?"
#: Candidates of the battery, url-safe ones and those of base64: without ``.``, so that
#: sentences fall apart. ``=`` is padding at the end, else it divides a name and its value.
_RUNS = tuple(re.compile(f"[A-Za-z0-9{marks}]{{14,}}{_PADDING}") for marks in ("_-", "+/"))
LEAST = 20

#: Alphabets by which a candidate may have been encoded, the smallest that fits counts.
ALPHABETS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)


@dataclass(frozen=True)
class Battery:
    """``alpha``: below it a string is not random; from ten times that on it has full weight;
    ``rate``: share of false discoveries; ``text_changes``: how often ordinary text changes its
    character class inside of a run."""

    alpha: float = 0.001
    rate: float = 0.01
    text_changes: float = 0.08
    #: Places of the table of p-values, each a factor of 10^(1/8).
    bins: int = 400


def known(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, leftmost and without overlap in each kind."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of both kinds of runs; one may lie inside one of the other kind."""
    found = {m.span() for run in _RUNS for m in run.finditer(text) if len(m[0]) >= LEAST and m[0].strip("=-_+/")}
    return sorted(found)


def encoding(run: str) -> str | None:
    seen = set(run.rstrip("="))
    for name, alphabet in ALPHABETS:
        if seen <= set(alphabet):
            return name
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared(values: list[int], size: int) -> float:
    """P-value of uniform use of an alphabet. Its letters are put into as many equal cells as
    give five expected in each."""
    n = len(values)
    cells = max(2, min(size, n // 5))
    expected = [0.0] * cells
    for v in range(size):
        expected[v * cells // size] += n / size
    seen = [0] * cells
    for v in values:
        seen[v * cells // size] += 1
    x = sum((o - e) ** 2 / e for o, e in zip(seen, expected, strict=True))
    d = cells - 1  # Wilson and Hilferty's cube root
    z = ((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))
    return 0.5 * math.erfc(z / math.sqrt(2))


def runs(values: list[int], size: int) -> float:
    """P-value of the number of runs above and below the middle of the alphabet."""
    high = [2 * v >= size for v in values]
    a = sum(high)
    b = len(high) - a
    if not a or not b:
        return 0.0
    n = a + b
    count = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    mean = 1 + 2 * a * b / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((count - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial(values: list[int]) -> float:
    """P-value of the correlation of neighbours."""
    n = len(values)
    mean = sum(values) / n
    spread = sum((v - mean) ** 2 for v in values)
    if not spread:
        return 0.0
    r = sum((x - mean) * (y - mean) for x, y in zip(values, values[1:], strict=False)) / spread
    return _normal_tail((r + 1 / n) * math.sqrt(n))


def randomness(run: str) -> tuple[str, float]:
    """Encoding, and the p-value of the three tests combined (Fisher)."""
    name = encoding(run)
    if name is None:
        return "mixed", 0.0
    alphabet = dict(ALPHABETS)[name]
    values = [alphabet.index(c) for c in run.rstrip("=")]
    x = -sum(math.log(max(p, 1e-300)) for p in (chi_squared(values, len(alphabet)), runs(values, len(alphabet)), serial(values)))
    return name, math.exp(-x) * (1 + x + x * x / 2)


def weight(length: int, random: float, battery: Battery) -> float:
    """Of a candidate in the false discovery rate; 0 if the battery finds it not random."""
    return 0.0 if random < battery.alpha else math.log2(length) * min(1.0, random / (10 * battery.alpha))


# -- ordinary text ----------------------------------------------------------------------

#: Codes of bytes for the counts: letters without case, digits, other characters of code, the rest.
_DIGIT, _MARK, _REST = 26, 27, 28
_CODES = np.full(256, _REST, np.uint8)
_CODES[ord("a") : ord("z") + 1] = _CODES[ord("A") : ord("Z") + 1] = np.arange(26)
_CODES[ord("0") : ord("9") + 1] = _DIGIT
_CODES[[ord(c) for c in "_-+/="]] = _MARK


def pairs(docs: DataFrame) -> DataFrame:
    """(pair, n) of neighbouring codes in all texts, but for runs as long as candidates."""

    def run(batches: Iterator):
        import pyarrow as pa

        from wardcast.llm import word_hashes

        total = np.zeros(29 * 29, np.int64)
        for batch in batches:
            for _, _, data, starts in word_hashes.slices(batch.column(0)):
                codes = _CODES[data]
                edges = starts[1:-1]
                edges = edges[(edges > 0) & (edges < len(data))]  # nothing goes on over the end of a text
                inside = codes != _REST
                begins, ends = inside.copy(), inside.copy()
                begins[1:] &= ~inside[:-1]
                ends[:-1] &= ~inside[1:]
                begins[edges] |= inside[edges]
                ends[edges - 1] |= inside[edges - 1]
                first, last = np.flatnonzero(begins), np.flatnonzero(ends)
                for i in np.flatnonzero(last - first + 1 >= LEAST):
                    codes[first[i] : last[i] + 1] = _REST
                both = codes[:-1].astype(np.int64) * 29 + codes[1:]
                both[edges - 1] = 29 * 29 - 1
                total += np.bincount(both, minlength=29 * 29)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["pair", "n"])

    counts = docs.mapInArrow(run, "pair int, n bigint")
    return counts.groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class TextModel:
    """Natural logarithms of chances in ordinary text: ``follows`` of a letter after a letter,
    ``letters`` of a letter anywhere, ``digit`` that a number goes on."""

    follows: list[list[float]] = field(repr=False)
    letters: list[float] = field(repr=False)
    digit: float

    @classmethod
    def of(cls, counts: dict[int, int]) -> TextModel:
        """From counts of pairs; each thing counts once more than it was seen."""
        table = np.zeros(29 * 29)
        for pair, n in counts.items():
            table[pair] = n
        table = table.reshape(29, 29)
        follows = table[:26, :26] + 1
        letters = table[:, :26].sum(axis=0) + 1
        number = (table[_DIGIT, _DIGIT] + 1) / (table[_DIGIT].sum() + 2)
        return cls(
            np.log(follows / follows.sum(axis=1, keepdims=True)).tolist(), np.log(letters / letters.sum()).tolist(), math.log(number)
        )

    def surprise(self, run: str, encoding: str, changes: float) -> float:
        """Log10 of the chance that text makes a string so much less likely than drawing it from
        its alphabet does; 0 if it does not. A slash is left out, or every path would be
        surprising."""
        same, other = math.log1p(-changes), math.log(changes / 3)
        drawn = -math.log(len(dict(ALPHABETS)[encoding]))
        total, before, letter = 0.0, "", 0
        for c in run.rstrip("="):
            if c == "/":
                continue
            kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o"
            # A capital letter begins a word, so small ones after it are no change.
            goes_on = kind == before or (kind == "l" and before == "u")
            step = 0.0 if not before else same if goes_on else other
            if kind in "ul":
                code = ord(c.lower()) - 97
                step += self.follows[letter][code] if goes_on else self.letters[code]
                letter = code
            elif kind == "d":
                step += -math.log(10) + (self.digit if kind == before else 0.0)
            else:
                step -= math.log(3)
            total += step - drawn
            before = kind
        return min(0.0, total / math.log(10))


FOUND = (
    "doc_id bigint, base array<struct<start:bigint,kind:int,end:bigint>>, tried bigint, weight double, "
    "runs array<struct<start:bigint,end:bigint,encoding:string,random:double,text:double,weight:double,outer:int>>"
)


def scan(docs: DataFrame, model: TextModel, doc_id: str = "doc_id", text: str = "text", battery: Battery = Battery()) -> DataFrame:
    """Per document the known forms, how many candidates were tried and the sum of their
    weights, and those with a weight, with the log10 chance of each in ordinary text."""

    def run(batches: Iterator):
        import pyarrow as pa

        kinds = _schema(pa)
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            rows = ((key, body.as_py() or "") for key, body in pairs)
            for some in by_chars(rows, lambda r: len(r[1])):
                out = []
                for key, body in some:
                    left, tried = [], candidates(body)
                    for a, b in tried:
                        name, p = randomness(body[a:b])
                        if w := weight(b - a, p, battery):
                            chance = model.surprise(body[a:b], name, battery.text_changes)
                            left.append({"start": a, "end": b, "encoding": name, "random": p, "text": chance, "weight": w})
                    _nest(left)
                    base = [{"start": a, "kind": k, "end": b} for a, k, b in known(body)]
                    total = math.fsum(r["weight"] for r in left)
                    out.append({"doc_id": key, "base": base, "tried": len(tried), "weight": total, "runs": left})
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FOUND)


def _nest(runs: list[dict]) -> None:
    """Sets ``outer`` of a run that lies inside another to the place of that one. Runs of one
    kind are apart, so none lies inside two, and runs are sorted by start, then end."""
    widest = None
    for i, r in enumerate(runs):
        if widest is not None and r["start"] == runs[widest]["start"]:
            runs[widest]["outer"] = i  # starts where this longer one does
        r["outer"] = widest if widest is not None and r["end"] <= runs[widest]["end"] else None
        if widest is None or r["end"] > runs[widest]["end"]:
            widest = i


def _schema(pa):
    i, x = pa.int64(), pa.float64()
    base = pa.struct([("start", i), ("kind", pa.int32()), ("end", i)])
    found = pa.struct([("start", i), ("end", i), ("encoding", pa.string()), ("random", x), ("text", x), ("weight", x), ("outer", pa.int32())])
    return pa.schema([("doc_id", i), ("base", pa.list_(base)), ("tried", i), ("weight", x), ("runs", pa.list_(found))])


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", battery: Battery = Battery(), scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, base, found): known forms by start, then kind, and the random strings among
    the candidates of all documents, as (start, end, encoding, random, text). Url-safe runs
    and base64 runs are candidates both; of two reported, one inside the other, the longer
    stands.

    The rule on false discoveries is Benjamini and Hochberg's with weights, over all
    candidates of the table; a candidate's chance is divided by its :func:`weight`, and the
    weights have the mean one. Chances are sorted into ``battery.bins`` classes, each taken at its upper
    end, so the rate holds. Letter pairs are counted over all texts. A null text counts as empty.
    Each input row gives a row, equal rows equal ones; further columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    counts = {r["pair"]: r["n"] for r in pairs(docs.select(F.col(text).alias("text"))).collect()}  # 29 * 29 numbers
    rows = (scratch or Scratch(spark)).save("secrets", scan(docs, TextModel.of(counts), doc_id, text, battery))
    sums = rows.agg(F.sum("tried").alias("tried"), F.sum("weight").alias("weight")).first()
    mean = (sums["weight"] or 0.0) / (sums["tried"] or 1) or 1.0
    place = lambda r: F.least(
        F.greatest(F.floor(-8 * (r["text"] - F.log10(r["weight"] / F.lit(mean)))), F.lit(0)), F.lit(battery.bins - 1)
    ).cast("int")
    classes = rows.select(F.explode("runs").alias("r")).groupBy(place(F.col("r")).alias("at")).count().collect()  # bins rows at most
    limit = _discoveries({r["at"]: r["count"] for r in classes}, sums["tried"] or 0, battery)
    told = lambda r: place(r) >= F.lit(limit)
    found = F.filter("runs", lambda r: told(r) & ~F.coalesce(told(F.get("runs", r["outer"])), F.lit(False)))
    fields = ("start", "end", "encoding", "random", "text")
    return rows.select("doc_id", "base", F.transform(found, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias("found"))


def _discoveries(classes: dict[int, int], total: int, battery: Battery) -> int:
    """The first class that is reported, from the most surprising one down."""
    seen, limit = 0, battery.bins
    for at in sorted(classes, reverse=True):
        seen += classes[at]
        if 10 ** (-at / 8) <= battery.rate * seen / total:
            limit = at
    return limit
