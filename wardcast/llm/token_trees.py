"""Token counts that follow edits.

Each document keeps a segment tree over its pre-tokens, with the characters and tokens of
every subtree. An edit re-encodes the pre-tokens it touches and a little context, until the
pre-tokens fall together with the old ones again, and corrects the sums above them.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of a leaf when a tree is built; a leaf grows with what is inserted there.
LEAF = 32
#: How far before an edit a pre-token may have looked ahead: the pattern sees two characters
#: past the end of a match ("'" before "re").
LOOK = 3
#: Bytes of pre-tokens whose counts a worker keeps, about; beyond that the table starts anew. Each
#: takes its characters and so many bytes more.
MOST_KNOWN, EACH = 32 << 20, 160

TREES = "doc_id bigint, text string, lengths binary, counts binary"
EDITS = "array<struct<start:bigint,end:bigint,replacement:string>>"
RESULT = (
    "doc_id bigint, n_edits bigint, n_tokens_before bigint, n_tokens bigint, n_pre_tokens bigint, "
    "n_reencoded bigint, n_chars bigint"
)

_OPEN: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """Pre-tokens by pattern, and their numbers of tokens under a vocabulary of ranks."""

    def __init__(self, vocabulary: str, pattern: str):
        import base64

        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}
        self._bytes = 0

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            n = len(self._encode(piece))
            size = EACH + 4 * len(piece)
            if size <= MOST_KNOWN:
                if self._bytes + size > MOST_KNOWN:
                    self._known.clear()
                    self._bytes = 0
                self._known[piece] = n
                self._bytes += size
        return n


def encoder(vocabulary: str, pattern: str) -> Encoder:
    if (vocabulary, pattern) not in _OPEN:
        _OPEN[vocabulary, pattern] = Encoder(vocabulary, pattern)
    return _OPEN[vocabulary, pattern]


class Tree:
    """Leaves hold lengths and token counts of pre-tokens in order; ``chars`` and ``tokens``
    are the sums of all subtrees, the root at 1."""

    def __init__(self, lengths: list[int], counts: list[int]):
        n = max(1, -(-len(lengths) // LEAF))
        self.base = 1 << (n - 1).bit_length()
        self.lengths = [lengths[i * LEAF : (i + 1) * LEAF] for i in range(self.base)]
        self.counts = [counts[i * LEAF : (i + 1) * LEAF] for i in range(self.base)]
        self.chars = [0] * self.base + [sum(x) for x in self.lengths]
        self.tokens = [0] * self.base + [sum(x) for x in self.counts]
        for i in range(self.base - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, place: int) -> tuple[int, int, int]:
        """Leaf, number in it, and start of the first pre-token that ends after ``place``;
        the end of the tree if there is none."""
        i, start = 1, 0
        if self.chars[1] <= place:
            return self.base - 1, len(self.lengths[-1]), self.chars[1]
        while i < self.base:
            i *= 2
            if start + self.chars[i] <= place:
                start += self.chars[i]
                i += 1
        leaf = i - self.base
        for k, n in enumerate(self.lengths[leaf]):
            if start + n > place:
                return leaf, k, start
            start += n
        raise AssertionError("sums do not match the leaves")

    def replace(self, a: tuple[int, int], b: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Puts new pre-tokens in place of those from ``a`` to before ``b`` (leaf, number)."""
        for own, new in ((self.lengths, lengths), (self.counts, counts)):
            if a[0] == b[0]:
                own[a[0]][a[1] : b[1]] = new
            else:
                own[a[0]][a[1] :] = new
                for leaf in range(a[0] + 1, b[0]):
                    own[leaf] = []
                own[b[0]][: b[1]] = []
        touched = set()
        for leaf in range(a[0], b[0] + 1):
            i = self.base + leaf
            self.chars[i], self.tokens[i] = sum(self.lengths[leaf]), sum(self.counts[leaf])
            touched.add(i // 2)
        while touched - {0}:
            for i in touched:
                self._sum(i)
            touched = {i // 2 for i in touched if i > 1}

    def pieces(self) -> int:
        return sum(map(len, self.lengths))


def edit(tree: Tree, text: str, start: int, end: int, replacement: str, known: Encoder) -> tuple[str, int]:
    """The text after an edit, with the tree brought up to date, and how many pre-tokens were
    encoded again. Places outside the text count as its nearest end."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new = text[:start] + replacement + text[end:]
    shift = len(replacement) - (end - start)
    leaf, number, at = tree.find(max(0, start - LOOK))
    first = (leaf, number)
    old, fresh = at, []  # ``old``: a boundary of the old pre-tokens, before (leaf, number)
    place = at
    for match in known.pattern.finditer(new, at):
        # Where a new boundary past the edit is an old one as well, the rest is as it was.
        if place - shift >= end:
            while old < place - shift:
                while number >= len(tree.lengths[leaf]):
                    leaf, number = leaf + 1, 0
                old += tree.lengths[leaf][number]
                number += 1
            if old == place - shift:
                break
        fresh.append(match[0])
        place = match.end()
    else:
        leaf, number = tree.base - 1, len(tree.lengths[-1])
    tree.replace(first, (leaf, number), [len(x) for x in fresh], [known.count(x) for x in fresh])
    return new, len(fresh)


def build(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, text, lengths, counts): the leaves of each document's tree, 32 bits each.

    A null text counts as empty and has no leaves. Equal rows give equal rows. Of further
    columns only ``keep`` is carried, under the name ``edits``.
    """

    def run(batches: Iterator):
        import pyarrow as pa

        known = encoder(vocabulary, pattern)
        for batch in batches:
            texts, lengths, counts = [], [], []
            for body in batch.column("text"):
                value = body.as_py() or ""
                found = known.split(value)
                texts.append(value)
                lengths.append(array("I", map(len, found)).tobytes())
                counts.append(array("I", map(known.count, found)).tobytes())
            made = [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lengths, pa.binary()), pa.array(counts, pa.binary())]
            names = ["doc_id", "text", "lengths", "counts"]
            if keep:
                made, names = [*made, batch.column("edits")], [*names, "edits"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    chosen = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")]
    if keep:
        chosen.append(F.col(keep).cast(EDITS).alias("edits"))
    return docs.select(*chosen).mapInArrow(run, TREES + (f", edits {EDITS}" if keep else ""))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with the rows of an edit table (doc_id, number, start, end, replacement) as
    ``edits`` in order; the edits of one document must fit in memory."""
    grouped = edits.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("number", "start", "end", "replacement"))),
            lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["replacement"].alias("replacement")),
        ).alias("edits")
    )
    return docs.join(grouped, "doc_id", "left")


def recount(trees: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Applies the column ``edits`` of trees from :func:`build`, one after the other, each to
    the text that the last one left. Null edits are none; a null replacement is empty, a null
    place is 0. Gives the token counts before and after and what was encoded again."""

    def run(batches: Iterator):
        import pyarrow as pa

        known = encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("doc_id", "text", "lengths", "counts", "edits")}
                text = row["text"].as_py()
                tree = Tree(*[array("I", row[c].as_py()).tolist() for c in ("lengths", "counts")])
                before, again = tree.tokens[1], 0
                edits = row["edits"].as_py() or []
                for e in edits:
                    text, n = edit(tree, text, e["start"] or 0, e["end"] or 0, e["replacement"] or "", known)
                    again += n
                rows.append((row["doc_id"].as_py(), len(edits), before, tree.tokens[1], tree.pieces(), again, len(text)))
            names = [f.split()[0] for f in RESULT.split(", ")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return trees.mapInArrow(run, RESULT)


def sample_edits(text: Column, inserted: Column, first: Column) -> Column:
    """Three edits of a document: an insertion after a third, a cut of seven characters after
    two thirds, and another first character."""
    n = F.length(F.coalesce(text, F.lit("")))
    edits = [
        (F.floor(n / 3), F.floor(n / 3), inserted),
        (F.floor(2 * n / 3), F.floor(2 * n / 3) + 7, F.lit("")),
        (F.lit(0), F.lit(1), first),
    ]
    return F.array(
        *[F.struct(a.cast("bigint").alias("start"), b.cast("bigint").alias("end"), c.alias("replacement")) for a, b, c in edits]
    )
