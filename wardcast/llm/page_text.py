"""Main text of web pages: what frames a host's articles is found as runs that its pages repeat.

1. Each page becomes blocks of text (:mod:`html_blocks`). Where a page marks its article, that is
   the main text, whole, with repeats, since articles are copied and quoted too. All else makes
   the page's token stream: frames, and in pages that mark no article every block.
2. The streams of a host form one text, and its suffixes are put in order by their first
   ``LEAST`` tokens. Neighbours that agree in them and come from distinct pages are a repeat;
   longer repeats are made of such, so a deeper order adds none. The order is made by the
   hash of those tokens, which Spark counts in tasks first: a run that a million pages have is one
   row of each task, and equal streams of a host go in once.
3. Copies of a page repeat all it has. So only a page with text of its own, a marked
   article or enough tokens that nobody repeats, can tell that what it shares is boilerplate.
4. A block all of whose tokens lie in such runs goes, others stay whole. What elements or their
   names mark as menu, notice, advert and the like goes also where it is unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.llm import html_blocks, word_hashes
from wardcast.llm.shared import Scratch

#: Tokens of a repeat at least.
LEAST = 5
#: Share of a stream's tokens, in percent, that must be its own for a page without an article
#: to tell what is boilerplate.
OWN = 20
#: Characters of HTML taken apart at once, unless one page has more.
SLICE = 1 << 22
#: Places of runs that may be broadcast (4 bytes each, by stream); more are joined.
MOST_BROADCAST = 2_000_000

_PAGES = (
    "page_id bigint, url string, host string, page bigint, article string, texts array<string>, framed array<boolean>, "
    "stream bigint, n bigint, runs array<bigint>"
)
_TEXT = "page_id bigint, url string, text string, n_outer bigint, n_repeated bigint"


def host_of(url):
    """The host in a URL, in lower case, without user and port; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)", 1)
    return F.when(host != "", host)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as main text, blocks of the stream, and hashes of the stream's runs."""
    for batch in batches:
        a = 0
        lengths = np.asarray(pc.binary_length(batch.column(4)).fill_null(0))
        while a < batch.num_rows:
            b = a + max(1, int(np.searchsorted(np.cumsum(lengths[a:]), SLICE, "right")))
            part = batch.slice(a, min(b, batch.num_rows) - a)
            a = min(b, batch.num_rows)
            articles, texts, framed, streams = [], [], [], []
            for html in part.column(4).to_pylist():
                found = html_blocks.blocks(html or "")
                article = " ".join(t for place, t in found if place == html_blocks.ARTICLE)
                outer = [(place, t) for place, t in found if place != html_blocks.ARTICLE]
                articles.append(article or None)
                streams.append(" ".join(t for _, t in outer))
                # With an article, no block outside of it is wanted later on.
                texts.append([] if article else [t for _, t in outer])
                framed.append([] if article else [place == html_blocks.FRAME for place, _ in outer])
            runs, ends, sizes = [np.zeros(0, np.uint64)], [0], []
            for _, _, data, starts in word_hashes.slices(pa.array(streams, pa.string()), SLICE):
                found, begins, size = word_hashes.shingles(data, starts, LEAST)
                runs.append(found)
                ends += (begins[1:] + ends[-1]).tolist()
                sizes += size.tolist()
            hashes = np.concatenate(runs).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(i) for i in range(4)],
                    pa.array(articles, pa.string()),
                    pa.array(texts, pa.list_(pa.string())),
                    pa.array(framed, pa.list_(pa.bool_())),
                    # Runs overlap, so the stream is told by their hashes in order.
                    pa.array([_digest(hashes[x:y]) for x, y in zip(ends, ends[1:], strict=False)], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes)),
                ],
                names=["page_id", "url", "host", "page", "article", "texts", "framed", "stream", "n", "runs"],
            )


def _digest(hashes: np.ndarray) -> int:
    """A hash of hashes in order."""
    places = np.arange(1, len(hashes) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(word_hashes.mix(hashes.view(np.uint64) ^ places).sum(dtype=np.uint64).view(np.int64)) if len(hashes) else 0


def covered(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in a run that begins at one of ``starts``."""
    change = np.zeros(n + LEAST + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + LEAST, n), -1)
    return np.cumsum(change)[:n] > 0


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text that is left of each page, from its blocks and the places of boilerplate."""
    for batch in batches:
        out = []
        for article, texts, framed, n, places in zip(*[batch.column(i).to_pylist() for i in range(2, 7)], strict=True):
            hit = covered(np.array(places or [], np.int64), n)
            if article is None:
                ends = np.cumsum([0] + [t.count(" ") + 1 for t in texts])
                kept = [t for i, t in enumerate(texts) if not framed[i] and not hit[ends[i] : ends[i + 1]].all()]
                article = " ".join(kept)
            out.append((article, n, int(hit.sum())))
        text, n, repeated = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(repeated, pa.int64())],
            names=["page_id", "url", "text", "n_outer", "n_repeated"],
        )


def _repeated(streams: DataFrame) -> DataFrame:
    """(host, run) of the runs that distinct pages have."""
    runs = streams.select("host", "first_page", "last_page", F.explode("runs").alias("run"))
    return (
        runs.groupBy("host", "run")
        .agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
        .where("first_page <> last_page")
        .select("host", "run")
    )


def _places(streams: DataFrame, runs: DataFrame) -> DataFrame:
    """(host, stream, n, places) of the streams that hold some of the runs."""
    placed = streams.select("host", "stream", "n", F.posexplode("runs").alias("place", "run"))
    found = placed.join(runs, ["host", "run"])
    return found.groupBy("host", "stream", "n").agg(F.collect_list("place").alias("places"))


def main_text(pages: DataFrame, scratch: Scratch | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_outer, n_repeated): the main text of each page, how many tokens
    stand outside its article (everywhere, if it marks none), and how many of those lie in
    runs that distinct pages of its host repeat.

    Null and empty HTML give an empty text. Pages whose URL is null or names no host are held
    against none. Pages of equal HTML count as one, so rows that repeat a page change nothing
    and each gets the same text; ids may be null. Further columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    given = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        host_of(F.col(url)).alias("host"),
        F.xxhash64(html).alias("page"),
        F.col(html).alias("html"),
    )
    read = scratch.save("pages", given.mapInArrow(_read, _PAGES))
    own = F.col("article").isNotNull().alias("marked")
    streams = (
        read.where("host is not null and n > 0")
        .groupBy("host", "stream", "n", own)
        .agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.first("runs").alias("runs"))
    )
    streams = scratch.save("streams", streams)
    alone = streams.where("not marked")
    shared = _places(alone, _repeated(streams))
    # Tokens in shared runs: each place covers the tokens from there on.
    reach = F.flatten(F.transform("places", lambda p: F.sequence(p, F.least(p + LEAST, F.col("n").cast("int")) - 1)))
    copies = shared.where((F.col("n") - F.size(F.array_distinct(reach))) * 100 < F.col("n") * OWN).select("host", "stream")
    copies = scratch.save("copies", copies)
    told = streams.where("marked").unionByName(alone.join(copies, ["host", "stream"], "left_anti"))
    places = _places(streams.dropDuplicates(["host", "stream"]), _repeated(told))
    places = scratch.save("places", places.select("host", "stream", "places"))
    size = places.agg(F.coalesce(F.sum(F.size("places") + 8), F.lit(0))).first()[0]
    if size <= MOST_BROADCAST:
        places = F.broadcast(places)
    columns = ("page_id", "url", "article", "texts", "framed", "n", "places")
    kept = read.join(places, ["host", "stream"], "left").select(*columns).mapInArrow(_keep, _TEXT)
    return kept.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_outer", "n_repeated")
