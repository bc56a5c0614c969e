"""Evaluation passages inside corpus pages, by a distributed positional inverted index.

Every page is read in column order and cut into tokens; a token is indexed by the
hash of its folded form (letters that scanners confuse share a class), so most
misread words still meet.  The index is stored in shards of pages: each shard
holds its pages' words in reading order and their postings - page and position -
sorted by term.  Shards are written once to the shared folder and need no shuffle.

For every window of an item as long as a passage must be, the rarest terms by
document frequency (counted over all pages) are looked up in every shard.  Their
postings are offset-adjusted (position in page minus position in item); page and
item are a candidate where terms meet whose rarity, together, is beyond chance: near
one offset, or, as a long advert may move the offset by any number of words, within
one stretch of the item.  The exact check takes place beside the postings, on the
words the shard holds: from the shared words it walks in both directions, word by
word; misread letters, broken, split and joined words are forgiven, and whole lines
set between two lines of the article (adverts) are passed over.  Up to ``SKIP_LINES``
lines are passed over anywhere; any number of lines where ``LEAD`` words of the
passage stand on one side, as they do on one side or between two of at most two
such interruptions of ``least_words`` = 20.  A case needs ``least_words`` consecutive words.

The items are a stated query set: their rare terms are sent to the shards in blocks
of at most ``BLOCK`` terms, so what is sent is bounded whatever the number of items.

Defined results: null and empty pages or items give nothing; items with fewer
words than ``least_words`` cannot leak.  Pages are used whole.  Repeated rows give
one row.  Empty tables give an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tidemark.llm.page_layout import reading_order
from tidemark.sources.tables import materialise

_STRIP = re.compile(r"[^\w]|_")
_BREAK = re.compile(r"\s?[-¬\xad=‐~]$")
# Characters that scanners take for one another share the first of each group.
_CONFUSED = ["oce0", "il1j|!", "tfs5", "nuv", "bh8", "gq9"]
_FOLD = {ord(c): group[0] for group in _CONFUSED for c in group}
#: Rarity (bits: minus log2 of the share of pages a word stands in) that a chain of shared words needs whose
#: offsets never, once, or twice jump ahead, as at an advert; fixed, so that a passage is found in a collection of any size.
CHAIN_BITS = (12.0, 16.0, 20.0)
#: Most words of the item between two links of a chain: twice a passage of twenty.
REACH = 40
#: Words by which the offset may drift between two links without a jump: split, joined and broken words.
DRIFT = 4
#: Bits that the anchors of a window have without its rarest word, if its words have as many.
WINDOW_BITS = 12.0
#: A smaller collection is taken to have so many pages, as shares of few pages say nothing of rarity.
LEAST_PAGES = 1024
#: Most postings intersected at once.
_SLICE = 500_000
#: Most item words whose rare terms are sent to the shards at once.
BLOCK = 1_000_000
#: Words that stand together around a shared rare word before a walk over adverts is tried from it.
TOGETHER = 3
#: Words a worker remembers in the form they are indexed; it and the ``lru_cache`` sizes bound a worker's memory, not what is found.
FOLDED = 100_000
#: Pages turned into Python objects at once.
_PAGES = 128
#: Lines that may be passed over in one place whatever stands beside them.
SKIP_LINES = 14
#: Words that must stand together, short adverts aside, before any number of lines is passed over.
LEAD = 7


@lru_cache(20_000)
def clean(word: str) -> str:
    """Lower case, without accents and anything but letters and digits."""
    word = word.lower().replace("ſ", "s").replace("ß", "ss")
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return _STRIP.sub("", word)


@lru_cache(20_000)
def fold(word: str) -> str:
    """The form under which a cleaned word is indexed."""
    return word.replace("rn", "m").translate(_FOLD)


class Folder(dict):
    """Raw word to (clean word, 32-bit hash of its folded form), remembered per worker."""

    def __missing__(self, raw: str) -> tuple[str, int]:
        import xxhash

        word = clean(raw)
        if len(self) > FOLDED:
            self.clear()
        self[raw] = out = (word, xxhash.xxh32_intdigest(fold(word)) if word else 0)
        return out


def page_tokens(lines: list[str], folder: Folder) -> tuple[list[int], str]:
    """The hashes of a page's words in order, and its cleaned words: blanks between them, a line end after each line.

    At the first part of a broken word stands the hash of the whole word.
    """
    terms: list[int] = []
    rows: list[str] = []
    half = ""
    for line in lines:
        line = line.rstrip()
        broken = _BREAK.search(line) is not None
        found = [folder[raw] for raw in (_BREAK.sub("", line) if broken else line).split()]
        kept = [pair for pair in found if pair[0]]
        if not kept:
            continue
        if half:
            terms[-1] = folder[half + kept[0][0]][1]
        terms += [term for _, term in kept]
        rows.append(" ".join([word for word, _ in kept]))
        half = kept[-1][0] if broken and found[-1][0] else ""
    return terms, "\n".join(rows)


#: Words of a shard: bounds what a task holds while it intersects postings.
_SHARD_WORDS = 600_000
#: Bytes of a written row group, about one shard: bounds what a task holds while it writes and reads shards.
_ROW_GROUP = 16 << 20


def index_shards(df: DataFrame, id_col: str, text_col: str, boxes_col: str | None) -> DataFrame:
    """The index: one row per shard with ``docs`` (its page ids), ``pages`` (their words) and the postings sorted by term.

    ``terms`` and ``counts`` hold the distinct terms and how many postings each has;
    ``doc_at`` and ``pos`` hold the postings: the page's place in ``docs`` and the word's in the page.
    A page of ``pages`` has its cleaned words in reading order, blanks between them, a line end after each line.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, docs, texts, lists, n, kind = Folder(), [], [], [], 0, None

        def shard() -> pa.RecordBatch:
            sizes = [len(x) for x in lists]
            term = np.fromiter((t for x in lists for t in x), np.uint32, count=sum(sizes))
            doc_at = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes]) if sizes else np.zeros(0, np.int32)
            order = np.argsort(term, kind="stable")
            terms, counts = np.unique(term, return_counts=True)
            blobs = [terms.tobytes(), counts.astype(np.int32).tobytes(), doc_at[order].tobytes(), pos[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([docs], pa.list_(kind)), pa.array([texts], pa.list_(pa.string())), *(pa.array([b], pa.binary()) for b in blobs)], names=["docs", "pages", "terms", "counts", "doc_at", "pos"])

        for batch in _sliced(batches, _PAGES):
            kind = batch.column(0).type
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for doc, text, a, b, c in zip(*columns, strict=True):
                lines = reading_order(text, a or [], b or [], c or [])
                docs.append(doc)
                terms, words = page_tokens(lines, folder)
                lists.append(terms)
                texts.append(words)
                n += len(terms)
                if n > _SHARD_WORDS:
                    yield shard()
                    docs, texts, lists, n = [], [], [], 0
        if docs:
            yield shard()

    return pages(df, id_col, text_col, boxes_col).mapInArrow(run, f"docs array<{id_type}>, pages array<string>, terms binary, counts binary, doc_at binary, pos binary")


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def _one_shard_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside read and send each shard by itself: all of a partition's shards would stand in memory several times."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.parquet.columnarReaderBatchSize": "1"}
    before = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _posting_ranges(row: dict, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each asked term: where its postings begin in the shard and how many there are."""
    terms, counts = np.frombuffer(row["terms"], np.uint32), np.frombuffer(row["counts"], np.int32).astype(np.int64)
    starts = np.cumsum(counts) - counts
    at = np.searchsorted(terms, asked)
    there = at < len(terms)
    there[there] = terms[at[there]] == asked[there]
    at = np.where(there, at, 0)
    return np.where(there, starts[at] if len(terms) else 0, 0), np.where(there, counts[at] if len(terms) else 0, 0), there


def pages(df: DataFrame, id_col: str, text_col: str, boxes_col: str | None) -> DataFrame:
    """``doc_id``, ``text`` and the boxes' edges of pages that have a text."""
    none = F.array().cast("array<int>")
    edges = [(F.col(boxes_col)[e] if boxes_col else none).alias(e) for e in ("x0", "x1", "y0")]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *edges).where("text is not null and text <> ''")


def item_words(text: str) -> list[str]:
    return [w for w in map(clean, text.split()) if w]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id``, ``at``, ``term`` of each word of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for batch in batches:
            own, at, term = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, word in enumerate(item_words(text)):
                    own.append(item)
                    at.append(k)
                    term.append(folder[word][1])
            yield pa.RecordBatch.from_arrays([pa.array(own, batch.column(0).type), pa.array(at, pa.int32()), pa.array(np.array(term, np.uint32).view(np.int32))], names=["item_id", "at", "term"])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    return rows.mapInArrow(run, f"item_id {dict(items.dtypes)[id_col]}, at int, term int")


def document_frequency(shards: DataFrame, asked: list[int]) -> DataFrame:
    """``term``, ``df``: in how many pages each asked term stands, counted over all pages."""
    wanted = np.unique(np.array(asked, np.int64)).astype(np.uint32) if asked else np.zeros(0, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in _sliced(batches, 1):
            for row in batch.to_pylist():
                start, count, _ = _posting_ranges(row, wanted)
                doc_at = np.frombuffer(row["doc_at"], np.int32)
                for k in np.flatnonzero(count):
                    own = doc_at[start[k] : start[k] + count[k]]
                    total[k] += 1 + np.count_nonzero(own[1:] != own[:-1])  # postings of a term lie in page order
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[found].view(np.int32)), pa.array(total[found])], names=["term", "df"])

    return shards.select("terms", "counts", "doc_at").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def rare_anchors(terms: DataFrame, frequency: DataFrame, least_words: int, per_window: int, n_pages: int) -> DataFrame:
    """The items' words that anchor some window of ``least_words`` words, with ``df``.

    Of the words that stand in the pages at all, a window takes its rarest: ``per_window``,
    and more until ``WINDOW_BITS`` are reached without its rarest, or until it has no more.
    """
    known = terms.join(frequency, "term", "left").select("item_id", "at", "term", "df")
    starts = known.select("item_id", F.explode(F.sequence(F.col("at") - least_words + 1, F.col("at"))).alias("window"), "at", "term", "df").where("window >= 0")
    length = terms.groupBy("item_id").agg((F.max("at") + 1).alias("length"))
    whole = starts.join(length, "item_id").where((F.col("window") + least_words <= F.col("length")) & (F.col("df") > 0))
    by_rarity = Window.partitionBy("item_id", "window").orderBy("df", "at")
    ranked = whole.withColumn("rank", F.row_number().over(by_rarity)).withColumn("bits", F.log2(F.lit(float(max(n_pages, LEAST_PAGES))) / F.col("df")))
    before = by_rarity.rowsBetween(Window.unboundedPreceding, -1)
    others = F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("bits"))).over(before), F.lit(0.0))
    ranked = ranked.withColumn("short", others < WINDOW_BITS)
    return ranked.where((F.col("rank") <= per_window) | F.col("short")).select("item_id", "at", "term", "df").distinct()


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows with equal values begins."""
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = False
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def _may_chain(pair: np.ndarray, at: np.ndarray, pos: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The pairs that may hold a chain of enough bits, a superset: the rows come in order of pair.

    Chains without a jump are weighed exactly, and the heaviest three of a pair added up.
    """
    offset = pos - at + (1 << 30)
    order = np.lexsort((offset, pair))
    p, o, a, q = pair[order], offset[order], at[order], pos[order]
    before, after = [], []
    lag = 1
    while lag < len(p):  # rows of nearly equal offset lie side by side
        near = np.flatnonzero((p[lag:] == p[:-lag]) & (o[lag:] - o[:-lag] <= DRIFT))
        if not len(near):
            break
        one, two = near, near + lag
        g, h = np.where(a[one] < a[two], one, two), np.where(a[one] < a[two], two, one)
        good = (a[h] > a[g]) & (a[h] - a[g] <= REACH) & (q[h] > q[g])
        before.append(g[good])
        after.append(h[good])
        lag += 1
    weight = bits[order]
    if before:
        g, h, own = np.concatenate(before), np.concatenate(after), bits[order]
        grows = len(g) > 0
        while grows:
            held = weight[h]
            np.maximum.at(weight, h, weight[g] + own[h])
            fresh = weight[h]
            grows = not np.array_equal(fresh, held)
    tight = np.empty(len(weight))
    tight[order] = weight
    first = _heads(pair, at)  # a word of the item counts once
    best = np.maximum.reduceat(tight, first) if len(first) else tight
    p = pair[first]
    heads = _heads(p)
    number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p))))
    total, good = np.zeros(len(heads)), np.zeros(len(heads), bool)
    for least in CHAIN_BITS:
        top = np.maximum.reduceat(best, heads)
        total += top
        good |= total >= least
        place = np.flatnonzero(best == top[number])
        best[place[_heads(number[place])]] = 0.0
    return p[heads[good]]


def chained(pos: list[int], at: list[int], bits: list[float]) -> bool:
    """Whether shared words, in order in item and page, make up a chain of enough bits; rows by place in the item."""
    least = CHAIN_BITS
    done: list[tuple[int, int, int, float, float, float]] = []
    for q, a, own in zip(pos, at, bits, strict=True):
        none = once = twice = 0.0  # most bits ahead of this word, by the number of jumps
        for r, b, offset, x, y, z in reversed(done):
            if a - b > REACH:
                break
            if a == b or r >= q:
                continue
            step = q - a - offset
            if -DRIFT <= step <= DRIFT:
                if x > none:
                    none = x
                if y > once:
                    once = y
                if z > twice:
                    twice = z
            elif step > 0:
                if x > once:
                    once = x
                if y > twice:
                    twice = y
        once = max(none, once)
        none, once, twice = none + own, once + own, max(once, twice) + own
        if none >= least[0] or once >= least[1] or twice >= least[2]:
            return True
        done.append((q, a, q - a, none, once, twice))
    return False


def candidates(shards: DataFrame, anchors: list[tuple], n_pages: int, id_type: str, item_type: str, texts: list[tuple] | None = None, least_words: int = 20) -> DataFrame:
    """``doc_id``, ``item_id`` and ``hits`` (place in page, place in item) where rare terms meet.

    ``anchors`` are rows (item_id, at, term, df).  A word weighs the bits of its share of
    the ``n_pages`` pages; chance is taken to be beaten by a chain of shared words, in order in
    page and item, that weighs ``CHAIN_BITS``; an advert of any length makes the offset jump ahead
    once.  ``hits`` lists the rarest meeting words first; each is walked from, as a walk ends
    at the first break.

    With ``texts`` (rows of item id and text) each candidate is checked where it is found, on the words
    that the shard holds: ``doc_id``, ``item_id``, ``words`` of those with ``least_words`` consecutive words.
    """
    anchors = sorted(anchors, key=lambda a: (a[0], a[1]))
    items = sorted({a[0] for a in anchors})
    number = {item: k for k, item in enumerate(items)}
    own = np.array([number[a[0]] for a in anchors], np.int64)
    place = np.array([a[1] for a in anchors], np.int64)
    term = np.array([a[2] for a in anchors], np.int64).astype(np.int32).view(np.uint32)
    weight = np.array([np.log2(max(n_pages, LEAST_PAGES) / a[3]) for a in anchors], float)
    owner = np.searchsorted(own, np.arange(len(items) + 1))  # an item's first anchor

    def slices(count: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of whole items with at most ``_SLICE`` postings, or one item with more."""
        upto = np.concatenate([[0], np.cumsum(count)])[owner]
        k = 0
        while k < len(items):
            j = max(k + 1, int(np.searchsorted(upto, upto[k] + _SLICE, side="right")) - 1)
            yield k, j
            k = j

    def meet(all_docs: np.ndarray, all_pos: np.ndarray, n_docs: int, start: np.ndarray, count: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, place in item and place in page of the words that meet in candidates among items lo to hi."""
        first, last = owner[lo], owner[hi]
        start, count = start[first:last], count[first:last]
        anchor = np.repeat(np.arange(first, last), count)
        posting = np.arange(len(anchor)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        pair = all_docs[posting].astype(np.int64) * (hi - lo) + (own[anchor] - lo)
        # a pair whose words are not rare enough together, wherever they stand, is out
        least = CHAIN_BITS[0]
        if n_docs * (hi - lo) <= 4 * _SLICE:
            use = (np.bincount(pair, weights=weight[anchor], minlength=1) >= least)[pair]
        else:
            some, back = np.unique(pair, return_inverse=True)
            use = (np.bincount(back, weights=weight[anchor], minlength=len(some)) >= least)[back] if len(some) else np.zeros(0, bool)
        anchor, pair, pos = anchor[use], pair[use], all_pos[posting[use]].astype(np.int64)
        # anchors come in order of item and place, the postings of each in order of page and place
        order = np.argsort(pair, kind="stable")
        pair, at, pos, bits = pair[order], place[anchor[order]], pos[order], weight[anchor[order]]
        if len(pair):
            kept = np.isin(pair, _may_chain(pair, at, pos, bits))
            pair, at, pos, bits = pair[kept], at[kept], pos[kept], bits[kept]
            heads = _heads(pair)
            ends = np.append(heads[1:], len(pair))[: len(heads)]
            holds = [chained(pos[i:j].tolist(), at[i:j].tolist(), bits[i:j].tolist()) for i, j in zip(heads.tolist(), ends.tolist(), strict=True)]
            kept = np.repeat(np.array(holds, bool), ends - heads)
            pair, at, pos, bits = pair[kept], at[kept], pos[kept], bits[kept]
        order = np.lexsort((pos, -bits, pair))
        p = pair[order]
        return p // (hi - lo) * len(items) + p % (hi - lo) + lo, at[order], pos[order]

    asked: dict[object, list[list[str]]] = {}
    for item, text in texts or []:
        asked.setdefault(item, []).append(item_words(text))

    def found_in(row: dict) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Place in ``docs`` times the number of items, plus the item's number, of each candidate; and its hits."""
        start, count, _ = _posting_ranges(row, term)
        all_docs, all_pos = np.frombuffer(row["doc_at"], np.int32), np.frombuffer(row["pos"], np.int32)
        parts = [meet(all_docs, all_pos, len(row["docs"]), start, count, lo, hi) for lo, hi in slices(count)]
        p, a, q = (np.concatenate([x[k] for x in parts] or [np.zeros(0, np.int64)]) for k in range(3))
        heads = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, int)
        ends = np.append(heads[1:], len(p))[: len(heads)]
        return p[heads], [list(zip(q[i:j].tolist(), a[i:j].tolist(), strict=True)) for i, j in zip(heads, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 1):
            kind = batch.schema.field("docs").type.value_type
            for row in batch.to_pylist():
                pairs, hits = found_in(row)
                docs, number_of = [row["docs"][k // len(items)] for k in pairs.tolist()], [items[k % len(items)] for k in pairs.tolist()]
                met = pa.array([[{"pos": x, "at": y} for x, y in h] for h in hits], pa.list_(pa.struct([("pos", pa.int32()), ("at", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(number_of), met], names=["doc_id", "item_id", "hits"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 1):
            kind = batch.schema.field("docs").type.value_type
            for row in batch.to_pylist():
                pairs, hits = found_in(row)
                docs, own, lengths = [], [], []
                at, page = -1, None
                order = np.argsort(pairs, kind="stable")
                for k in order.tolist():
                    place, item = divmod(int(pairs[k]), len(items))
                    if place != at:
                        at, page = place, Page.of(row["pages"][place])
                    n = max(page.longest_passage(words, hits[k], least_words) for words in asked[items[item]])
                    if n >= least_words:
                        docs.append(row["docs"][place])
                        own.append(items[item])
                        lengths.append(n)
                yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(own, own_type), pa.array(lengths, pa.int32())], names=["doc_id", "item_id", "words"])

    if texts is None:
        return shards.mapInArrow(run, f"doc_id {id_type}, item_id {item_type}, hits array<struct<pos int, at int>>")
    own_type = to_arrow_type(DataType.fromDDL(item_type))
    return shards.mapInArrow(checked, f"doc_id {id_type}, item_id {item_type}, words int")


@lru_cache(20_000)
def _places(word: str) -> dict[str, int]:
    """Where each letter stands in the word, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(word):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most + 1`` if it is more; a column of the table at a time, as bits of up and down steps."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a:
        return len(b)
    there, whole, last = _places(a), (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, cost = whole, 0, len(a)
    for c in b:
        equal = there.get(c, 0)
        level = equal | down
        across = ((equal & up) + up ^ up) | equal
        more, less = down | ~(across | up) & whole, up & across
        cost += (more & last != 0) - (less & last != 0)
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(level | more)) & whole, more & level & whole
    return min(cost, most + 1)


@lru_cache(50_000)
def _letters(word: str) -> int:
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


@lru_cache(50_000)
def same_word(a: str, b: str) -> bool:
    """Whether b may be a misread a."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if n <= 2:
        return len(a) == len(b) and fold(a) == fold(b)
    most = 1 if n <= 5 else 2 if n <= 8 else 3
    if abs(len(a) - len(b)) > max(most, n // 2):
        return False
    if fold(a) == fold(b):
        return True
    if (_letters(a) ^ _letters(b)).bit_count() > 2 * most:  # an edit changes two letters of a word's set at most
        return False
    return _distance(a, b, most) <= most


#: Most edits by the length of the longer word; -1: only words of equal folded form.
_EDITS = [-1, -1, -1, 1, 1, 1, 2, 2, 2]


@lru_cache(50_000)
def _record(word: str) -> tuple[str, str, int, int, int, int]:
    """The word, its folded form, the letters of both as bits, and both lengths: to tell most unlike words cheaply."""
    folded = fold(word)
    return word, folded, _letters(word), _letters(folded), len(word), len(folded)


def _unlike(a: tuple, b: tuple) -> bool:
    """Whether two words can't be the same; never so of words that :func:`same_word` takes for the same."""
    if a[1] == b[1]:
        return False
    n = a[4] if a[4] > b[4] else b[4]
    most = _EDITS[n] if n < 9 else 3
    return not -most <= a[4] - b[4] <= most or (a[2] ^ b[2]).bit_count() > 2 * most


def _unlike_joined(a: tuple, b: tuple, whole: tuple) -> bool:
    """The same of two parts and a whole word; parts may fold otherwise where they meet."""
    if -3 <= a[4] + b[4] - whole[4] <= 3 and ((a[2] | b[2]) ^ whole[2]).bit_count() <= 6:
        return False
    return not -1 <= a[5] + b[5] - whole[5] <= 1 or ((a[3] | b[3]) ^ whole[3]).bit_count() > 3


class Passage:
    """Walks from a shared word through page and item, one direction at a time."""

    def __init__(self, words: list[str], lines: list[int], item: list[str] | None = None) -> None:
        self.words, self.of, self.item, self.want = words, [_record(w) for w in words], [], []
        self.ask(item or [])
        n = len(words)
        self.line_start = [i for i in range(n) if i == 0 or lines[i] != lines[i - 1]]
        self.next_line = [0] * n  # index into line_start of the line after a word's own
        k = 0
        for i in range(n):
            while k < len(self.line_start) and self.line_start[k] <= i:
                k += 1
            self.next_line[i] = k
        self.ends_line = [i + 1 == n or lines[i] != lines[i + 1] for i in range(n)]

    def ask(self, item: list[str]) -> None:
        """Sets the item that walks follow."""
        self.item, self.want = item, [_record(w) for w in item]
        self.ended: dict[tuple[int, int], int] = {}  # where in the item walks ended that stepped on a place
        self.far_ended: dict[tuple[int, int], int] = {}  # the same of walks that pass over any number of lines

    def _at(self, p: int, i: int) -> tuple[int, int] | None:
        """(words of the page, words of the item) used if item word i stands at p."""
        words, item = self.of, self.want
        if p >= len(words) or i >= len(item):
            return None
        a, v = words[p], item[i]
        if a[0] == v[0] or not _unlike(a, v) and same_word(v[0], a[0]):
            return 1, 1
        # split in two or three by a stray blank or a line break
        if a[4] < v[4] and p + 1 < len(words):
            b = words[p + 1]
            if not _unlike_joined(a, b, v) and same_word(v[0], a[0] + b[0]):
                return 2, 1
            if a[4] + b[4] < v[4] and p + 2 < len(words):
                c = words[p + 2]
                if a[4] + b[4] + c[4] <= v[4] + 3 + v[4] // 2 and same_word(v[0], a[0] + b[0] + c[0]):
                    return 3, 1
        if a[4] > v[4] and i + 1 < len(item) and not _unlike_joined(v, item[i + 1], a) and same_word(v[0] + item[i + 1][0], a[0]):
            return 1, 2
        return None

    def _sure(self, p: int, i: int, words: int = 2) -> bool:
        """Whether the text goes on here: this word and the next, or so many."""
        for _ in range(words):
            step = self._at(p, i)
            if step is None:
                return False
            p, i = p + step[0], i + step[1]
            if i >= len(self.item):
                return True
        return True

    def together(self, p: int, i: int) -> bool:
        """Whether ``TOGETHER`` words or more stand together around item word i at p."""
        n, q, k = 0, p, i
        while n < TOGETHER:
            step = self._at(q, k)
            if step is None:
                break
            q, k, n = q + step[0], k + step[1], n + step[1]
        while n < TOGETHER and p > 0 and i > 0:
            p, i = p - 1, i - 1
            if not same_word(self.item[i], self.words[p]):
                break
            n += 1
        return n >= TOGETHER

    def walk(self, p: int, i: int, far: bool = False) -> int:
        """How many item words from i on stand in the page from p on, in order."""
        words, item, began = self.words, self.item, i
        starts, passed, ended = self.line_start, [], self.far_ended if far else self.ended
        while i < len(item) and p < len(words):
            if (p, i) in ended:
                i = ended[p, i]
                break
            passed.append((p, i))
            step = self._at(p, i)
            if step is not None:
                p, i = p + step[0], i + step[1]
                continue
            moved = None
            near = self.next_line[p] + SKIP_LINES
            if p == 0 or self.ends_line[p - 1]:  # whole lines between two lines of the article
                for k in range(self.next_line[p], len(starts) if far else min(len(starts), near)):
                    if self._sure(starts[k], i, 2 if k < near else 3):
                        moved = starts[k], i
                        break
            if moved is None and self.ends_line[p] and len(words[p]) < len(item[i]):  # a word broken around such lines
                for k in range(self.next_line[p], len(starts) if far else min(len(starts), near)):
                    q = starts[k]
                    if same_word(item[i], words[p] + words[q]) and (i + 1 >= len(item) or self._sure(q + 1, i + 1, 1 if k < near else 2)):
                        moved = q + 1, i + 1
                        break
            if moved is None and self._sure(p + 1, i + 1) and abs(len(words[p]) - len(item[i])) <= 2 and _distance(item[i], words[p], len(item[i]) // 2 + 1) <= len(item[i]) // 2 + 1:
                moved = p + 1, i + 1  # a word misread beyond recognition between two that are right
            if moved is None and len(words[p]) <= 2 and self._sure(p + 1, i):
                moved = p + 1, i  # a stray mark taken for a word
            if moved is None:
                break
            p, i = moved
        for place in passed:
            ended[place] = i
        return i - began


class Page:
    """A page prepared for walks in both directions; items are set one after the other."""

    def __init__(self, words: list[str], lines: list[int]) -> None:
        self.words, self.lines = words, lines
        self.ahead, self.back = Passage(words, lines), None

    @classmethod
    def of(cls, text: str) -> Page:
        """From the words as a shard holds them."""
        rows = [line.split(" ") for line in text.split("\n")] if text else []
        return cls([w for row in rows for w in row], [k for k, row in enumerate(rows) for _ in row])

    def longest_passage(self, item: list[str], hits: list[tuple[int, int]], enough: int) -> int:
        """The most consecutive item words around any of the shared places (pos, at).

        Every place is walked from: a walk that stopped short says nothing of the places
        beyond its stop, though they share its offset.  Where ``LEAD`` words or more stand
        together, the walk is taken again over any number of lines.
        """
        ahead, words = self.ahead, self.words
        ahead.ask(item)
        if self.back is not None:
            self.back.ask([])
        best = 0
        for pos, at in hits:
            if pos >= len(words) or not ahead.together(pos, at):
                continue
            for far in (False, True):
                right = ahead.walk(pos, at, far)
                left = 0
                if at and right < enough:
                    if self.back is None:
                        self.back = Passage([w[::-1] for w in reversed(words)], list(reversed(self.lines)))
                    if not self.back.item:
                        self.back.ask([w[::-1] for w in reversed(item)])
                    left = self.back.walk(len(words) - pos, len(item) - at, far)
                best = max(best, left + right)
                if best >= enough:
                    return best
                if left + right < LEAD:
                    break
        return best


def leaked_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", boxes: str | None = "line_boxes", item_id: str = "item_id", item_text: str = "text",
    least_words: int = 20, per_window: int = 5,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``words`` of each page that holds ``least_words`` consecutive words of an item."""
    spark = docs.sparkSession
    shards = materialise(index_shards(docs, doc_id, doc_text, boxes), row_group=_ROW_GROUP)
    terms = materialise(item_terms(items, item_id, item_text))
    n_pages = shards.agg(F.sum(F.size("docs"))).first()[0] or 0
    n_blocks = max(1, -(-terms.count() // BLOCK))
    texts = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    found = None
    for block in range(n_blocks):
        own = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block
        some = terms.where(own) if n_blocks > 1 else terms
        asked = [r.term for r in some.select("term").distinct().collect()]  # at most about BLOCK terms
        with _one_shard_at_a_time(spark):
            frequency = materialise(document_frequency(shards, asked))
        anchors = [tuple(r) for r in rare_anchors(some, frequency, least_words, per_window, n_pages).select("item_id", "at", "term", "df").collect()]
        whole = [tuple(r) for r in (texts.where(own) if n_blocks > 1 else texts).collect()]  # the texts of those terms
        with _one_shard_at_a_time(spark):
            part = materialise(candidates(shards, anchors, n_pages, dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id], whole, least_words))
        found = found.unionByName(part) if found is not None else part
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
