"""Pages of keywords, link lists and product tags, found by the shapes of their lines.

Each line, in reading order, is reduced to a shape: how many words it has, how
many of them are capitalised, numbers, links, hash tags, product codes or function
words, which separators stand between them, and how many are words that the page
repeats.  A line is judged together with its neighbours, as lines cut through phrases,
and lines of one reduced shape are grouped over the page.  A page is flagged when groups of
non-sentence shapes hold more than half of its characters and few of them (``few``)
are enough for that half.

Defined results: null, empty and blank texts are no case.  Whole texts are read,
of any length.  Pages are judged one by one, without a shuffle; repeated rows give
the same answer (``spam_pages`` returns distinct ids).  An empty table gives an
empty result; extra columns are never read.  Missing boxes leave the lines in the
order in which they stand.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.page_layout import reading_order

# Function words of the corpus' four languages (articles, prepositions, auxiliaries, pronouns).
FUNCTION_WORDS = frozenset(
    """
    the of and to in a an that is was were for by on with at from as it be are this which not but or has have had will would his her their its he she they we
    i you all been than into after before during without no more out up who whom whose when where there if one some any so such
    der die das dem den des ein eine einer eines einem einen und oder ist sind war wurde wird werden worden in im von vom zu zum zur mit auf für durch am an
    bei nach hat haben habe man als auch nicht sich aus ohne was wie es er sie trotz
    le la les l de des du d un une et ou est sont a été fut serait sera au aux en par pour sur dans que qui ce cette son sa ses se sans ont avec il elle on
    el los las del al y o es son fue ser sería ha han un una unos unas en por para con que lo su sus se sin de a como entre hacia tras
    """.split()
)

# Top-level domains, general ones in any place, national ones where the host is written in small letters.
_GENERAL = "com|org|net|edu|gov|int|example|invalid|test|info|biz|shop|online|site"
_NATIONAL = "de|at|ch|fr|be|lu|es|pt|it|nl|uk|ie|us|ca|au|nz|mx|ar|cl|co|pe|br|dk|se|no|fi|pl|cz|eu"
_DOMAIN = rf"\b[\w-]+(?:\.[\w-]+)*\.(?:{_GENERAL})\b\S*|(?<![\w.])(?-i:[a-z][a-z0-9-]{{2,}}(?:\.[a-z0-9-]+)*\.(?:{_NATIONAL})(?![\w.-]))"
_LINK = re.compile(rf"(?:https?:/?/?|www\.)\S*|\b[\w-]+(?:\.[\w-]+)+/\S*|{_DOMAIN}", re.I)
_CODE = re.compile(r"\b[A-Z0-9]{2,4}-[\d·•*.|'~^]*\d{2,}[\d·•*.|'~^]*\b")
_TOP_LEVEL = re.compile(rf"\.(?:{_GENERAL}|{_NATIONAL})\b|\w/", re.I)
_DASHED = re.compile(r"-[·•*.|'~^]?\d")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_ITEM = re.compile(r"[,;:/|•·]")
_BROKEN = re.compile(r"\s?[-¬\xad=‐]$")
_LABEL = re.compile(r"^\W*(?:\[[^\]]*\]|\([^)]*\)|[*>•–-]+)?\W*$|^\W*\[[^\]]*\]\W*$")


@dataclass(slots=True)
class Shape:
    """A line reduced to counts; ``chars`` counts every character of the line."""

    chars: int
    words: int
    capitals: int
    function: int
    numbers: int
    links: int
    tags: int
    codes: int
    separators: int
    repeated: int
    alone: bool  # nothing but a bracketed label or a bullet

    def reduced(self) -> tuple[int, ...]:
        """The shape without its sizes: lengths, shares of capitals, separators, links, tags and codes in steps."""
        return (min(self.words.bit_length(), 4), 3 * self.capitals // max(1, self.words), min(self.separators, 2), min(self.links, 2), min(self.tags, 2), min(self.codes, 2))

    def group(self) -> str:
        """The coarse shape, for grouping: what the line is mostly made of."""
        if self.links:
            return "link"
        if self.tags:
            return "tag"
        if self.codes:
            return "code"
        if self.alone:
            return "label"
        if self.numbers > 0.12 * (self.words + self.numbers):
            return "figures"
        if self.function >= 0.2 * self.words:
            return "sentence"
        if self.repeated >= REPEATED * self.words:
            return "list" if self.separators else "run"
        return "other"


#: Least share of words that the page repeats, in a line that is no sentence.
REPEATED = 0.36
_BREAKS = ("-", "¬", "\xad", "=", "‐")


def line_shapes(lines: list[str]) -> list[Shape]:
    """The shape of each non-blank line; broken words are mended so that repetition is seen."""
    rows, carry = [], ""
    kept = [line for line in lines if line.strip()]
    last = len(kept) - 1
    for i, line in enumerate(kept):
        body = carry + line.strip()
        carry = ""
        if i < last and body.endswith(_BREAKS):
            head, _, carry = _BROKEN.sub("", body).rpartition(" ")
            body = head
        rows.append((line, body))
    page = "\n".join(body for _, body in rows)
    linked = "://" in page or "www." in page or _TOP_LEVEL.search(page) is not None
    coded, tagged = _DASHED.search(page) is not None, "#" in page
    parsed = []
    for line, body in rows:
        n_links = n_codes = 0
        rest = body
        if linked:
            rest, n_links = _LINK.subn(" ", rest)
        if coded:
            rest, n_codes = _CODE.subn(" ", rest)
        parsed.append((line, body, rest, n_links, n_codes, _WORD.findall(rest)))
    seen = Counter([w.lower() for row in parsed for w in row[5]])
    often = {w for w, n in seen.items() if n >= 4} - FUNCTION_WORDS
    shapes = []
    for line, body, rest, n_links, n_codes, words in parsed:
        function = repeated = 0
        for w in words:
            low = w.lower()
            if low in FUNCTION_WORDS:
                function += 1
            elif low in often:
                repeated += 1
        n = len(words)
        shapes.append(
            Shape(
                len(line) + 1, n, sum([w[0].isupper() for w in words]), function, len(_NUMBER.findall(rest)), n_links, rest.count("#") if tagged else 0, n_codes,
                len(_ITEM.findall(rest)), repeated, n <= 3 and _LABEL.match(body) is not None,
            )
        )
    return shapes


def _pooled(shapes: list[Shape], i: int) -> str:
    """The group of a line and its two neighbours taken together, links, tags and codes aside."""
    words = function = numbers = separators = repeated = 0
    for s in shapes[max(0, i - 1) : i + 2]:
        words += s.words
        function += s.function
        numbers += s.numbers
        separators += s.separators
        repeated += s.repeated
    return Shape(0, words, 0, function, numbers, 0, 0, 0, separators, repeated, False).group()


NON_SENTENCE = frozenset({"link", "tag", "code", "list", "run", "label"})


def judged_groups(shapes: list[Shape]) -> list[str]:
    """The group of each line, judged with the lines around it."""
    own = [s.group() for s in shapes]
    out = []
    for i, group in enumerate(own):
        if group in ("link", "tag", "code"):
            # a link inside running text is no list of links
            s = shapes[i]
            out.append("sentence" if group == "link" and s.function >= 2 and s.words >= 4 * s.links else group)
            continue
        near = own[max(0, i - 2) : i] + own[i + 1 : i + 3]
        marked = [g for g in near if g in ("link", "tag", "code")]
        plain = shapes[i].function < 0.2 * max(1, shapes[i].words)
        if marked and plain and shapes[i].words <= 6 and (i == 0 or own[i - 1] in NON_SENTENCE or i + 1 == len(own) or own[i + 1] in NON_SENTENCE):
            out.append(marked[0])  # anchor texts, labels and wrapped ends of list entries
            continue
        # a phrase of a list may hold one function word; sentences hold several
        sure = group == "sentence" and (shapes[i].function > 1 or shapes[i].words > 6) and shapes[i].repeated < 0.3 * shapes[i].words
        out.append(group if sure else _pooled(shapes, i))
    return out


def grouped(shapes: list[Shape]) -> dict[tuple, int]:
    """Characters by kind of line and reduced shape."""
    out: dict[tuple, int] = {}
    for shape, kind in zip(shapes, judged_groups(shapes), strict=True):
        key = (kind, *shape.reduced())
        out[key] = out.get(key, 0) + shape.chars
    return out


def spam_share(text: str | None, lefts: list[int], rights: list[int], tops: list[int]) -> tuple[float, str, int]:
    """Share of a page's characters in non-sentence shapes, the commonest kind of these, and how many of them make up half of the page (0: all don't)."""
    if not text or not text.strip():
        return 0.0, "", 0
    groups = grouped(line_shapes(reading_order(text, lefts, rights, tops)))
    whole = sum(groups.values())
    bad = sorted((n for key, n in groups.items() if key[0] in NON_SENTENCE), reverse=True)
    kinds: Counter[str] = Counter()
    for key, n in groups.items():
        if key[0] in NON_SENTENCE:
            kinds[key[0]] += n
    total = needed = 0
    for n in bad:
        total, needed = total + n, needed + 1
        if 2 * total > whole:
            break
    return sum(bad) / max(1, whole), max(kinds, key=lambda g: (kinds[g], g)) if kinds else "", needed if 2 * total > whole else 0


def page_shares(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", boxes_col: str = "line_boxes") -> DataFrame:
    """``id_col``, ``share``, ``kind`` and ``shapes`` (how many non-sentence shapes hold half of the page) of each page with any text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lefts, rights, tops = (batch.column(k).to_pylist() for k in range(1, 5))
            found = [spam_share(t, a or [], b or [], c or []) for t, a, b, c in zip(texts, lefts, rights, tops, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32())], names=[id_col, "share", "kind", "shapes"])

    box = F.col(boxes_col)
    rows = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"), box["x0"].alias("x0"), box["x1"].alias("x1"), box["y0"].alias("y0")).where("text is not null")
    return rows.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, share double, kind string, shapes int")


#: Reduced shapes that may make up half of a page of keywords, links or tags; pages of prose, tables and notices spread over more kinds of lines.
FEW = 12


def spam_pages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", boxes_col: str = "line_boxes", least: float = 0.5, few: int = FEW) -> DataFrame:
    """The distinct ids of pages with more than ``least`` of their characters in non-sentence shapes, ``few`` at most for half of them."""
    shares = page_shares(df, id_col, text_col, boxes_col)
    return shares.where((F.col("share") > least) & F.col("shapes").between(1, few)).select(id_col).distinct()
