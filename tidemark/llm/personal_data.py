"""Personal information in free text: found through disguises, replaced by typed placeholders.

A text passes through transducers that rewrite it and remember, for every
character of the rewritten text, where it came from: look-alike letters and wide
forms become plain ones, spelled-out digits become digits, and ``name (at) host
(dot) org`` becomes an address with @ and dots.  Detectors run on the rewritten
text; their spans are mapped back, so positions and replacements always concern
the text as it was written.  Texts without disguises pass through untouched.
Names are told by given names, titles, initials and, where no list knows them, by two
capitalised words beside words that go with persons.

Defined results: null and empty texts give nothing and are kept as they are.
Texts of any length are read whole.  Positions count characters from 1.  A span
belongs to one kind: an email comes before an identity number, that before a phone,
that before an address, that before a name.  Repeated rows give one row in
``personal_pieces``; ``redacted`` keeps rows as they are.  Rows with a null id keep
their null id.  An empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.given_names import COMMON_WORDS, GIVEN_NAMES
from tidemark.llm.name_forms import ABBREVIATIONS, LEGAL_FORMS

# Letters of other scripts that look like Latin ones, each with its likeness.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏкмтвАЕОРСХІЈЅВКМНТУΑΒΕΖΗΙΚΜΝΟΡΤΥΧοι", "aeopcyxijsdhlkmtbAEOPCXIJSBKMHTYABEZHIKMNOPTYXoi", strict=True))
# Spelled-out digits in English, German, French and Spanish, and words that repeat the next one.
_SPELLED = {
    word: str(digit)
    for digit, words in enumerate(
        (
            "zero oh nought null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf fuenf cinq cinco", "six sechs seis",
            "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve",
        )
    )
    for word in words.split()
}
_REPEATED = {"double": 2, "doppel": 2, "doble": 2, "triple": 3, "treble": 3}
_SPELLED_RUN = re.compile(r"\b(?:(?:(?:%s)\s+)?(?:%s)\b[\s,-]*){5,}" % ("|".join(_REPEATED), "|".join(_SPELLED)), re.I)
_SPELLED_WORD = re.compile(r"(?:(%s)\s+)?(%s)\b" % ("|".join(_REPEATED), "|".join(_SPELLED)), re.I)
_AT_DOT = re.compile(
    r"([\w.+-]+)\s*(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<at>|\bat\b|@)\s*([\w-]+(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<dot>|\bdot\b|\.)\s*[\w-]+)*?\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<dot>|\bdot\b)\s*[\w-]+"
    r"(?:\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\bdot\b)\s*[\w-]+)*)",
    re.I,
)
_DOT = re.compile(r"\s*(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<dot>|\bdot\b)\s*", re.I)
# an at that can't be the preposition lets the dots be plain, or words of the other languages
_ANY_DOT = r"(?:\s*(?:[\[({<]\s*(?:dot|punkt|point|punto)\s*[\])}>]|\b(?:dot|punkt|point|punto)\b)\s*)"
_SURE_AT = re.compile(r"([\w.+-]+)\s*(?:[\[({<]\s*(?:at|ät|arobase|arroba)\s*[\])}>]|\b(?:arobase|arroba|klammeraffe)\b)\s*([\w-]+(?:(?:\.|%s)[\w-]+)+)" % _ANY_DOT, re.I)
_SOME_DOT = re.compile(_ANY_DOT, re.I)
_SURE_AT_HINT = re.compile(r"[\[({<]\s*(?:at|ät|arobase|arroba)\b|\b(?:arobase|arroba|klammeraffe)\b")

EMAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"(?<![\w.@-])(?:\+|\(|(?=\d))[\d][\d ()./-]{5,}\d(?:-?[A-Za-z])?(?![\w@])")
_SHAPES: list[tuple[str, re.Pattern[str]]] = [
    ("id_number", re.compile(r"\d{3}-\d{2}-\d{4}")),
    ("id_number", re.compile(r"\d{2} \d{3} \d{3} \d{3}|\d{11}")),
    ("id_number", re.compile(r"\d{8}-?[A-Z]")),
    ("phone", re.compile(r"\+\d{1,3}(?:[ ./-]?\(?\d+\)?){2,7}")),
    ("phone", re.compile(r"00[1-9]\d{8,13}|00[1-9]\d{0,2}(?:[ ./-]\d{2,}){2,6}")),
    ("phone", re.compile(r"\(\d{2,5}\) ?\d{3,4}[ ./-]?\d{3,5}")),
    ("phone", re.compile(r"\d{3}([ .-])\d{3}\1\d{4}")),
    ("phone", re.compile(r"0\d{2,5}[ /-]\d{3,8}(?:[ -]\d{1,6})?|0\d(?:[ .]\d{2}){4}|0[1-9]\d{8,9}")),
]
_LETTERED = re.compile(r"\b(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z]\d{7,8}|[A-Z]{2}\d{6,7}|[XYZ]-?\d{7}-?[A-Z])\b")
_LABEL = re.compile(
    r"(?:passport|social security|ssn|national insurance|\bni\b|\bnino\b|tax|id card|identity|\bid\b|\bdni\b|\bnif\b|\bnie\b|ausweis|steuer)[\w .]{0,24}?(?:no\.?|number|id|card|nr\.?)?\s*[:#]?\s*$", re.I
)
_NO_ID = re.compile(
    r"\b(?:part|order|ticket|item|invoice|article|model|serial|version|lot|batch|sku|ref|case|job)s?\b(?:\W*|(?:\W+\w+)?\W+(?:no|number|nr|num|code)\W*)$", re.I
)
_SOME_NUMBER = re.compile(r"\bnum\w{0,4}\W+$|\bno\.?\W+(?:\w+\W+)?$", re.I)
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Close|Hill|Terrace|Drive|Square|Place|Crescent|Gardens|Boulevard|Blvd|Grove|Mews)"
_ADDRESSES = [
    re.compile(r"(?<![\w.,-])\d{1,4}[a-z]?,? (?!(?:of|and|for|the|on|at|in|to|with)\b)[^\W\d_]{4,}(?: [^\W\d_]{4,})? %s\b\.?(?:, [A-Z][^\W\d_]{3,})?" % _STREET, re.I),
    re.compile(r"(?<![\w.,-])\d{1,4}(?: ?(?:bis|ter)|[a-z])?,? (?:rue|avenue|boulevard|place|chemin|quai) (?:de la |du |des |de |d')?[^\W\d_]{3,}", re.I),
    re.compile(r"\b(?:Calle|Avenida|Plaza|Paseo)(?: (?:de la|del|de))? [^\W\d_]{3,},? \d{1,4}[a-z]?\b", re.I),
    re.compile(r"\b[^\W\d_]{3,}(?:straße|strasse|str\.|gasse|weg|allee|platz) \d{1,4}[a-z]?\b", re.I),
]
_ADDRESS_HINTS = (None, ("rue ", "avenue ", "boulevard ", "place ", "chemin ", "quai "), ("calle", "avenida", "plaza", "paseo"), ("straße", "strasse", "str. ", "gasse ", "weg ", "allee ", "platz "))
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_INITIAL = re.compile(r"(?<![\w.])[A-Z]\. ?(?=[A-Z][^\W\d_]{2,})")
_TITLE = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|Don|Doña|Señora?)\b\.? +(?=[A-Z])")
_TITLE_WORDS = frozenset("mr mrs ms miss mx dr prof sir herr frau mme mlle don doña señor señora".split())
_NOT_NAMES = frozenset(
    "the a an it its my our your his her their this that these those i we you he she they there here in on at of for from to and or but if as by with is was are were be not no so do did near some every each user assistant".split()
)
_NAME_WORDS = GIVEN_NAMES | _TITLE_WORDS
# Words that stand before or after a person's name, in the four languages.
_BEFORE_NAME = frozenset(
    "named met dear hello hi colleague friend neighbour neighbor sister brother wife husband son daughter mother father aunt uncle cousin boss niece nephew heißt heisst heiße heisse appelle llamo llama".split()
)
_AFTER_NAME = frozenset("said says asked asks wrote writes told tells met phoned replied replies answered lives works smiled laughed nodded sagte fragte schrieb wohnt arbeitet dit habite travaille dijo vive trabaja escribió".split())
# Capitalised words that make two capitalised words no person.
_NO_PERSON = frozenset(
    """
    monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december montag dienstag mittwoch donnerstag freitag
    samstag sonntag street road avenue lane close hill terrace drive square place gardens north south east west new old great saint san santa el la los las le les der die das company university
    institute association society church school college hospital station bridge park river lake city county bank club union party museum library theatre hotel king queen order part ticket version
    """.split()
) | frozenset(LEGAL_FORMS) | frozenset(ABBREVIATIONS) | frozenset(ABBREVIATIONS.values())
_NAME_CUES = _BEFORE_NAME | _AFTER_NAME | {"name"}
_JOINING = frozenset("and und et y".split())
_JOINED = re.compile(r",? (?:and|und|et|y|&) ")
_CAPITAL = r"[A-ZÀ-ÖØ-Þ](?:['’][A-ZÀ-ÖØ-Þ])?[^\W\d_]+(?:['’-][^\W\d_]+)*"
_CAPITALS = re.compile(rf"(?<![^\W_])(?<![.'’-])(?=({_CAPITAL} (?:[A-ZÀ-ÖØ-Þ]\. ?)?{_CAPITAL}))[A-ZÀ-ÖØ-Þ]")
_CAPITAL_AHEAD = re.compile(r"(^|[.!?:]\s+|\n)?\b([A-ZÀ-ÖØ-Þ][^\W\d_]+) $")
_LETTERS = re.compile(r"[^\W\d_]+")
_AFTER_SURNAME = re.compile(r", [A-Z]\.")
#: The kinds in order of precedence.
KINDS = ("email", "id_number", "phone", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


class Tracked:
    """A rewritten text; ``start``/``stop`` give where each character came from (None: unchanged so far)."""

    __slots__ = ("text", "start", "stop")

    def __init__(self, text: str) -> None:
        self.text, self.start, self.stop = text, None, None

    def rewrite(self, spans: list[tuple[int, int, str]]) -> None:
        """Replaces disjoint spans, in order; each new character stands for the whole span."""
        if not spans:
            return
        if self.start is None:
            self.start, self.stop = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, start, stop, at = [], [], [], 0
        for a, b, new in spans:
            text.append(self.text[at:a] + new)
            start += self.start[at:a] + [self.start[a]] * len(new)
            stop += self.stop[at:a] + [self.stop[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.start, self.stop = "".join(text), start + self.start[at:], stop + self.stop[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.stop[b - 1])


def plain_letters(t: Tracked) -> None:
    """Look-alikes and wide or styled forms to plain letters; accented letters stay."""
    if t.text.isascii():
        return
    spans = []
    for i, ch in enumerate(t.text):
        if ch > "ʯ":
            plain = _LOOKALIKES.get(ch) or unicodedata.normalize("NFKC", ch)
            if plain != ch and len(plain) == 1:
                spans.append((i, i + 1, plain))
    t.rewrite(spans)


def plain_digits(t: Tracked) -> None:
    """Five or more spelled-out digits in a row to digits."""
    spans = []
    for run in _SPELLED_RUN.finditer(t.text):
        words = list(_SPELLED_WORD.finditer(t.text, run.start(), run.end()))
        digits = "".join(_SPELLED[w.group(2).lower()] * _REPEATED.get((w.group(1) or "").lower(), 1) for w in words)
        spans.append((run.start(), words[-1].end(), digits))
    t.rewrite(spans)


def plain_addresses(t: Tracked) -> None:
    """at/dot disguises to @ and dots."""
    spans = []
    for m in _AT_DOT.finditer(t.text):
        spans.append((m.end(1), m.start(2), "@"))
        spans += [(d.start(), d.end(), ".") for d in _DOT.finditer(t.text, m.start(2), m.end(2))]
    t.rewrite(spans)
    spans = []
    for m in _SURE_AT.finditer(t.text):
        spans.append((m.end(1), m.start(2), "@"))
        spans += [(d.start(), d.end(), ".") for d in _SOME_DOT.finditer(t.text, m.start(2), m.end(2))]
    t.rewrite(spans)


def _names(text: str, low: str) -> list[tuple[int, int]]:
    """Spans of names: given name, surname or both, without title."""
    if _NAME_WORDS.isdisjoint(_LETTERS.findall(low)) and _INITIAL.search(text) is None and _AFTER_SURNAME.search(text) is None:
        return []
    words = list(_WORD.finditer(text))
    lows = [low[w.start() : w.end()] for w in words]
    initials = {m.start() for m in _INITIAL.finditer(text)} if ". " in text or "." in text else set()
    titled = {m.end() for m in _TITLE.finditer(text)} if not _TITLE_WORDS.isdisjoint(lows) else set()
    base = []
    for word in lows:
        for tail in ("'s", "’s"):
            word = word.removesuffix(tail)
        base.append(word)
    spans: list[tuple[int, int]] = []
    n, k = len(words), 0

    def surname(j: int, given: str) -> bool:
        """Whether word j can be the surname after a given name written like ``given``."""
        if j >= n or base[j] in _NOT_NAMES or len(base[j]) < 4:
            return False
        w = words[j].group()
        return w[0].isupper() if given[0].isupper() else w.islower() and base[j] not in GIVEN_NAMES

    def glued(i: int, j: int, between: str) -> bool:
        return text[words[i].end() : words[j].start()] == between

    while k < n:
        w, word = words[k], base[k]
        begin, end, last = w.start(), None, k
        if word in GIVEN_NAMES and (w.group()[0].isupper() or word not in COMMON_WORDS):
            raw = w.group()
            if raw[0].isupper() and k and glued(k - 1, k, ", ") and words[k - 1].group()[0].isupper() and base[k - 1] not in _NOT_NAMES | GIVEN_NAMES and len(base[k - 1]) >= 4 and not (k > 1 and lows[k - 2] in ("near", "in", "at", "from") and glued(k - 2, k - 1, " ")):
                begin = words[k - 1].start()
            end = w.start() + len(word)
            if begin == w.start():
                if k + 2 < n and len(lows[k + 1]) == 1 and text[words[k + 1].end() : words[k + 2].start()].strip() == "." and surname(k + 2, raw) and glued(k, k + 1, " "):
                    last = k + 2
                elif k + 1 < n and glued(k, k + 1, " ") and surname(k + 1, raw):
                    last = k + 1
                end = words[last].start() + len(base[last])
            if word == "will" and last == k and begin == w.start():
                end = None
        elif w.start() in initials and k + 1 < n and base[k + 1] not in _NOT_NAMES:
            last, end = k + 1, words[k + 1].start() + len(base[k + 1])
        elif w.start() in titled and word not in _NOT_NAMES and len(word) > 1:
            end = w.start() + len(word)
            if k + 1 < n and glued(k, k + 1, ", ") and base[k + 1] in GIVEN_NAMES and words[k + 1].group()[0].isupper():
                last, end = k + 1, words[k + 1].start() + len(base[k + 1])
        elif w.group()[0].isupper() and len(word) >= 4 and word not in _NOT_NAMES and k + 1 < n and len(lows[k + 1]) == 1 and words[k + 1].group().isupper() and text[w.end() : words[k + 1].start()] == ", " and text[words[k + 1].end() : words[k + 1].end() + 1] == ".":
            last, end = k + 1, words[k + 1].end() + 1
        if end is not None:
            spans.append((begin, end))
        k = last + 1
    return spans


def _names_by_context(text: str, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Two capitalised words that no list knows, beside words that go with persons or joined to another name by ``and``."""
    pairs = [m.span(1) for m in _CAPITALS.finditer(text)]
    pairs = [(a, b) for a, b in pairs if not any(a < y and x < b for x, y in known)]
    pairs = [(a, b) for a, b in pairs if not any(w.lower() in _NO_PERSON or w.lower() in _NOT_NAMES or w.isupper() for w in _WORD.findall(text[a:b]))]
    if not pairs:
        return []
    found: set[tuple[int, int]] = set()
    for a, b in pairs:
        # a longer run of capitalised words is a firm's or a place's name
        ahead = _CAPITAL_AHEAD.search(text[max(0, a - 40) : a])
        if re.match(r" [A-ZÀ-ÖØ-Þ][^\W\d_]", text[b : b + 3]) or ahead and ahead.group(1) is None and ahead.group(2).lower() not in _BEFORE_NAME:
            continue
        before, after = _LETTERS.findall(text[max(0, a - 24) : a].lower()), _LETTERS.findall(text[b : b + 24].lower())
        glued_before, glued_after = text[max(0, a - 2) : a].endswith((" ", ": ", ", ")), text[b : b + 1] == " "
        called = len(before) > 1 and before[-1] == "is" and before[-2] == "name"
        if glued_before and before and (before[-1] in _BEFORE_NAME or called) or glued_after and after and after[0] in _AFTER_NAME:
            found.add((a, b))
    held = known + sorted(found)
    grows = bool(found) or bool(known)
    while grows:  # along "and", "und", "et", "y"
        grows = False
        for a, b in pairs:
            if (a, b) not in found and any(_JOINED.fullmatch(text, y, a) or _JOINED.fullmatch(text, b, x) for x, y in held):
                found.add((a, b))
                held.append((a, b))
                grows = True
    return sorted(found)


def detect(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each piece of personal data in the text as written, in order."""
    if not text:
        return []
    t = Tracked(text)
    plain_letters(t)
    low = t.text.lower()
    words = _LETTERS.findall(low)
    if sum([w in _SPELLED for w in words]) >= 5:
        plain_digits(t)
        low = t.text.lower()
    if "dot" in low and ("at" in low or "@" in low) or _SURE_AT_HINT.search(low) is not None:
        plain_addresses(t)
        low = t.text.lower()
    plain = t.text
    if len(low) != len(plain):  # a few capitals grow when lowered
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    found: list[tuple[int, int, str]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in found)

    if "@" in plain:
        found += [(*m.span(), "email") for m in EMAIL.finditer(plain)]
    phones = []
    for m in _NUMBER.finditer(plain):
        a, b = m.span()
        piece = m.group()
        if sum(c.isdigit() for c in piece) < 7:
            continue
        for kind, shape in _SHAPES:
            hit = shape.match(piece)
            if hit and (hit.end() == len(piece) or piece[hit.end()] in " (" and not piece[hit.end() :].strip(" ()").isalpha()) and free(a, a + hit.end()):
                ahead = plain[max(0, a - 40) : a]
                if piece[0].isdigit() and _NO_ID.search(ahead):
                    break
                if kind == "id_number" and _SOME_NUMBER.search(ahead) and not _LABEL.search(ahead):
                    break
                if kind == "id_number" and re.fullmatch(r"\d{11}", hit.group()) and not _LABEL.search(ahead):
                    continue
                (found if kind == "id_number" else phones).append((a, a + hit.end(), kind))
                break
    for m in _LETTERED.finditer(plain):
        if free(*m.span()) and (re.match(r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]", m.group()) or _LABEL.search(plain[max(0, m.start() - 40) : m.start()])):
            found.append((*m.span(), "id_number"))
    found += [p for p in phones if free(*p[:2])]
    for shape, hints in zip(_ADDRESSES, _ADDRESS_HINTS, strict=True):
        if hints is None or any(h in low for h in hints):
            found += [(*m.span(), "address") for m in shape.finditer(plain) if free(*m.span())]
    named = _names(plain, low)
    found += [(a, b, "name") for a, b in named if free(a, b)]
    if not _NAME_CUES.isdisjoint(words) or named and not _JOINING.isdisjoint(words):
        found += [(a, b, "name") for a, b in _names_by_context(plain, named) if free(a, b)]
    return sorted((*t.source(a, b), kind) for a, b, kind in found)


def redact(text: str | None) -> str | None:
    """The text with typed placeholders; everything else stays as it is."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in detect(text):
        if a >= at:
            out += [text[at:a], PLACEHOLDERS[kind]]
            at = b
    return "".join([*out, text[at:]])


def _mapped(df: DataFrame, id_col: str, text_cols: tuple[str, ...], schema: str, each: Callable[[list, list[list]], pa.RecordBatch]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield each(batch.column(0).to_pylist(), [batch.column(1 + k).to_pylist() for k in range(len(text_cols))])

    return df.select(F.col(id_col).cast("string").alias("id"), *(F.col(c).cast("string") for c in text_cols)).mapInArrow(run, schema)


def personal_pieces(df: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("content", "summary")) -> DataFrame:
    """``id``, ``field``, ``kind``, ``start_at`` of each piece, distinct."""

    def each(ids: list, texts: list[list]) -> pa.RecordBatch:
        rows = [(own, field, kind, a + 1) for field, column in zip(text_cols, texts, strict=True) for own, text in zip(ids, column, strict=True) for a, _, kind in detect(text)]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        types = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "field", "kind", "start_at"])

    return _mapped(df, id_col, text_cols, "id string, field string, kind string, start_at long", each).distinct()


def redacted(df: DataFrame, id_col: str = "id", text_cols: tuple[str, ...] = ("content", "summary")) -> DataFrame:
    """``id`` and the texts with placeholders, row by row; no shuffle."""

    def each(ids: list, texts: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *(pa.array([redact(t) for t in column], pa.string()) for column in texts)], names=["id", *text_cols])

    return _mapped(df, id_col, text_cols, ", ".join(["id string", *(f"`{c}` string" for c in text_cols)]), each)
