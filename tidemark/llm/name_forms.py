"""Names as people type them to comparable forms: order, titles, legal forms, abbreviations, short forms."""

from __future__ import annotations

import re
import unicodedata

from tidemark.llm.given_names import GIVEN_NAMES, long_forms

# Words before or after a person's name that are no part of it.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame rev herr frau mme mlle don dona senor senora".split())
SUFFIXES = frozenset("jun junior jr sen senior sr ii iii iv phd md esq".split())
# Legal forms and fillers in firms' names.
LEGAL_FORMS = frozenset("ltd limited gmbh sa plc llc inc incorporated corp corporation ag kg bv nv sarl srl spa oy ab as".split())
FILLERS = frozenset("the and".split())
# Abbreviations of words in firms' names.
ABBREVIATIONS = {
    "assoc": "association", "assn": "association", "brew": "brewing", "bros": "brothers", "chem": "chemical", "co": "company", "dept": "department", "dy": "dairy", "elec": "electric", "engrg": "engineering",
    "eng": "engineering", "fdn": "foundation", "fy": "ferry", "gdn": "garden", "hrtg": "heritage", "ins": "insurance", "inst": "institute", "intl": "international", "labs": "laboratories", "med": "medical",
    "mtn": "mountain", "ptg": "printing", "res": "research", "rly": "railway", "shpg": "shipping", "soc": "society", "svcs": "services", "sw": "software", "tbr": "timber", "text": "textile",
    "univ": "university", "wks": "works",
}

_ACRONYM = re.compile(r"\([^)]*\)")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")
_LONG = long_forms()


def plain(text: str) -> str:
    """Lower case without accents; letters that have no plain form stay."""
    text = unicodedata.normalize("NFKC", text).lower().replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def entity_kind(entity_type: str | None) -> str | None:
    """``person`` or ``organization``, whatever the spelling; None for any other type."""
    kind = re.sub(r"[^a-z]", "", (entity_type or "").lower())
    if kind in ("person", "persons", "people", "human", "individual"):
        return "person"
    if kind in ("org", "orgs", "organization", "organisation", "organizations", "organisations", "company", "firm", "corporation", "business"):
        return "organization"
    return None


def person_forms(name: str) -> list[tuple[str, str, str]]:
    """(space, main part, second part) of a person's name; the second is a given name, or an initial in space ``initial``.

    A short form stands for each of its long forms, so it may give several.  A full
    name also has its initial, in space ``expanded``, to meet names with an initial only.
    """
    text = plain(name)
    before, comma, after = text.partition(",")
    if comma and after.strip(" .") and after.strip(" .") not in SUFFIXES:
        text = f"{after} {before}"
    words = [w for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?", text)]
    tokens = [re.sub(r"['’-]", "", w.rstrip(".")) for w in words]
    tokens = [w for k, w in enumerate(tokens) if w not in SUFFIXES and not (w in TITLES and k == 0 and len(tokens) > 1)]
    full = [w for w in tokens if len(w) > 1]
    if not full:
        return []
    if len(full) == 1:
        initial = next((w for w in tokens if len(w) == 1), "")
        return [("initial", full[0], initial)] if initial else [("alone", full[0], "")]
    given, surname = full[0], full[-1]
    if given not in GIVEN_NAMES and surname in GIVEN_NAMES:
        given, surname = surname, given
    long = sorted(_LONG.get(given, (given,)))
    return [("person", surname, g) for g in long] + [("expanded", surname, i) for i in sorted({g[0] for g in long} | {given[0]})]


def organization_forms(name: str) -> list[tuple[str, str, str]]:
    """(space, distinctive word, other words) of a firm's name."""
    text = plain(_ACRONYM.sub(" ", name))
    text = _DOTTED.sub(lambda m: m.group().replace(".", "") + " ", text)
    tokens = [w.rstrip(".") for w in _TOKEN.findall(text)]
    while len(tokens) > 1 and tokens[-1] in LEGAL_FORMS:
        tokens.pop()
    tokens = [ABBREVIATIONS.get(w, w) for w in tokens if w not in FILLERS]
    if "of" in tokens[1:-1]:
        k = tokens.index("of", 1)
        tokens = tokens[k + 1 :] + tokens[:k]
    return [("organization", tokens[0], " ".join(tokens[1:]))] if tokens else []


def name_forms(kind: str, name: str) -> list[tuple[str, str, str]]:
    return person_forms(name) if kind == "person" else organization_forms(name)
