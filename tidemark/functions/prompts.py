"""Prompts for a judge, filled column-wise; the wording is this engine's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "salience": ("Rate from 0 to 1 how much this text is worth remembering. Answer with score, reasoning and memory_type as JSON.\n%s", ("content",)),
    "entities": ("List the people, places, organisations and things named here as JSON: name, type, confidence.\n%s", ("content",)),
    "facts": ("List what this text states about the entities %s as JSON: subject, predicate, object, confidence.\n%s", ("entities", "content")),
    "link": ("Do these two belong together? Answer with should_link, link_type, weight and reasoning as JSON.\nA: %s\nB: %s", ("left", "right")),
    "resolution": ("These statements disagree. Answer with strategy, invalidations and confidence_updates as JSON.\n1: %s\n2: %s", ("left", "right")),
    "evolution": ("Does the new text change what is known of the old one? Answer as JSON.\nOld: %s\nNew: %s", ("left", "right")),
    "summary": ("Sum these up in a few sentences. Answer with summary, keywords, tags and salience as JSON.\n%s", ("content",)),
    "pattern": ("What recurs here? Answer with description, pattern_type and confidence as JSON.\n%s", ("content",)),
}
#: Characters of each text that a judge sees.
LIMITS = {"salience": 4000, "link": 500, "resolution": 1000, "evolution": 1000}


def prompt(kind: str, **columns: Column) -> Column:
    """The filled template; a null text is empty, and texts are cut as the judge's window asks."""
    text, names = TEMPLATES[kind]
    missing = set(names) - set(columns)
    if missing:
        raise ValueError(f"{kind} needs {', '.join(sorted(missing))}")
    cut = [F.substring(F.coalesce(columns[n].cast("string"), F.lit("")), 1, LIMITS.get(kind, 1 << 30)) for n in names]
    return F.format_string(text, *cut)
