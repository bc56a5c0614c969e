"""Reading order of scanned pages: lines and their boxes to columns read downwards.

A page's lines may stand column by column, line by line across columns, or with
several columns run together on one line (three or more blanks between).  Boxes
give each line's left and right edge and its height on the page.
"""

from __future__ import annotations

import re

_BLANKS = re.compile(r" {3,}")
#: Share of a page's lines that must hold wide blanks before columns are taken to be run together.
RUN_TOGETHER = 0.2
_SLACK = 14


def reading_order(text: str, lefts: list[int], rights: list[int], tops: list[int]) -> list[str]:
    """The lines of a page, each column downwards; lines without a box come last, as they stand."""
    lines = text.split("\n")
    n = min(len(lines), len(lefts))
    if n < 3:
        return [part for line in lines for part in _BLANKS.split(line)]
    wide = sum("   " in line.strip() for line in lines[:n])
    if wide >= RUN_TOGETHER * n:
        order = _run_together(lines[:n], lefts, rights)
    else:
        order = _side_by_side(lines[:n], lefts, rights, tops)
    return order + lines[n:]


def _side_by_side(lines: list[str], lefts: list[int], rights: list[int], tops: list[int]) -> list[str]:
    n = len(lines)
    starts, edge = [], min(lefts[:n])
    while True:
        starts.append(edge)
        own = sorted(rights[i] for i in range(n) if -_SLACK <= lefts[i] - edge <= _SLACK)
        reach = own[min(len(own) - 1, len(own) * 9 // 10)]
        beyond = sorted(x for x in lefts[:n] if x >= reach - _SLACK // 2 and x > edge + 4 * _SLACK)
        # the next column starts where at least two lines do
        edge = next((a for a, b in zip(beyond, beyond[1:], strict=False) if b - a <= _SLACK), None)
        if edge is None:
            break
    if len(starts) == 1:
        return lines
    column = [max(k for k, s in enumerate(starts) if k == 0 or lefts[i] >= s - _SLACK) for i in range(n)]
    return [lines[i] for i in sorted(range(n), key=lambda i: (column[i], tops[i]))]


def _run_together(lines: list[str], lefts: list[int], rights: list[int]) -> list[str]:
    parts = [_BLANKS.split(line.strip()) for line in lines]
    counts = sorted(len(p) for p in parts)
    columns = counts[-1 - len(counts) // 20]
    single = [(rights[i] - lefts[i]) / len(parts[i][0]) for i in range(len(lines)) if len(parts[i]) == 1 and len(parts[i][0]) > 4]
    # a line's blanks are drawn narrower or wider than they are: width per character from lines without them
    width = sorted(single)[len(single) // 2] if single else min((rights[i] - lefts[i]) / max(1, len(lines[i])) for i in range(len(lines)))
    left = min(lefts[: len(lines)])
    full = sorted(rights[i] - width * len(parts[i][-1]) for i in range(len(lines)) if len(parts[i]) == columns)
    last = full[len(full) // 2] if full else max(rights[: len(lines)])
    pitch = (last - left) / max(1, columns - 1)
    out: list[list[str]] = [[] for _ in range(columns)]
    for i, row in enumerate(parts):
        if len(row) >= columns:
            places = [*range(columns - 1), *[columns - 1] * (len(row) - columns + 1)]
        else:
            first = min(columns - len(row), max(0, round((lefts[i] - left) / pitch))) if pitch > 0 else 0
            end = max(first + len(row) - 1, min(columns - 1, round((rights[i] - width * len(row[-1]) - left) / pitch))) if pitch > 0 else 0
            places = [first + k for k in range(len(row))]
            if len(row) > 1:
                places[-1] = end
        for place, part in zip(places, row, strict=True):
            out[place].append(part)
    return [part for col in out for part in col]
