"""Segmentation of a reference section into numbered entries, line by line."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a line may be numbered, by style, in the order in which the styles are tried; the year pattern;
# numbers that are no ordinals (years and what is above 999); where a numbered list has to begin.
LABELS = {
    "numbered-punctuated": re.compile(r"[ \t]*(?:\[(\d{1,4})\]|(\d{1,4})[.)])[ \t]*(?=\S)"),
    "numbered-parenthesized": re.compile(r"[ \t]*\((\d{1,4})\)[ \t]*(?=\S)"),
    "numbered-bare": re.compile(r"[ \t]*(\d{1,4})[ \t]+(?=[A-Z])"),
}
YEARS = re.compile(r"\b(?:19|20)\d{2}\b")
LARGEST, YEAR_NUMBERS = 999, range(1800, 2100)
WIDEST_STEP, FIRST_AT_MOST, FEWEST = 10, 5, 3


class Run(NamedTuple):
    """A rising run of labels, by its last one. Two runs of one length and one last label differ in nothing but their
    first label, and the one that begins higher leaves out fewer numbers."""

    length: int
    first: int
    at: int
    before: Run | None

    def places(self) -> list[int]:
        out, run = [], self
        while run is not None:
            out.append(run.at)
            run = run.before
        return out[::-1]


def ordinal_chain(numbers: list[int]) -> list[int]:
    """Positions of the longest run of labels that rise by 1 to WIDEST_STEP; of runs of one length the one that spans
    fewest numbers, then the one of smaller numbers, then the earlier. Empty unless it has three labels of which seven
    tenths follow on at once.

    One run is kept for each last number, so a label looks at no more than WIDEST_STEP of them.
    """
    by_last: dict[int, Run] = {}
    best: tuple | None = None
    for at, n in enumerate(numbers):
        behind = [by_last[k] for k in range(n - WIDEST_STEP, n) if k in by_last]
        before = max(behind, key=lambda r: (r.length, r.first, -r.at), default=None)
        run = Run(1, n, at, None) if before is None else Run(before.length + 1, before.first, at, before)
        if n not in by_last or (run.length, run.first) > (by_last[n].length, by_last[n].first):
            by_last[n] = run
        rank = (run.length, run.first - n, -n)
        if best is None or rank > best[0]:
            best = (rank, run)
    if best is None or best[1].length < FEWEST:
        return []
    places = best[1].places()
    following = [numbers[b] - numbers[a] == 1 for a, b in zip(places, places[1:])]
    return places if sum(following) >= max(2, len(following) * 7 // 10) else []


def numbered_entries(lines: list[str], label: re.Pattern) -> list[tuple[int, str]]:
    """(ordinal, text) of the entries that labelled lines open; an entry goes on to the next line that opens one."""
    opened = []
    for at, line in enumerate(lines):
        if m := label.match(line):
            n = int(next(filter(None, m.groups())))
            if n <= LARGEST and n not in YEAR_NUMBERS:
                opened.append((n, at, line[m.end() :]))
    chain = [opened[i] for i in ordinal_chain([n for n, _, _ in opened])]
    until = [at for _, at, _ in chain[1:]] + [len(lines)]
    texts = ((n, " ".join(" ".join([rest, *lines[at + 1 : end]]).split())) for (n, at, rest), end in zip(chain, until))
    return [(n, t) for n, t in texts if t]


def segment(text: str | None) -> tuple[list[tuple[int, str]], str, str]:
    """(ordinal, entry) pairs, method and confidence: the first style that gives three entries is the section's, but a
    list that does not begin near its start is not taken apart (numbers in round brackets may begin anywhere)."""
    lines = re.split("\r\n|\r|\n", text or "")
    tried = ((style, numbered_entries(lines, label)) for style, label in LABELS.items())
    style, entries = next(((s, e) for s, e in tried if len(e) >= FEWEST), (None, []))
    if style and (style == "numbered-parenthesized" or entries[0][0] <= FIRST_AT_MOST):
        return entries, style, "HIGH"
    dated = sum(len(YEARS.findall(line)) for line in lines) >= FEWEST
    return ([], "raw-author-year-or-unsegmented", "MEDIUM") if dated else ([], "raw-unsegmented", "LOW")


_ENTRY = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("raw", T.StringType())])


@F.pandas_udf(T.StructType([T.StructField("entries", T.ArrayType(_ENTRY)), T.StructField("method", T.StringType()), T.StructField("confidence", T.StringType())]))
def segment_references(s: pd.Series) -> pd.DataFrame:
    found = [segment(text) for text in s]
    return pd.DataFrame(
        {"entries": [[{"ordinal": n, "raw": t} for n, t in entries] for entries, _, _ in found], "method": [m for _, m, _ in found], "confidence": [c for _, _, c in found]})
