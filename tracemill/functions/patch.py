"""Patches of context hunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: Typographic signs and the plain ones they stand for.
PLAIN = str.maketrans({**dict.fromkeys("‐‑‒–—―−", "-"), **dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("   　", " ")})


def find(lines: list[str], pattern: list[str], start: int, at_end: bool) -> int | None:
    """First place from start on where pattern stands, in four forms that forgive more and more."""
    if not pattern:
        return start
    last = len(lines) - len(pattern)
    places = [*([last] if at_end and last >= start else []), *range(start, last + 1)]
    for form in (str, str.rstrip, str.strip, lambda x: x.strip().translate(PLAIN)):
        want = list(map(form, pattern))
        for i in places:
            if [form(x) for x in lines[i : i + len(pattern)]] == want:
                return i
    return None


def hunks(patch: str) -> list[tuple[str, list[str], list[str], bool]]:
    """(line to look for first, old lines, new lines, at the end of the file) of each hunk."""
    out: list[tuple[str, list[str], list[str], bool]] = []
    for line in patch.splitlines():
        if line.startswith("@@"):
            out.append((line[2:].strip(), [], [], False))
        elif line == "*** End of File" and out:
            out[-1] = (*out[-1][:3], True)
        elif out and (line == "" or line[0] in " +-"):
            if line[:1] != "+":
                out[-1][1].append(line[1:])
            if line[:1] != "-":
                out[-1][2].append(line[1:])
    return out


def apply(text: str, patch: str) -> str | None:
    """The patched text; null if a hunk's place isn't found."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    edits, at = [], 0
    for context, old, new, at_end in hunks(patch):
        if context:
            found = find(lines, [context], at, False)
            if found is None:
                return None
            at = found + 1
        place = find(lines, old, at if old else len(lines), at_end)
        if place is None:
            return None
        edits.append((place, len(old), new))
        at = place + len(old)
    for place, n, new in sorted(edits, key=lambda e: e[0], reverse=True):
        lines[place : place + n] = new
    return "\n".join(lines) + "\n"


def apply_patch(text: Column, patch: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: pd.Series, patches: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else apply(a, b) for a, b in zip(texts, patches, strict=True)], dtype=object)

    return run(text, patch)
