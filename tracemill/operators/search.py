"""Search: subsequence match, ranked terms, windows of lines, line sequences."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY_SCORE = 2**31 - 1


def subsequence_score(text: Column, needle: str) -> Column:
    """Lower is better: letters between the first and the last matched one, less 100 for a match at the start.

    Null where the needle's letters don't occur in order; letters are taken as early as possible, whatever
    their case.
    """
    if not needle:
        return F.when(text.isNotNull(), F.lit(EMPTY_SCORE))
    low, at, first = F.lower(text), F.lit(0), None
    for ch in needle.lower():
        found = _next(low, ch, at)
        first, at = found if first is None else first, found
    score = at - first + 1 - len(needle) + F.when(first == 1, -100).otherwise(0)
    return F.when(text.rlike(subsequence_pattern(needle)), score)


def _next(low: Column, ch: str, at: Column) -> Column:
    """The place of ch after place `at`, counted from 1."""
    rest = F.substring(low, at + 1, F.length(low))
    return at + F.instr(rest, ch)


def subsequence_pattern(needle: str) -> str:
    return "(?is)" + ".*?".join(map(re.escape, needle))


def fuzzy_top(df: DataFrame, text: str, needle: str, k: int) -> DataFrame:
    """The k best, ties by text. The pattern filters before anything is scored."""
    hits = df.where(F.col(text).rlike(subsequence_pattern(needle))) if needle else df
    return hits.withColumn("score", subsequence_score(F.col(text), needle)).orderBy("score", text).limit(k)


def narrowed(rows: DataFrame, text: str, needle: str, last: str | None, found: DataFrame | None) -> DataFrame:
    """Rows that match; a needle that goes on from the last one is looked for only in what that one found."""
    some = found if found is not None and last is not None and needle.startswith(last) else rows
    return some.where(F.col(text).rlike(subsequence_pattern(needle)))


def bm25(docs: DataFrame, doc_id: str, text: str, terms: Sequence[str], k: int, k1=1.2, b=0.75) -> DataFrame:
    """The k best documents for the terms. Only query terms are exploded; lengths need one more pass."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"))
    d = docs.select(doc_id, words.alias("_w")).select(doc_id, F.size("_w").alias("_len"), F.filter("_w", lambda w: w.isin(list(terms))).alias("_hit"))
    totals = d.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))  # one row
    tf = d.where(F.size("_hit") > 0).select(doc_id, "_len", F.explode("_hit").alias("term")).groupBy(doc_id, "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a query term
    s = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return s.groupBy(doc_id).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def normalized(text: Column, case_sensitive: bool, alnum_only: bool) -> Column:
    out = text if case_sensitive else F.lower(text)
    return F.regexp_replace(out, r"[^\p{L}\p{N}]", "") if alnum_only else out


def matched_lines(docs: DataFrame, path: str, text: str, terms: Sequence[str], mode: str = "any", within: int = 1, case_sensitive=False, alnum_only=False) -> DataFrame:
    """(path, line, last_line, matched): lines with any term, with all of them, or smallest windows of
    at most `within` lines that have all of them. Lines count from 1."""
    lines = docs.select(path, F.posexplode(F.split(text, "\n")).alias("_i", "_line"))
    line = normalized(F.col("_line"), case_sensitive, alnum_only)
    want = [t if case_sensitive else t.lower() for t in terms]
    want = [re.sub(r"[\W_]", "", t) if alnum_only else t for t in want]
    found = F.filter(F.array(*[F.when(line.contains(w), F.lit(t)) for w, t in zip(want, terms, strict=True)]), lambda x: x.isNotNull())
    hits = lines.select(path, (F.col("_i") + 1).alias("line"), found.alias("matched")).where(F.size("matched") > 0)
    if mode == "any":
        return hits.select(path, "line", F.col("line").alias("last_line"), "matched")
    if mode == "all_on_same_line":
        return hits.where(F.size("matched") == len(terms)).select(path, "line", F.col("line").alias("last_line"), "matched")
    # For each hit as first line: the nearest line at which all terms have been seen.
    w = Window.partitionBy(path).orderBy("line")
    ahead = w.rangeBetween(0, within - 1)
    last = F.greatest(*[F.min(F.when(F.array_contains("matched", t), F.col("line"))).over(ahead) for t in terms])
    has = F.lit(True)
    for t in terms:
        has &= F.max(F.array_contains("matched", t)).over(ahead)
    wins = hits.withColumn("last_line", F.when(has, last)).where("last_line IS NOT NULL")
    # A window that holds a later one is not smallest: the next start that still ends at the same line wins.
    wins = wins.withColumn("_next", F.lead("last_line").over(w)).where(F.col("_next").isNull() | (F.col("_next") > F.col("last_line")))
    return wins.select(path, "line", "last_line", F.array(*map(F.lit, terms)).alias("matched"))


def line_of_sequence(lines: Column, pattern: Sequence[str], at_end: bool = False) -> Column:
    """Where pattern occurs in lines, from 0: exactly, else without trailing blanks, else without any around,
    else with typographic signs made plain. The last place first if it is asked for; null if nowhere."""
    n = len(pattern)
    plain = lambda c: F.translate(F.btrim(c), "‐‑‒–—―−‘’‚‛“”„‟   ", "-------''''\"\"\"\"   ")
    tries = []
    for form in (lambda c: c, F.rtrim, F.btrim, plain):
        want = F.array(*[form(F.lit(p)) for p in pattern])
        have = F.transform(lines, form)
        places = F.filter(F.sequence(F.lit(0), F.size(lines) - n), lambda i: F.slice(have, i + 1, F.lit(n)) == want)
        tries.append(F.get(places, F.size(places) - 1 if at_end else F.lit(0)))
    return F.when(F.size(lines) >= n, F.coalesce(*tries))
