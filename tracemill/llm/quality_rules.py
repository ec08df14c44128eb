r"""Quality rules: line-first cleaning.

Each line is judged by punctuation, navigation and boilerplate rules, failing lines are removed, and a
document that loses too much of its text with them is rejected. Before that, base limits on the whole
text apply (too few words, or most words inside repeated 3-word windows).

All of it is array expressions on one row at a time: no shuffle, no Python. Words are runs of anything
but ASCII white space; work grows as n log n in a text's words, whatever repeats in it.

Defined results: null text has no words and fails the base limits, as an empty text does; rows that
repeat are judged each; an empty table gives an empty result; extra columns stay as they are in
clean_lines() and are dropped in the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: What menus and breadcrumbs put between their items.
SEPARATORS = "|>»·›•"


@dataclass(frozen=True)
class LineRules:
    """Limits; the shares are of a line's words, or of a document's words for most_lost."""

    min_words: int = 50
    most_repeated_percent: int = 50
    #: A line with more words than this ends with sentence punctuation or is no prose.
    unpunctuated_words: int = 12
    #: Separators a word, as menus and tables have them.
    most_separators: float = 0.2
    most_symbols: float = 0.3
    most_shouts: float = 0.3
    most_lost: float = 0.5
    #: In English, Spanish, French and German.
    boilerplate: tuple[str, ...] = (
        "javascript",
        "lorem ipsum",
        "cookie policy",
        "privacy policy",
        "terms of use",
        "terms of service",
        "all rights reserved",
        "click here",
        "read more",
        "sign in",
        "log in",
        "subscribe to our",
        "licensed under",
        "política de privacidad",
        "política de cookies",
        "todos los derechos reservados",
        "condiciones de uso",
        "haga clic aquí",
        "leer más",
        "iniciar sesión",
        "politique de confidentialité",
        "tous droits réservés",
        "conditions d'utilisation",
        "mentions légales",
        "cliquez ici",
        "lire la suite",
        "se connecter",
        "datenschutzerklärung",
        "alle rechte vorbehalten",
        "nutzungsbedingungen",
        "hier klicken",
        "weiterlesen",
        "jetzt anmelden",
    )
    #: At the end of a line; quotes, brackets and white space may follow.
    sentence: str = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*\z"""


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many of the chars the text has. replace() runs over bytes; translate() looks up every character."""
    out = F.lit(0)
    for size in sorted({len(c.encode()) for c in chars}):
        rest = text
        for c in chars:
            if len(c.encode()) == size:
                rest = F.replace(rest, F.lit(c))
        lost = F.octet_length(text) - F.octet_length(rest)
        out = out + (lost if size == 1 else F.floor(lost / size).cast("int"))
    return out


def word_count(line: Column) -> Column:
    """Of a line that has a word."""
    return F.size(F.split(F.btrim(line, F.lit(" \t\n\x0b\f\r")), SPACE))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the list holds twice or more.

    Windows are sorted by hash beside their place, so equal ones become neighbours.
    """
    n = F.size(words)
    hashes = F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    # The sorted array is used three times: as a lambda's argument it is sorted once.
    again = F.flatten(
        F.transform(
            F.array(F.sort_array(hashes)),
            lambda s: F.transform(F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)), lambda x: x["i"]),
        )
    )
    covered = F.aggregate(
        F.sort_array(again),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + F.least(F.lit(3), i + 3 - a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return covered


def line_fails(line: Column, n: Column, rules: LineRules) -> Column:
    """n: the line's words. Tests stand in the order of their cost."""
    bare = (n > rules.unpunctuated_words) & ~line.rlike(rules.sentence)
    menu = (n >= 3) & (count_of(line, SEPARATORS) >= rules.most_separators * n)
    symbols = count_of(line, SYMBOLS) > rules.most_symbols * n
    shouts = (n >= 3) & (count_of(line, "!?") > F.greatest(F.lit(1.0), rules.most_shouts * n))
    low = F.lower(line)
    known = F.lit(False)
    for phrase in rules.boilerplate:
        known = known | low.contains(phrase)
    return bare | menu | symbols | shouts | ((n <= 30) & known)


def judged(docs: DataFrame, text_col="text", rules: LineRules = LineRules()) -> tuple[DataFrame, dict[str, str]]:
    """docs with the figures, the verdicts and the cleaned text, and what those columns are called."""
    names = dict(zip(keys := ["words", "lines", "word_chars", "n_symbols", "n_dup_lines", "n_words", "n_repeat_words", "bad_lines", "n_lost_words", "base_failed", "kept", "clean_text"], fresh_names(docs, *keys), strict=True))
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumns(
        {
            names["words"]: words_of(text),
            names["lines"]: F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(x.alias("line"), word_count(x).alias("n"))),
        }
    )
    out = out.withColumns(
        {
            names["n_words"]: F.size(c["words"]).cast("long"),
            names["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
            names["n_symbols"]: count_of(text, SYMBOLS).cast("long"),
            names["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(F.transform(c["lines"], lambda x: x["line"])))).cast("long"),
            names["n_repeat_words"]: repeated_words(c["words"]).cast("long"),
            names["bad_lines"]: F.filter(c["lines"], lambda x: line_fails(x["line"], x["n"], rules)),
        }
    )
    out = out.withColumns(
        {
            names["n_lost_words"]: F.aggregate(c["bad_lines"], F.lit(0).cast("long"), lambda a, x: a + x["n"]),
            names["base_failed"]: (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.most_repeated_percent * c["n_words"]),
        }
    )
    out = out.withColumn(names["kept"], ~c["base_failed"] & (c["n_lost_words"] <= rules.most_lost * c["n_words"]))
    return out, names


def clean_lines(docs: DataFrame, text_col="text", rules: LineRules = LineRules()) -> DataFrame:
    """The kept documents, their failing lines removed; columns as in docs."""
    out, names = judged(docs, text_col, rules)
    good = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & line_fails(x, word_count(x), rules)))
    return out.where(F.col(f"`{names['kept']}`")).withColumn(text_col, F.array_join(good, "\n")).select(*[F.col(f"`{x}`") for x in docs.columns])


def op2(spark, sf_dir):
    out, _ = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


_R = LineRules()
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_PHRASES = ", ".join(map(_QUOTED, _R.boilerplate))
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
lf AS (SELECT r, line, len(ws) AS n,
   (len(ws) >= 3 AND length(line) - length(translate(line, '{SEPARATORS}', '')) >= {_R.most_separators} * len(ws))
   OR length(line) - length(translate(line, '{SYMBOLS}', '')) > {_R.most_symbols} * len(ws)
   OR (len(ws) >= 3 AND length(line) - length(translate(line, '!?', '')) > greatest(1.0, {_R.most_shouts} * len(ws)))
   OR (len(ws) > {_R.unpunctuated_words} AND NOT regexp_matches(line, {_QUOTED(_R.sentence)}))
   OR (len(ws) <= 30 AND len(list_filter([{_PHRASES}], lambda x: contains(lower(line), x))) > 0) AS bad
   FROM lw WHERE len(ws) > 0),
ls AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM lf GROUP BY r),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
   CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_lost_words
   FROM w LEFT JOIN rep USING (r) LEFT JOIN ls USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_lost_words <= {_R.most_lost} * n_words AS kept FROM b
"""
