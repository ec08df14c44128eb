"""The training-data operators: odd rows, brute force, round trips, held-out accuracy."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.parity import connect, same
from tracemill.llm import bpe, chat, common, components, decontaminate, fm_index, jaccard_join, quality_model, quality_rules, queries, sharding, suffix_dedup, toxicity, url_filter

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls, empty and blank texts, repeated rows, equal ids, a very long text, and columns that clash with ours.
ROWS = [
    (1, "one two three four five six seven. " * 12, "a", 1),
    (1, "one two three four five six seven. " * 12, "a", 1),
    (2, None, None, None),
    (None, "one two three four five six seven. " * 12, "b", 2),
    (3, "", "c", 3),
    (4, " \n\t ", "d", 4),
    (5, LONG, "e", 5),
    (6, "tiny", "f", 6),
    (7, "Ünï çödé 日本語 </s> <|im_end|> \\ " * 5, "g", 7),
]
CLASH = ["kept", "score", "n_words", "spans", "items", "n_bytes", "token_ids", "id", "mark", "data", "row", "shard"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" if i == 0 else f"{c} int" for i, c in enumerate(CLASH[:2]))


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH[2:]:
        d = d.withColumn(c, F.lit(0))
    return d


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 5, 6, 7, 7)] + [(None, 1, 1), (2, None, None)], "id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), connect(sf), queries.oracle_sql()[name])


# --- decontamination


def test_leaks_of_odd_rows(spark, docs, none):
    bench = spark.createDataFrame([(10, "w1 w2 w3"), (None, "five SIX seven"), (12, None), (13, ""), (14, "nowhere"), (14, "nowhere")], "item_id long, text string")
    got = decontaminate.find_leaks(docs, bench)
    assert got.count() == len(ROWS) and got.columns[-3:] == ["_n_words", "_spans", "_items"]
    by = {r.doc_id: r for r in got.collect()}
    assert by[2]["_n_words"] == 0 and by[2]["_items"] == [] and by[1]["_items"] == ["null"] and by[5]["_items"] == ["10"]
    assert decontaminate.find_leaks(none, bench).count() == 0
    assert all(r["_items"] == [] for r in decontaminate.find_leaks(docs, bench.where("false")).collect())
    clean = {r.doc_id: r.text for r in decontaminate.remove_leaks(docs, bench).collect()}
    assert clean[2] is None and "five six seven" not in clean[1] and clean[1].startswith("one two three four .")


def brute_leaks(text, items, width):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - width + 1) if b else 0):
            p = b[i : i + width]
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard", [5, 1000])
def test_leaks_against_brute_force(shard):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abcx") for _ in range(n))
    items = [(str(i), text(rng.randrange(0, 7))) for i in range(12)]
    texts = [text(rng.randrange(0, 60)) for _ in range(60)]
    p = decontaminate.Phrases(items, 4)
    for t, (n, spans, got) in zip(texts, decontaminate.scan(texts, p, shard), strict=True):
        assert (n, sum(b - a for a, b in spans), got) == brute_leaks(t, items, 4)


def test_leaks_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(0, 40, 3)], "item_id long, text string")
    one = decontaminate.find_leaks(docs, bench).select("doc_id", "_spans", "_items").collect()
    monkeypatch.setattr(decontaminate, "BLOCK", 30)
    assert sorted(decontaminate.find_leaks(docs, bench).select("doc_id", "_spans", "_items").collect(), key=str) == sorted(one, key=str)


@given(st.lists(st.integers(1, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_fm_index(seq, pattern):
    f = fm_index.FMIndex(np.array(seq, np.int64), 3, 4)
    lo, hi = f.search(np.array([pattern], np.int64))
    at = sorted(f.locate(np.arange(lo[0], hi[0])).tolist())
    assert at == [i for i in range(len(seq) - len(pattern) + 1) if seq[i : i + len(pattern)] == pattern]


# --- quality rules


def test_rules_of_odd_rows(docs, none):
    got, names = quality_rules.judged(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[2][names["n_words"]] == 0 and rows[2][names["base_failed"]] and not rows[3][names["kept"]] and rows[5][names["n_words"]] == 30_000
    assert quality_rules.judged(none)[0].count() == 0
    assert quality_rules.clean_lines(docs).columns == docs.columns


@pytest.mark.parametrize(
    "line, stays",
    [
        ("Home | News | Sport | Contact | Imprint", False),
        ("Start › Shop › Shoes › Red", False),
        ("Accueil » Jeux · Sport • Contact", False),
        ("Read more", False),
        ("Todos los derechos reservados", False),
        ("Conditions d'utilisation", False),
        ("Datenschutzerklärung", False),
        ("this is 3.5 times a.com as many words as one would put in a line of prose", False),
        ("he said that this is as many words as one would put in a line of \u201cprose.\u201d) ", True),
        ("A short heading", True),
        ("# $ % & * | < >", False),
        ("Buy now!!! Really??? Yes!!!", False),
    ],
)
def test_lines_that_fail_are_removed(spark, line, stays):
    good = " ".join(f"Word{i} and w{i * 7} go on." for i in range(40))
    d = spark.createDataFrame([(1, good + "\n" + line)], "doc_id long, text string")
    assert quality_rules.clean_lines(d).first().text == (good + "\n" + line if stays else good)
    assert quality_rules.judged(d)[0].first().n_lost_words == (0 if stays else len(line.split()))


# --- byte pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    import tiktoken

    path, pattern = bpe.multilingual()
    c = bpe.codec(path, pattern)
    return c, tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})


@given(st.one_of(st.text(max_size=80), st.text("aeinst ", max_size=300), st.text("ab", max_size=300), st.text("éñ日 .!", max_size=120)))
@settings(max_examples=300, deadline=None)
def test_encoding(tokenizer, s):
    c, reference = tokenizer
    ids = c.encode(s)
    assert list(ids) == reference.encode_ordinary(s)
    assert c.decode(ids) == s.encode()


def test_join_is_the_encoding_of_both(tokenizer):
    c, _ = tokenizer
    rng = random.Random(5)
    for _ in range(400):
        s = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 40))).encode()
        k = rng.randrange(len(s) + 1)
        assert c.join(c.merge(s[:k]) if k else [], c.merge(s[k:]) if k < len(s) else []) == c.merge(s)


def test_encoding_of_odd_rows(docs, none):
    path, pattern = bpe.multilingual()
    e = bpe.encode(docs, path, pattern)
    assert e.columns[-1] == "_token_ids" and bpe.encode(none, path, pattern).count() == 0
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(e, path, pattern, "_token_ids").collect()}
    assert back[2] == "" and back[5] == LONG and back[7] == ROWS[-1][1]


# --- suffix-array dedup


def brute_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, bytes(b for b, g in zip(d, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("alphabet, seed", [("ab", 1), ("abcdefgh", 2), ("é日a", 3), ("a", 4)])
def test_repeats_against_brute_force(spark, alphabet, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    parts = [text(70) for _ in range(6)]
    texts = [text(rng.randrange(0, 60)) + rng.choice(parts)[rng.randrange(40) :] + text(rng.randrange(0, 60)) for _ in range(60)] + [None, "", parts[0], parts[0]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(d, unit=suffix_dedup.Unit("bytes", 24, 8, 1)).collect()))
    assert [(a, b, c, bytes(k)) for _, a, b, c, k in got] == brute_repeats(texts, 24)


def test_large_hash_groups_meet_level_by_level(spark, monkeypatch):
    rng = random.Random(9)
    core = "the same thirty bytes in them all"
    texts = ["".join(rng.choice("xyz") for _ in range(30)) + core + "".join(rng.choice("uvw") for _ in range(30)) for _ in range(300)]
    texts += texts[:7] + [t[:70] + "q" for t in texts[7:40]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = sorted(map(tuple, suffix_dedup.remove_repeats(d, unit=suffix_dedup.Unit("bytes", 50, 16, 1)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert [(a, b, c, bytes(k)) for _, a, b, c, k in got] == brute_repeats(texts, 50)


def test_repeats_of_odd_rows(docs, none):
    got = suffix_dedup.remove_repeats(docs)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ROWS) and rows[2]["_n_bytes"] == 0 and rows[1]["n_removed"] == rows[1]["_n_bytes"] and rows[6]["n_removed"] == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert suffix_dedup.drop_repeats(docs).columns == docs.columns


def test_long_texts_in_parts(spark, monkeypatch):
    """Windows that start in one part and end in the next are found; PART is sent along as the workers' own value."""
    rng = random.Random(2)
    old, texts = suffix_dedup.PART, ["".join(rng.choice("abcd") for _ in range(suffix_dedup.PART + 900)) for _ in range(2)]
    texts.append(texts[0][old - 260 : old + 240] + texts[1][old - 20 : old + 300] + "tail")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(d, unit=suffix_dedup.Unit("bytes", 100, 16, 1)).collect()))
    want = brute_repeats(texts, 100)
    assert [(a, b, c, bytes(k)) for _, a, b, c, k in got] == want and all(w[1] for w in want)


@pytest.mark.parametrize("width, step", [(24, 1), (13, 1), (24, 8)])
def test_family_of_suffix_arrays(width, step):
    """Many batches, bytes of all values: what is found again is what a set of windows says."""
    rng = random.Random(width + step)
    symbol = lambda: bytes([0, 255, rng.randrange(2)][rng.randrange(3)] for _ in range(1)) if step == 1 else rng.choice([b"\0" * 8, b"\xff" * 8, b"abcdefgh"])
    strings = [b"".join(symbol() for _ in range(rng.randrange(0, 40))) for _ in range(160)]
    seen = Counter(s[i : i + width] for s in strings for i in range(0, len(s) - width + 1, step))
    family, k = suffix_dedup.Family(width, step), 0
    while k < len(strings):
        n = rng.randrange(1, 12)
        family.add(np.arange(k, min(k + n, len(strings))), strings[k : k + n])
        k += n
    got = {(s, i) for s, a, b in family.found() for i in range(a, b - width + 1, step)}
    assert got == {(s, i) for s, x in enumerate(strings) for i in range(0, len(x) - width + 1, step) if seen[x[i : i + width]] > 1}
    sizes = [len(x.data) for x in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) < 9


def test_time_of_the_family_is_near_linear():
    rng = np.random.default_rng(3)
    took = []
    for batches in (4, 16):
        family = suffix_dedup.Family(400)
        data = [[rng.integers(97, 101, 550, dtype=np.uint8).tobytes() for _ in range(60)] for _ in range(batches)]
        began = time.process_time()
        for b, strings in enumerate(data):
            family.add(np.arange(60) + 60 * b, strings)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5  # quadratic time would be 16 times


def brute_words(texts, width):
    """What is left of each text's words when those under windows that start elsewhere too are gone."""
    ws = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


@pytest.mark.parametrize("most", [800, 3])
def test_repeated_words_against_brute_force(spark, monkeypatch, most):
    """With groups of three at most, contexts are divided until they fit."""
    monkeypatch.setattr(suffix_dedup, "HOT", most)
    rng = random.Random(11)
    some = lambda n: " ".join(rng.choice(["é", "bb", "ccc", "x\ufffd"]) + str(rng.randrange(9)) for _ in range(n))
    core, passage = some(7), some(30)
    texts = [some(rng.randrange(0, 12)) + "\n" + core + " " + some(rng.randrange(0, 12)) for _ in range(60)]
    texts += [some(5) + " " + passage + "\t" + some(4) for _ in range(8)] + [texts[0], None, "", passage, "la " * 40, "x y " * 30 + "la " * 12]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in suffix_dedup.drop_repeats(d, unit=suffix_dedup.Unit("words", 9, 3, 8)).orderBy("doc_id").collect()]
    assert [(t or "").split() for t in got] == brute_words(texts, 9)
    assert [t for t, old in zip(got, texts, strict=True) if old is None] == [None]
    left = [t for t, old in zip(got, texts, strict=True) if t == old]
    assert any("\ufffd" in (t or "") for t in left)


@pytest.mark.parametrize("most", [800, 4])
def test_divided_groups_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "HOT", most)
    rng = random.Random(21)
    core = "the same thirty bytes in them all"
    some = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    left, right = [some(30) for _ in range(6)], [some(30) for _ in range(6)]
    texts = [rng.choice([*left, some(30)]) + core + rng.choice([*right, some(30)]) for _ in range(250)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(d, unit=suffix_dedup.Unit("bytes", 50, 16, 1)).collect()))
    assert [(a, b, c, bytes(k)) for _, a, b, c, k in got] == brute_repeats(texts, 50)


def test_query_of_repeats(spark, tmp_path):
    """Bytes by 400-byte strings, words by runs of 50 words; rows of one id and rows that repeat have their own figures."""
    rng = random.Random(31)
    some = lambda n, size: " ".join("".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    short, long = some(55, 3), some(60, 9)
    texts = [(i, some(30, 5) + " " + [short, long, ""][i % 3] + " " + some(20, 5)) for i in range(12)]
    texts += [(3, None), (3, "other"), (None, texts[0][1]), texts[0], (40, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in suffix_dedup.op4(spark, str(tmp_path)).collect()))
    ts = [t for _, t in texts]
    want = [(str(i), n, gone, runs, hashlib.sha256(kept).hexdigest(), len((t or "").split()) - len(left)) for (i, t), (n, gone, runs, kept), left in zip(texts, brute_repeats(ts, 400), brute_words(ts, 50), strict=True)]
    assert got == sorted(want) and {w[5] for w in want} > {0, 55, 60}


def test_many_documents_meet_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_SENT", 0)
    texts = ["one two three four five six seven eight nine ten " * 3 + str(i % 3) for i in range(9)] + ["other", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.remove_repeats(d, unit=suffix_dedup.Unit("bytes", 50, 16, 1)).collect()))
    assert [(a, b, c, bytes(k)) for _, a, b, c, k in got] == brute_repeats(texts, 50)


def test_cut_texts_keep_their_characters(spark):
    """By bytes: characters that a span cuts stay, also a replacement character of the text; null stays null."""
    same = "é日" * 30
    texts = ["\ufffda" + same + "b\ufffd", "é" + same + "日c", None, "\ufffd"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in suffix_dedup.drop_repeats(d, unit=suffix_dedup.Unit("bytes", 41, 16, 1)).orderBy("doc_id").collect()]
    assert got == ["\ufffdab\ufffd", "é日c", None, "\ufffd"]


# --- chat formatting


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a</s>b"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, "assistant", "\\<|im_end|>\n<|im_sep|>"), (1, 3, None, ""), (None, 0, "odd\n%<|", "x"), (1, None, "system", "first"), (2, 0, "assistant", "[INST]"), (2, 1, "assistant", "\\\\[/INST]")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = {r.conv_id: r for r in chat.format_conversations(d).select("*", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert [tuple(t) for t in out[1].back] == [("system", "first"), ("user", "a</s>b"), ("user", ""), ("user", ""), ("assistant", "\\<|im_end|>\n<|im_sep|>"), ("", "")]
    assert [tuple(t) for t in out[None].back] == [("odd\n%<|", "x")]
    assert out[2].formatted.count("<|im_start|>") == 1 and "".join(s.text for s in out[2].segments if s.loss) == "\\[INST]\\\\\\[/INST]"
    assert chat.format_conversations(d.where("false")).count() == 0


def test_long_texts_and_conversations(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i} <|im_end|>") for i in range(3000)] + [(2, 0, "user", LONG + "</s>" + LONG), (2, 1, "assistant", LONG)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r.back for r in chat.format_conversations(d).select("conv_id", chat.read_back(F.col("formatted")).alias("back")).collect()}
    for c in (1, 2):
        assert [tuple(t) for t in out[c]] == [(r[2], r[3]) for r in rows if r[0] == c]


# --- Jaccard join


def brute_links(rows, width=5, t=80):
    sets, parent = {}, {i: i for i, _ in rows}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_links_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 40, 80]))] for _ in range(25)]
    shared = [rng.choice(vocabulary) for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += shared
        if rng.random() < 0.1:
            w = w[: rng.randrange(len(w) + 1)]
        rows.append((i, " ".join(w).upper() if i % 9 == 0 else "\n".join(w)))
    rows += [(900, None), (901, ""), (902, "  ")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_links_of_odd_rows(docs, none):
    rows = jaccard_join.link_documents(docs).collect()
    assert len(rows) == len(ROWS)
    # A null id is smaller than all others, so it names the component that its text is in.
    assert {r.component_id for r in rows if r.doc_id in (1, None)} == {None}
    assert jaccard_join.link_documents(none).count() == 0
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {x: root(x) for p in pairs if p[0] != p[1] for x in p}


# --- sharding


def test_shards(spark):
    rng = random.Random(3)
    rows = [(i, "same text " * 9 if i % 3 == 0 else "x" * rng.randrange(0, 900)) for i in range(4000)] + [(7, None), (7, None), (8, "")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and sorted(size) == list(range(8)) and max(size.values()) < 1.05 * min(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)


def test_rows_against_a_plain_splitter(spark):
    """In key order, a text of one copy goes where its middle byte lies; copies go together."""
    rng = random.Random(13)
    rows = [(i, "x" * rng.randrange(0, 900) + str(i)) for i in range(3000)] + [(9000 + i, "copy") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = d.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    groups, total = {}, sum(len(r.text) + 1 for r in keyed)
    for r in keyed:
        groups.setdefault(r.h, []).append(r)
    want, before = {}, 0
    for h in sorted(groups):
        size = sum(len(r.text) + 1 for r in groups[h])
        want |= {r.doc_id: min(7, int((before + size / 2) * 8 // total)) for r in groups[h]}
        before += size
    got = sharding.assign_shards(d).collect()
    assert {r.doc_id: r.shard for r in got} == want
    for k in range(8):  # slots follow the key
        ids = [r.doc_id for r in sorted((r for r in got if r.shard == k), key=lambda r: r.slot)]
        h = {r.doc_id: r.h for r in keyed}
        assert [h[i] for i in ids] == sorted(h[i] for i in ids)


def test_written_shards_have_every_row(spark, docs, tmp_path):
    """Rows that are alike get a slot each, and two texts of one id their own places."""
    d = docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("plumless"))).unionByName(docs.where("doc_id = 3").withColumn("text", F.lit("buckeroo")))
    sharding.write_shards(d, str(tmp_path / "out"), 3)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    assert sorted(map(str, got.select(*d.columns).collect())) == sorted(map(str, d.collect()))
    slots = {}
    for r in got.collect():
        slots.setdefault(r["_shard"], []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_of_odd_rows(docs, none):
    assert sharding.assign_shards(docs).count() == len(ROWS)
    assert sharding.assign_shards(none).count() == 0


def test_range_by_binary_search(spark):
    cuts = sorted({(random.Random(i).randrange(100), 0) for i in range(20)})
    got = spark.range(100).select("id", sharding._range_of(F.struct(F.col("id").alias("h"), F.lit(0).cast("long").alias("t")), cuts).alias("r")).collect()
    assert all(r.r == sum(c <= (r.id, 0) for c in cuts) for r in got)


# --- models


def held_out(spark, folder, query, column):
    rows = query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", column).collect()
    good, bad = [r.score for r in rows if r[column]], [r.score for r in rows if not r[column]]
    auc = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    return auc, rows


def test_quality_on_held_out_rows(spark):
    auc, rows = held_out(spark, "/root/testdata/sf0.1", quality_model.op9, "quality")
    assert auc > 0.98 and sum(r.predicted == r.quality for r in rows) > 0.97 * len(rows)


def test_toxicity_on_held_out_rows(spark):
    auc, rows = held_out(spark, "/root/testdata/sf0.1", toxicity.op8, "toxic")
    assert auc > 0.93 and sum(r.predicted > r.toxic for r in rows) < 0.02 * len(rows)


def test_log_ratios_by_hand(spark):
    """Every expression's two probabilities from counts, continuation counts and discounts, over all that there are."""
    rng = random.Random(5)
    word = lambda toxic: rng.choice(["stupid", "idiots"] if toxic and rng.random() < 0.5 else ["river", "stone", "garden", "window"])
    rows = [(i, int(i % 3 == 0), " ".join(word(i % 3 == 0) for _ in range(9))) for i in range(60)]
    rows.append((60, 0, None))
    counts = toxicity._counts(spark.createDataFrame(rows, "id long, toxic int, text string"))
    n = [Counter(), Counter()]
    for _, toxic, text in rows:
        data = b" " * 6 + " ".join(words(text)).encode() + b" " if text else b""
        n[toxic].update({data[i : i + 7] for i in range(len(data) - 6)})
    seen = {r.g.to_bytes(7, "big"): (r.n0, r.n1) for r in counts.collect()}
    assert seen == {g: (n[0][g], n[1][g]) for g in n[0] | n[1]}
    low, first = Counter(g[1:] for g in seen), Counter(g[0] for g in seen)
    share = sum(t for _, t, _ in rows) / len(rows)

    def evidence(g):
        e = sum(seen[g]) * share
        return abs(seen[g][1] - e) / (e * (1 - share) + 0.5) ** 0.5 >= 3

    total = [sum(x.values()) for x in n]
    free = [1 - sum(max(n[c][g] - 0.75, 0) for g in seen if evidence(g)) / total[c] for c in (0, 1)]
    p = lambda c, g: (max(n[c][g] - 0.75, 0) if evidence(g) else 0) / total[c] + free[c] * low[g[1:]] * first[g[0]] / len(seen) ** 2
    want = {g: np.log(p(1, g) / p(0, g)) - np.log(free[1] / free[0]) for g in seen if evidence(g)}
    got = {r.g.to_bytes(7, "big"): r.llr for r in toxicity.log_ratios(counts, (len(rows) - sum(t for _, t, _ in rows), sum(t for _, t, _ in rows))).collect()}
    assert got.keys() == want.keys() and len(want) > 5 and all(abs(got[g] - want[g]) < 1e-9 for g in want)
    model = toxicity.Model(np.array([int.from_bytes(g, "big") for g in want]), np.array(list(want.values())))
    data = b" " * 6 + b"you stupid river "
    by_hand = sum(want.get(data[i : i + 7], 0) for i in range(len(data) - 6)) / (len(data) - 6)
    assert abs(model.difference("You, stupid river!") - by_hand) < 1e-12 and by_hand > 0 and model.difference(None) == 0


def test_ranking_against_a_plain_fit():
    """The weights are the minimum of the pairs' logistic loss: no step along any axis lowers it; the cut has the fewest errors."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, quality_model.N_FEATURES))
    good = x[:, 0] + 0.5 * x[:, 3] + 0.3 * rng.normal(size=300) > 0
    made = quality_model.Ranking(x, good)
    z = made._scaled(x)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    draw = np.random.default_rng(9)
    d = z[draw.choice(a, 6000)] - z[draw.choice(b, 6000)]
    loss = lambda w: np.logaddexp(0, -(d @ w)).sum() + 0.5 * 1e-3 * len(d) * (w @ w)
    least = loss(made.weights)
    assert all(loss(made.weights + e * step) >= least - 1e-6 for e in np.eye(len(made.weights)) for step in (-1e-3, 1e-3))
    p = made.probabilities(x)
    errors = lambda cut: ((z @ made.weights >= cut) != good).sum()
    assert ((p >= 0.7) != good).sum() <= min(errors(c) for c in np.quantile(z @ made.weights, np.linspace(0, 1, 101))) + 2


def test_learning_from_ids_with_several_texts(spark):
    """The same scores whatever the rows' order, with ids that have two texts and rows that repeat."""
    rng = random.Random(2)
    some = lambda bad: " ".join(rng.choice(["stupid", "idiot"] if bad else ["river", "stone"]) for _ in range(12))
    rows = [(i % 60, some(i % 2)) for i in range(90)]
    rows += rows[:10]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(60)], "id long, quality int, toxic int")
    out = []
    for _ in range(2):
        rng.shuffle(rows)
        d = spark.createDataFrame(rows, "id long, text string")
        ranking = quality_model.learn(d, labels.select("id", "quality"))
        out.append((sorted((r.id, round(r.score, 9)) for r in toxicity.score(d, labels.select("id", "toxic")).collect()), ranking.weights.round(6).tolist()))
    assert out[0] == out[1]


def test_all_expressions_with_evidence_count(spark, monkeypatch):
    """Past MOST_EXPRESSIONS the scores are the same, for repeated, null and wordless rows too."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "a text"), (1, "a text"), (1, None), (-1, "")], docs.schema))
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    rows = lambda: sorted((str(r.id), round(r.score, 9)) for r in toxicity.score(docs, labels).collect())
    want = rows()
    assert len({s for _, s in want}) > 10
    monkeypatch.setattr(toxicity, "MOST_EXPRESSIONS", 5)
    assert rows() == want


def test_models_of_odd_rows(spark, docs, none, labels):
    d = docs.select(F.col("doc_id").alias("id"), "text")
    for lab in (labels, labels.where("false")):
        got = toxicity.score(d, lab.select("id", "toxic")).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        ranking = quality_model.learn(d, lab.select("id", "quality"))
        got = quality_model.score(docs, ranking, "doc_id").collect()
        assert len(got) == len(ROWS) and all(0 <= r["_score"] <= 1 for r in got)
    assert toxicity.score(none.select(F.col("doc_id").alias("id"), "text"), labels.select("id", "toxic")).count() == 0
    assert quality_model.keep_good(none, labels.select("id", "quality")).count() == 0
    assert quality_model.keep_good(docs, labels.select("id", "quality")).columns == docs.columns


# --- urls


def test_urls(spark):
    rows = [(1, "HTTP://A.Example.ORG/es/x?q"), (2, "x://example.org/en/12#a"), (3, "x://sub.b.com/fr/"), (4, "x://b.com/de/"), (5, None), (6, "no scheme"), (7, "x://notexample.org/es/"), (8, "x://org"), (9, "x://b.net/"), (9, "x://b.net/")]
    out = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, host int"), spark.createDataFrame([(9, False)], "id long, good boolean")).collect()}
    assert [out[i].rule for i in range(1, 10)] == ["example.org/es/", "example.org/en/1", "com/fr/", "com/de/", None, None, "org/", None, None]
    assert (out[1].host, out[1].path) == ("a.example.org", "/es/x") and (out[5].host, out[5].path) == ("", "")
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(empty, spark.createDataFrame([], "id long, good boolean")).count() == 0


def brute_bounds(rows, outcomes, floor=0.5, z=1.645):
    """The lower bound of each host, by hand: suffix, domain and host shrink to the level above."""
    n, good = Counter(), Counter()
    for page, host in rows:
        n[host] += page in outcomes
        good[host] += outcomes.get(page, 0)
    domain = {h: ".".join(h.split(".")[-2:]) for h in n}
    suffix = {h: h.split(".")[-1] for h in n}

    def weight(children):  # (n, good, mean of the parent)
        children = [c for c in children if c[0]]
        s, b, v = (sum(f(*c) for c in children) for f in (lambda k, g, m: k * (g / k - m) ** 2, lambda k, g, m: m * (1 - m), lambda k, g, m: k * m * (1 - m)))
        return 1 / max(min((s - b) / (v - b) if v > b else 0.001, 0.5), 0.001) - 1

    total = lambda of, k: (sum(n[h] for h in n if of[h] == k), sum(good[h] for h in n if of[h] == k))
    m0 = (sum(good.values()) + 1) / (sum(n.values()) + 2)
    suffixes = {k: total(suffix, k) for k in set(suffix.values())}
    k1 = weight([(*x, m0) for x in suffixes.values()])
    m1 = {k: (g + k1 * m0) / (c + k1) for k, (c, g) in suffixes.items()}
    domains = {k: total(domain, k) for k in set(domain.values())}
    k2 = weight([(*x, m1[k.split(".")[-1]]) for k, x in domains.items()])
    m2 = {k: (g + k2 * m1[k.split(".")[-1]]) / (c + k2) for k, (c, g) in domains.items()}
    k3 = weight([(n[h], good[h], m2[domain[h]]) for h in n])
    out = {}
    for h in n:
        m = (good[h] + k3 * m2[domain[h]]) / (n[h] + k3)
        out[h] = m - z * (m * (1 - m) / (n[h] + k3 + 1)) ** 0.5
    return out


def test_reputation_blocks_hosts(spark):
    """A host of bad pages goes with its subdomains' domain pulled down; one of good pages stays; bounds as by hand."""
    rng = random.Random(6)
    hosts = {"good.alpha.test": 0.97, "www.alpha.test": 0.95, "bad.beta.test": 0.02, "new.beta.test": 0.05, "one.gamma.info": 0.5, "x.delta.info": 0.9}
    rows = [(1000 * k + i, h) for k, h in enumerate(hosts) for i in range(3 if h.startswith("new") else 120)]
    outcomes = {p: int(rng.random() < hosts[h]) for p, h in rows if rng.random() < 0.7}
    pages = spark.createDataFrame([(p, f"http://{h}/{p}") for p, h in rows], "page_id long, url string")
    given_ = spark.createDataFrame([(p, bool(g)) for p, g in outcomes.items()], "id long, good boolean")
    want = brute_bounds(rows, outcomes)
    got = url_filter.judge_urls(pages, given_).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.lower_bound - want[r.host]) < 1e-9 and r.verdict == ("allow" if want[r.host] >= 0.5 else "block")
    verdicts = {r.host: r.verdict for r in got}
    assert verdicts["good.alpha.test"] == "allow" and verdicts["bad.beta.test"] == "block" and verdicts["new.beta.test"] == "block"


def test_registered_domains_and_long_urls(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.com.br", "a.gov.au", "a.b.go.jp", "news.bbc.com", "org", "", "a.co", "x.y.k12.tr"]
    d = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", url_filter.domain_of(F.col("host")).alias("d"), url_filter.suffix_of(F.col("host")).alias("s"))
    got = {r.host: (r.d, r.s) for r in d.collect()}
    assert got["a.b.co.uk"] == ("b.co.uk", "co.uk") and got["b.co.uk"][0] == "b.co.uk" and got["co.uk"][1] == "co.uk" and got["x.com.br"] == ("x.com.br", "com.br")
    assert got["a.gov.au"] == ("a.gov.au", "gov.au") and got["a.b.go.jp"] == ("b.go.jp", "go.jp") and got["news.bbc.com"] == ("bbc.com", "com") and got["org"] == ("org", "org") and got[""] == ("", "") and got["a.co"] == ("a.co", "co")
    long = spark.createDataFrame([(1, "http://" + "h" * 200_000 + ".com/de/" + "p" * 300_000 + "?q")], "page_id long, url string")
    r = url_filter.judge_urls(long, spark.createDataFrame([], "id long, good boolean")).first()
    assert len(r.host) == 200_004 and len(r.path) == 300_004 and (r.rule, r.verdict) == ("com/de/", "block")


# --- the pipeline


@pytest.fixture(scope="module")
def corpus():
    return pytest.importorskip("corpus_pipeline")


def test_near_duplicates_stage(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_links([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus.near_duplicates(spark, docs, sf).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_quality_stage(spark, corpus):
    """The documents at or above the threshold of a plain fit of the same pairs, in the same order."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        label[r.doc_id] = min(r.quality, label.get(r.doc_id, 1))
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(i for i in text if i in label)
    ranking = quality_model.Ranking(np.array([quality_model.features(text[i]) for i in ids]), np.array([label[i] == 1 for i in ids]))
    scores = ranking.probabilities(np.array([quality_model.features(text[i]) for i in sorted(text)]))
    kept = corpus.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, p in zip(sorted(text), scores, strict=True) if p >= 0.7]
    good = [i for i in ids if label[i] == 1]
    left = {r.doc_id for r in kept.collect()}
    assert sum(i in left for i in good) > 0.95 * len(good)


def test_passages_stage(spark, sf, corpus):
    docs = corpus.near_duplicates(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    extra = " ".join(f"passage{i}" for i in range(55))
    rows = [(i, (t or "") + " " + extra if i % 9 == 0 else t) for i, t in rows]
    got = corpus.repeated_passages(spark, spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars long"), sf).orderBy("doc_id").collect()
    assert [(r.text or "").split() for r in got] == brute_words([t for _, t in rows], 50)
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None) and not any("passage3 " in (r.text or "") for r in got)


def test_leaks_stage(spark, sf, corpus):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - 9) if b else 0):
            grams.setdefault(tuple(b[i : i + 10]), item)
    sizes = sorted({len(g) for g in grams})
    got = {r.doc_id: r.text for r in corpus.benchmark_leaks(spark, docs, sf).collect()}
    cut = 0
    for r in docs.collect():
        w = words(r.text)
        hit = {k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(i, i + n)}
        assert words(got[r.doc_id]) == [x for i, x in enumerate(w) if i not in hit]
        cut += bool(hit)
        assert hit or got[r.doc_id] == r.text
    assert cut


def test_tokens_stage(spark, sf, corpus, tokenizer):
    _, reference = tokenizer
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in corpus.tokens(spark, docs, sf).collect():
        ids = reference.encode_ordinary(text[r.doc_id])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_stages_of_odd_rows(spark, sf, docs, none, corpus):
    """Null, empty and blank texts, rows and ids that repeat, clashing columns, an empty table."""
    odd = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")).withColumn("n_chars", F.lit(7).cast("long"))
    for name, stage in corpus.STAGES[:-1]:
        out = stage(spark, odd, sf)
        assert out.columns == odd.columns, name
        rows = out.collect()
        if name == "benchmark_leaks" or name == "repeated_passages":
            assert len(rows) == len(ROWS) and [r.text for r in rows if r.doc_id == 2] == [None], name
            assert [r.text for r in rows if r.doc_id in (3, 4, 6)] == ["", " \n\t ", "tiny"], name
        if name == "repeated_passages":
            assert [r.text for r in rows if r.doc_id in (1, None)] == [""] * 3
        if name == "near_duplicates":
            # The null id is the smallest of its component; its row stays and the two like it go.
            assert sorted(str(r.doc_id) for r in rows) == sorted(["None", "2", "3", "4", "5", "6", "7"])
        assert stage(spark, odd.where("false"), sf).count() == 0, name
    assert corpus.tokens(spark, odd, sf).count() == len(ROWS) and corpus.tokens(spark, odd.where("false"), sf).count() == 0


def test_pipeline(spark, sf, corpus):
    out = corpus.run(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() < n
