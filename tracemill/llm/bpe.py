"""Byte-level BPE encoding and decoding by tree reduction.

Encodings of neighbouring strings form a monoid: to join two of them, a window of tokens on both sides
of the seam is encoded anew and grows until the tokens outside provably stay as they are. The proof is
local. A token list is *the* encoding of its bytes if each token encodes to itself and each
neighbouring pair encodes, taken alone, to that same pair; so once the window's first and last tokens
stand in stable pairs with what lies outside, nothing further out can change.

A piece (one match of the split pattern) is cut into halves down to LEAF bytes, leaves are merged by
rank, and halves are joined on the way up. Decoding concatenates up a tree likewise: runs of RUN tokens, then
neighbouring ones.

Everything is per document: no shuffle, no state but the vocabulary and bounded caches.

Defined results: null text encodes as an empty one, to no tokens; rows that repeat are encoded each;
an empty table gives an empty result; extra columns stay in encode() and are dropped in the query.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import fresh_names, map_arrow, table

#: Bytes of a piece that are merged directly.
LEAF = 24
#: Tokens that decoding joins directly.
RUN = 512
#: Above all ranks.
NO_RANK = 1 << 60
#: Entries a cache may have before it is emptied.
CACHE = 150_000
#: Texts of an Arrow batch encoded at a time.
SLICE = 256


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """By rank: the lowest-ranked neighbouring pair merges first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        get = ranks.get
        edge = list(range(len(piece) + 1))  # where the parts begin, and the end
        pairs = [get(piece[i : i + 2], NO_RANK) for i in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != NO_RANK:
            i = pairs.index(best)
            del edge[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(piece[edge[i - 1] : edge[i + 1]], NO_RANK)
            if i < len(pairs):
                pairs[i] = get(piece[edge[i] : edge[i + 2]], NO_RANK)
        return [ranks[piece[a:b]] for a, b in zip(edge, edge[1:], strict=False)]

    def stable(self, a: int, b: int) -> bool:
        """Whether the pair, taken alone, encodes to itself."""
        got = self._pairs.get((a, b))
        if got is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            got = self._pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of a's bytes followed by b's."""
        if not a or not b:
            return a + b
        if self.stable(a[-1], b[0]):
            return a + b
        left = right = 1
        while True:
            i, j = max(0, len(a) - left), min(len(b), right)
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, a[i:] + b[:j])))
            opens = i == 0 or self.stable(a[i - 1], window[0])
            closes = j == len(b) or self.stable(window[-1], b[j])
            if opens and closes:
                return a[:i] + window + b[j:]
            left, right = left if opens else 2 * left, right if closes else 2 * right

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:  # a piece that is a token stays one
            return [whole]
        return self._tree(piece)

    def _tree(self, piece: bytes) -> list[int]:
        """Halves are joined level by level, so depth is no matter of recursion."""
        level = [self.merge(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> array:
        ids, known = array("I"), self._pieces
        for piece in self.split(text):
            got = known.get(piece)
            if got is None:
                got = tuple(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
                if len(piece) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = got
            ids.extend(got)
        return ids

    def decode(self, ids) -> bytes:
        """Runs of tokens are joined, then neighbours, level by level up the tree."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + RUN])) for i in range(0, len(ids), RUN)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One a worker: the vocabulary is read where it is used and never shipped."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def forget() -> None:
    """Drops vocabularies and caches: workers live on after a task, and may have others to do."""
    _CODECS.clear()


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col="text", out_col="token_ids") -> DataFrame:
    """docs with out_col array<int>: the text's token ids; _out_col where docs has such a column."""
    (out_col,) = fresh_names(docs, out_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                ids = pa.array([c.encode(t or "") for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out_col])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(out_col, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, vocabulary: str, pattern: str, ids_col="token_ids", out_col="decoded") -> DataFrame:
    """encoded with out_col binary: the bytes of the token ids."""
    (out_col,) = fresh_names(encoded, out_col)
    at = encoded.columns.index(ids_col)

    def run(batches):
        c = codec(vocabulary, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                out = pa.array([c.decode(x or ()) for x in batch.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, out_col])

    return map_arrow(encoded, run, StructType([*encoded.schema.fields, StructField(out_col, BinaryType())]))


def digests(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], text_col="text") -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256, encoding and decoding in one pass."""
    docs = docs.select(*keep, text_col)
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        c = codec(vocabulary, pattern)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                batch = whole.slice(i, SLICE)
                n, a, b = [], [], []
                for text in batch.column(len(keep)).to_pylist():
                    ids = c.encode(text or "")
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=names)
        forget()

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return map_arrow(docs, run, schema)


def multilingual() -> tuple[str, str]:
    """Vocabulary and split pattern of the public multilingual 50k tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), *multilingual(), ["doc_id"])
