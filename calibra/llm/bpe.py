"""Byte-level BPE encoding and decoding.

Each pre-token's bytes are read as Latin-1 text, so that an Aho-Corasick automaton over the vocabulary lists every
token at every position. The encoder takes the longest match that may follow the token before it and steps back where
no match fits. Whether two tokens may stand side by side is worked out from their merge trees once and memoised. The
result is what merging by rank gives, in time linear in the length of the pre-token.

Nulls encode as the empty text (no ids, no bytes). Rows are independent: repeated rows give repeated results, an empty
table an empty result. Texts of any length are encoded whole. New columns must not carry a name the input has.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from calibra.llm._common import free_name, give_back, slices, small_batches, table

VOCAB = "byte_bpe_50k.tiktoken"
#: Bytes that a generation of a worker's memo (of words, of words after a space, of token pairs) takes, and those of an
#: entry beside its key and value.
MEMO_BYTES, ENTRY_BYTES = 48 << 20, 190
#: Longer runs of text are not remembered: they hardly come again.
LONGEST_KEY = 64
_MANY_CHARS = 4_000_000
_WIDE = re.compile(r"\s\s|\s$|^\n")
_RUNS = re.compile(r"\s*\S+|\s+")
_loaded: dict[str, "ByteBPE"] = {}


class _Memo(dict):
    """A bounded memo of two generations: what was not asked for while the young one filled up is forgotten.

    A key that only the old generation knows moves into the young one. When the young one has taken `most` bytes it becomes
    the old one, so frequent keys stay and each generation is bounded by bytes.
    """

    def __init__(self, work, most: int):
        super().__init__()
        self.work, self.old, self.most, self.room = work, {}, most, most

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.work(key)
        if isinstance(key, int):
            self.room -= ENTRY_BYTES
        elif len(key) <= LONGEST_KEY:
            self.room -= ENTRY_BYTES + 2 * len(key) + len(found)
        else:
            return found
        if self.room < 0:
            self.old, self.room = dict(self), self.most
            self.clear()
        self[key] = found
        return found


class ByteBPE:
    """The vocabulary of one rank file and the tables derived from it."""

    def __init__(self, ranks: bytes, pattern: str, memo_bytes: int = MEMO_BYTES):
        import ahocorasick
        import regex

        self.token_id = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.token_bytes = [b""] * (max(self.token_id.values()) + 1)
        for token, i in self.token_id.items():
            self.token_bytes[i] = token
        self.length = [len(b) for b in self.token_bytes]
        self.pattern = regex.compile(pattern)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter = [-1] * len(self.token_bytes)
        self.automaton = ahocorasick.Automaton()
        for i, token in enumerate(self.token_bytes):
            if token and (len(token) == 1 or self._find_parts(i, token)):
                self.automaton.add_word(token.decode("latin-1"), i)
        for i, token in enumerate(self.token_bytes):
            known = (self.token_id.get(token[:at], -1) for at in range(len(token) - 1, 0, -1))
            self.shorter[i] = next((k for k in known if k in self.parts or k >= 0 and self.length[k] == 1), -1)
        self.automaton.make_automaton()
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.lengths = np.array(self.length, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.fits = _Memo(lambda key: self._stable(key >> 32, key & 0xFFFFFFFF), memo_bytes)
        self.words = _Memo(self._encode_run, memo_bytes)
        self.spaced = _Memo(lambda run: self._encode_run(run if run[:1] == "\n" else f" {run}"), memo_bytes)

    def _find_parts(self, i: int, token: bytes) -> bool:
        """The last merge that makes a token, from merges of lower rank; False if no merge makes it."""
        for at in range(1, len(token)):
            left, right = self.token_id.get(token[:at]), self.token_id.get(token[at:])
            if left is not None and right is not None and max(left, right) < i and self._stable(left, right):
                self.parts[i] = self.merged[left, right] = left, right
                self.merged[left, right] = i
                return True
        return False

    def _stable(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens side by side as they are.

        Undoes the merges along the border from the latest; a merge across the border that ranks before the merge
        undone last would have come first. On equal ranks the merge further left comes first.
        """
        bound = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left, undo_right = self.parts.get(left), self.parts.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                bound, left = left, undo_left[1]
            else:
                bound, right = right + 0.5, undo_right[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        if piece in self.token_id:
            return [self.token_id[piece]]
        n, length, shorter, fits = len(piece), self.length, self.shorter, self.fits
        longest = [-1] * (n + 1)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - length[token]] = token  # matches come in the order of their ends
        open_ends = [True] * (n + 1)
        chosen: list[int] = []
        pos, token, before = 0, longest[0], -1
        while pos < n:
            while token >= 0 and not (open_ends[pos + length[token]] and (before < 0 or fits[before << 32 | token])):
                token = shorter[token]
            if token >= 0:
                chosen.append(token)
                pos += length[token]
                before, token = token, longest[pos]
            else:
                open_ends[pos] = False
                last = chosen.pop()
                pos -= length[last]
                before, token = chosen[-1] if chosen else -1, shorter[last]
        return chosen

    def _encode_run(self, run: str) -> bytes:
        """Packed ids of a run of text that the pattern never joins with what stands around it."""
        ids = [i for piece in self.pattern.findall(run) for i in self.encode_piece(piece.encode())]
        return np.array(ids, "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers.

        No match of the pattern goes from a character that is no white space on to white space, so each run of white
        space with the characters after it can be encoded, and remembered, by itself.
        """
        if len(text) < _MANY_CHARS:
            if not _WIDE.search(text):  # single spaces only: splitting at them is the same, and faster
                first, *rest = text.replace("\n", " \n").split(" ")
                return self.words[first] + b"".join(map(self.spaced.__getitem__, rest)) if first else b"".join(map(self.spaced.__getitem__, rest))
            return b"".join(map(self.words.__getitem__, _RUNS.findall(text)))
        out, found = [], (m[0] for m in _RUNS.finditer(text))
        while part := list(islice(found, 60_000)):
            out.append(b"".join(map(self.words.__getitem__, part)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


def _coder(ranks: bytes, pattern: str, memo_bytes: int = MEMO_BYTES) -> ByteBPE:
    """One coder per Python worker, vocabulary and size of memo."""
    key = f"{hashlib.sha256(ranks + pattern.encode()).hexdigest()}-{memo_bytes}"
    if key not in _loaded:
        _loaded[key] = ByteBPE(ranks, pattern, memo_bytes)
    return _loaded[key]


def _spread(spark: SparkSession, vocab: str):
    """The rank file (a path, or a name of public_tokenizers) for all workers: its size is the vocabulary's."""
    with open(vocab if "/" in vocab else public_tokenizers.path(vocab), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocab: str = VOCAB, pattern: str = public_tokenizers.PATTERN, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """df with the token ids of each whole text as array<int>. A smaller memo takes less of a worker's memory and more time."""
    free_name(df, ids)
    small_batches(df)
    ranks = _spread(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern, memo_bytes)
        for batch in slices(batches, text):
            packed = [coder.encode_packed(t or "") for t in batch.column(text).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*batch.schema.names, ids])
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocab: str = VOCAB, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """df with the bytes that the ids stand for; null ids give no bytes."""
    free_name(df, out)
    small_batches(df)
    ranks = _spread(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            found = [coder.decode(np.array(x or (), np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encodes and decodes each text in one pass and keeps digests only: key, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(df)
    ranks = _spread(df.sparkSession, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks.value, pattern)
        for batch in slices(batches, 1):
            n, ids, back = [], [], []
            for t in batch.column(1).to_pylist():
                packed = coder.encode_packed(t or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(coder.decode(np.frombuffer(packed, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    kept = df.select(key, text)
    return kept.mapInArrow(run, T.StructType([kept.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}
