"""Byte-level BPE encoding by per-prefix dynamic programming, and decoding.

Every prefix of a piece has exactly one BPE encoding, so exactly one last token.
Going through the piece, an automaton over the vocabulary lists the tokens that
are a suffix of the current prefix; the one that is *compatible* with the last
token of the prefix before it is stored.  Following the stored tokens from the end
gives the ids.  Two tokens are compatible if encoding their bytes gives just these
two again: no merge across the border may come up while both of its sides still
stand (see ``Vocabulary.compatible``).

Texts are cut like the tokenizer file says: added tokens first, then the byte-level
pattern.  A worker keeps the ids of pieces, and of blank-separated stretches of
text, in dictionaries of bounded size; they only save work.

The tokenizer file is read on the driver and broadcast (a file of fixed size).  A
null text counts as empty and has no ids; null ids columns decode to an empty text;
ids outside the vocabulary are skipped when decoding; repeated rows are treated one
by one; empty tables give empty tables.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces

ENTRIES = 200_000            # dictionary entries a worker keeps
BATCH = 256
NEVER = 1 << 60

# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge order and the pair test of one byte-level BPE."""

    def __init__(self, vocab: dict[str, int], merges: list):
        of = {c: b for b, c in byte_letters().items()}
        self.tokens = {i: bytes(of[c] for c in t) for t, i in vocab.items() if all(c in of for c in t)}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(vocab[a + b], pair)
        self.automaton = ahocorasick.Automaton()
        for i, t in self.tokens.items():
            if t and (i in self.parts or len(t) == 1):
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}

    @lru_cache(maxsize=200_000)  # noqa: B019  one vocabulary a worker
    def _edge(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """The tokens along one edge of a token's merge tree, each with the rank that consumes it."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            pair = self.parts.get(token)
            if pair is None:
                return tuple(out)
            until, token = self.rank[pair], pair[side]

    def _crossed(self, a: int, b: int, joined: bool) -> bool:
        """Whether a merge across the border of a and b comes before both have formed.

        A merge of x (on a's right edge) and y (on b's left edge) happens if its rank
        comes before the rank that consumes x, and not after the one that consumes y
        (of equal ranks the leftmost goes first).  ``joined``: leave out a and b themselves.
        """
        rank = self.rank.get
        for x, x_until in self._edge(a, 1):
            for y, y_until in self._edge(b, 0):
                r = rank((x, y))
                if r is not None and r < x_until and r <= y_until and not (joined and x_until == y_until == NEVER):
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= 3 * ENTRIES:
                self._pairs.clear()
            known = self._pairs[key] = not self._crossed(a, b, joined=False)
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = self._whole[token] = pair is None or (
                self.whole(pair[0]) and self.whole(pair[1]) and not self._crossed(*pair, joined=True))
        return known

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        last = [-1] * (len(data) + 1)
        pair, done = self._pairs.get, -1
        for end, (token, n) in self.automaton.iter(data.decode("latin-1")):
            if end == done:                        # this prefix has its one last token
                continue
            at = end + 1 - n
            if at:
                before = last[at]
                if before < 0:
                    continue
                fits = pair(before << 24 | token)
                if fits is None:
                    fits = self.compatible(before, token)
            else:
                fits = self.whole(token)
            if fits:
                last[end + 1], done = token, end
        out, at = [], len(data)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("the vocabulary does not cover all bytes")
            out.append(token)
            at -= len(self.tokens[token])
        return out[::-1]


class _Ragged(Exception):
    """A stretch that is empty or has white space at an end: blanks do not cut the text safely."""


class Tokenizer:
    """Encoding and decoding as a tokenizer file of byte-level BPE describes."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, cut = spec["model"], spec["pre_tokenizer"]
        known = model["type"] == "BPE" and cut["type"] == "ByteLevel" and cut.get("use_regex", True) and not spec.get("normalizer")
        if not known or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain byte-level BPE")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with stripping or word borders are not known")
        self.blank_first = cut.get("add_prefix_space", False)
        self.vocabulary = Vocabulary(model["vocab"], model["merges"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._added = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        self._pattern = regex.compile(PATTERN)
        self._pieces: dict[str, bytes] = {}
        self._stretches: dict[str, bytes] = {}
        self._bytes = {**self.vocabulary.tokens, **{i: t.encode() for t, i in self.added.items()}}

    def _piece(self, piece: str) -> bytes:
        ids = self._pieces.get(piece)
        if ids is None:
            # a blank and a word that was a whole stretch is kept there, not twice
            ids = self._stretches.get(piece[1:]) if piece[0] == " " else None
            if ids is not None:
                return ids
            ids = _packed(self.vocabulary.encode(piece.encode()))
            if len(self._pieces) >= ENTRIES:
                self._pieces.clear()
            if len(piece) < 100:
                self._pieces[piece] = ids
        return ids

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._piece, self._pattern.findall(text)))

    def _stretch(self, word: str) -> bytes:
        """Ids of a blank and a word that no blank and no white space border touches."""
        ids = self._stretches.get(word)
        if ids is None:
            if not word or word[0].isspace() or word[-1].isspace():
                raise _Ragged
            cut = self._pattern.findall(" " + word)
            if len(cut) == 1:
                ids = self._pieces.get(cut[0]) or _packed(self.vocabulary.encode(cut[0].encode()))
            else:
                ids = b"".join(map(self._piece, cut))
            if len(self._stretches) >= ENTRIES:
                self._stretches.clear()
            if len(word) < 100:
                self._stretches[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.blank_first and not text.startswith(" "):
            text = " " + text
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                # a blank between two words belongs to the second: no piece reaches over it
                return self._cut(first) + b"".join(map(self._stretch, rest))
            except _Ragged:
                pass
        return self._cut(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._added is None or not self._added.search(text):
            return self._plain(text)
        return b"".join(np.uint32(self.added[t]).tobytes() if k % 2 else self._plain(t) for k, t in enumerate(self._added.split(text)))

    def decode(self, ids: list[int]) -> str:
        of = self._bytes
        try:
            data = b"".join(map(of.__getitem__, ids))
        except KeyError:
            data = b"".join(of.get(i, b"") for i in ids)
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _tokenizer(text: str) -> Tokenizer:
    return Tokenizer(text)


def _shared(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``ids`` array of int): one row per row of ``docs``."""
    spec, kind = _shared(docs, tokenizer_path), docs.schema[id_col].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(spec.value)
        for b in pieces(batches, BATCH):
            found = [own.encode(t.as_py()) for t in b.column(1)]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], [id_col, "ids"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return arrow_pass(narrow, f"{id_col} {kind}, ids array<int>", of)


def decode_ids(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows of ``tokens`` with their ids decoded; the ids column itself is left behind."""
    spec = _shared(tokens, tokenizer_path)
    others = [c for c in tokens.columns if c not in (ids_col, out_col)]
    narrow = tokens.select(*others, F.col(ids_col).alias(ids_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(spec.value)
        for b in pieces(batches, BATCH):
            texts = [own.decode(ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []) for ids in b.column(len(others))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*others, out_col])

    return arrow_pass(narrow, f"{schema}{', ' if others else ''}`{out_col}` string", of)


def encoded_and_decoded(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """Per document: count and digest of its ids, and the digest of the text decoded from them."""
    tokens = encode_texts(docs, tokenizer_path)
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    kept = [F.col("ids").alias("token_ids")] if keep_ids else []
    named = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), *kept, "ids")
    out = decode_ids(named, tokenizer_path)
    return out.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")
