"""Token-id files: documents in ascending id order, coded by ``rans`` segments.

``write_token_files`` deals the documents out by ranges of (id, text hash), encodes each
range in order and writes one row per segment (range, number in the range, ids and
token counts of its documents, coded bytes) through Spark's Parquet writer, so the files
may lie in any store.  A segment closes at the end of the document with which it
reaches ``SEGMENT_TOKENS``; its frequency table is its own, so no pass over all data
comes before the coding and each range can be written again alone.
``read_token_files`` decodes the segments and places every document.

Null ids come first; documents of one id follow each other in the order of their texts' hash;
null and empty texts hold only the end id; an empty table gives an empty file set.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapscope.llm.bpe import byte_letters
from gapscope.llm.common import arrow_pass, pieces, shuffle_partitions
from gapscope.llm.rans import decode_segment, encode_segment

SEGMENT_TOKENS = 1 << 21
ENTRIES = 400_000
BATCH = 256
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&|]*)")


class LibraryIds:
    """Ids of the tokenizers library, with a dictionary of stretches between blanks.

    For the tokenizer files whose normaliser and cutter make every white space a border
    and drop it (checked from the file; others are encoded text by text), a text's ids are
    those of its stretches.  A stretch of letters and marks needs only the model's part
    of the library; all else goes through its whole ``encode``.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(spec)
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [(s.get("type"), s.get("behavior"), s.get("invert"), s.get("use_regex")) for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_stretch = (
            steps == ["NFC", "Replace", "Lowercase"] and cuts == [("Split", "Removed", True, None), ("ByteLevel", None, None, False)]
            and not spec.get("post_processor") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"]))
        self._letters = {b: c for b, c in byte_letters().items()}
        self._words: dict[str, bytes] = {}
        self._stretches = _Stretches(self)

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, key: str, make) -> bytes:
        ids = self._words.get(key)
        if ids is None:
            if len(self._words) >= ENTRIES:
                self._words.clear()
            ids = self._words[key] = make(key)
        return ids

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode()))
        return np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()

    def stretch(self, text: str) -> bytes:
        simple = _SIMPLE.fullmatch(text) if len(text) < 100 else None
        if simple is None:
            return self._encode(text)
        word, marks = simple.groups()
        return self._known(word.lower(), self._word) + (self._known(marks, self._encode) if marks else b"")

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.by_stretch:
            return self._encode(text)
        return b"".join(map(self._stretches.__getitem__, text.replace("\n", " ").split(" ")))


class _Stretches(dict):
    def __init__(self, owner: LibraryIds):
        self.owner = owner

    def __missing__(self, text: str) -> bytes:
        ids = self.owner.stretch(text) if text else b""
        if len(self) >= ENTRIES:
            self.clear()
        if len(text) < 60:
            self[text] = ids
        return ids


@lru_cache(maxsize=2)
def _library(spec: str) -> LibraryIds:
    return LibraryIds(spec)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                      segment_tokens: int = SEGMENT_TOKENS) -> None:
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("id"), "h").sortWithinPartitions(F.asc_nulls_first("id"), "h")
    numbered = ordered.select(F.spark_partition_id().alias("range"), "id", "t")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(spec.value)
        ids, texts, held, segment, number = [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            data = encode_segment(np.frombuffer(b"".join(texts), "<u4"))
            columns = [pa.array([number], pa.int32()), pa.array([segment], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                       pa.array([[len(t) // 4 for t in texts]], pa.list_(pa.int64())), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["range", "segment", "n_tokens", "ids", "sizes", "data"])

        for b in pieces(batches, BATCH):
            number = b.column(0)[0].as_py() if b.num_rows else number
            for i, t in zip(b.column(1), b.column(2)):
                ids.append(i.as_py())
                texts.append(library.encode(t.as_py()) + end)
                held += len(texts[-1]) // 4
                if held >= segment_tokens:
                    yield closed()
                    ids, texts, held, segment = [], [], 0, segment + 1
        if ids:
            yield closed()

    schema = "range int, segment long, n_tokens long, ids array<long>, sizes array<long>, data binary"
    arrow_pass(numbered, schema, of).write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and its ids), from the decoded segments."""
    files = spark.read.parquet(path)
    # where each segment starts: sums within its range, and of the ranges before (one row a range)
    ranges = files.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = files.select("range", "segment", (F.sum("n_tokens").over(Window.partitionBy("range").orderBy("segment")) - F.col("n_tokens")).alias("inside"))
    starts = inside.join(before, "range").select("range", "segment", (F.col("before") + F.col("inside")).alias("at"))
    kept = ", ids array<long>" if with_ids else ""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            number, segment, ids, sizes = (b.column(k)[0] for k in range(4))
            tokens = decode_segment(b.column(4)[0].as_py())
            sizes = sizes.values.to_numpy()
            ends = np.cumsum(sizes)
            if int(ends[-1]) != len(tokens):
                raise ValueError("a segment's documents do not fill it")
            own = [tokens[e - n:e] for e, n in zip(ends.tolist(), sizes.tolist())]
            columns = [pa.array(np.full(len(own), number.as_py(), np.int32)), pa.array(np.full(len(own), segment.as_py())), ids.values,
                       pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
            names = ["range", "segment", "doc_id", "inside", "n_tokens", "ids_crc32"]
            if with_ids:
                columns, names = columns + [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))], names + ["ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    read = arrow_pass(files.select("range", "segment", "ids", "sizes", "data"),
                      f"range int, segment long, doc_id long, inside long, n_tokens long, ids_crc32 long{kept}", of)
    return read.join(starts, ["range", "segment"]).select(
        "doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
