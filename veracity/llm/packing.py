"""Harmonic packing of token sequences.

A piece of length l belongs to the reciprocal-capacity class k = floor(C / l), that is C/(k+1) < l <= C/k, and
every sequence of class k holds exactly k pieces. Plain harmonic packing pads up to C/(k+1) of a sequence, so
lengths are first cut: whole sequences of C come off long documents, and a rest that fills its share C/k badly
gives up a piece of exactly floor(C/(k+1)) tokens, which leaves a rest far smaller than itself.

Pieces are numbered within their class by a two-level prefix sum over hash buckets, so every worker fills
its own run of sequences by arithmetic alone. What is left below a full sequence of a class (fewer than k
pieces; fewer than 10,000 rows in all, whatever the input) is packed first-fit decreasing.

Cases: a null or empty text has just the end token; texts of any length are handled whole; null ids and
repeated rows are packed like others; an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

import json
import os
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import before, materialize

CAPACITY = 2048
#: A piece that fills its share of the capacity to this part is not cut further.
FULL = 0.97
#: Pieces of this class and above (at most 1/32 of the capacity) are never cut: they pad 1/33 at most.
UNCUT_CLASS = 32
#: Words whose ids a Python worker remembers at most; then it starts anew.
CACHE_WORDS = 500_000
END_TOKEN = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, k int"


def cut(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        piece = rest if k >= UNCUT_CLASS or rest >= FULL * capacity / k else capacity // (k + 1)
        out.append(piece)
        rest -= piece
    return out


#: The pattern by which the tokenizers that `by_words` accepts cut normalised text.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of these after a letter is a unit of its own.
_MARKS = string.punctuation.encode()
#: Byte-level tokenizers write printable bytes as themselves, the others as characters from 256 on.
_BYTE_CHARS = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


def by_words(tokenizer) -> bool:
    """Whether a text's ids are those of its words: lower case, white space and units as assumed below, and no added token that reaches over white space."""
    spec = json.loads(tokenizer.to_str())
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
    units = [(n["type"], n.get("pattern"), n.get("invert"), n.get("use_regex")) for n in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    tokens = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or t["content"].split() != [t["content"]]) for t in spec["added_tokens"])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and units == [("Split", {"Regex": UNITS}, True, None), ("ByteLevel", None, None, False)]
        and tokens and spec["post_processor"] is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    )


class WordIds(dict):
    """Little-endian 32-bit ids by word, each worked out when first asked for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        text = stem.decode()
        if (lower := word.lower()) != word and word.isascii() and b"<|" not in word:
            ids = self[lower]
        elif stem and len(stem) < len(word) and b"<|" not in word and max(text) <= "\xff" and text[-1].isalpha():
            ids = self[stem] + self[word[len(stem) :]]
        else:
            found = self._ids(word.decode())
            ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def _ids(self, text: str) -> list[int]:
        if not text.isalpha() or max(text) > "\xff":
            return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        text = text.lower()  # one unit, in normal form
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(text)]


class WordTokenizer:
    """Ids of whole texts by remembered words, from a tokenizer that `by_words` accepts; from any other, text by text.

    Neither such a tokenizer's merges nor its added tokens cross white space and it lower-cases text, so a text's
    ids are those of its white-space-separated words one after the other. ASCII words share the ids of their lower
    form (unless they hold the opening of an added token, as those match case). In words of characters up to U+00FF,
    whose normal and lower forms are single characters of the same kind, final punctuation after a letter is a unit
    of its own, and letters alone are one; other words are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.ids = WordIds(self.tokenizer) if by_words(self.tokenizer) else None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self.ids is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        get = self.ids.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


_TOKENIZERS: dict[str, WordTokenizer] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: its document, place, length, checksum of ids, and class."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("k", pa.int32())])
    end = np.array([END_TOKEN], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENIZERS:
            _TOKENIZERS[tokenizer] = WordTokenizer(tokenizer)
        own = _TOKENIZERS[tokenizer]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                texts = [b"" if (v := x.as_buffer()) is None else bytes(v) for x in batch.column(1)]
                for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(texts), strict=True):
                    ids += end
                    n, start = len(ids) // 4, 0
                    for length in cut(n, capacity):
                        rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, capacity // length))
                        start += length
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, PIECES)


def first_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """Bin of each length, longest first; equal lengths in the order given."""
    bins: list[int] = []
    out = [0] * len(lengths)
    low = 0  # bins before this are full
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b in range(low, len(bins)) if bins[b] + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        bins[b] += lengths[i]
        out[i] = b
        while low < len(bins) and bins[low] == capacity:
            low += 1
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY, per_bucket: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to the rows of `pieces`.

    sequence_id is 4096 times the number of the sequence within its class plus the class; class 0 holds the
    sequences packed from what the classes leave.
    """
    parts = materialize(parts, "pieces")  # tokenised once
    buckets = max(1, parts.count() // per_bucket)
    parts = parts.withColumn("b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    totals = before(parts, ["k"], ["b"], F.lit(1), "base")
    order = W.partitionBy("k", "b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = parts.join(totals, ["k", "b"]).withColumn("i", F.col("base") + F.row_number().over(order) - 1)
    ranked = materialize(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "i"), "ranked")
    sizes = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # at most as many rows as the capacity
    ranked = ranked.join(F.broadcast(sizes), "k").withColumn("whole", F.col("i") < F.col("n") - F.col("n") % F.col("k"))
    full = ranked.where("whole").withColumns({"sequence_id": F.expr("4096 * (i div k) + k"), "slot": F.col("i")})

    def rest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "i"], ignore_index=True)
        return pdf.assign(sequence_id=[4096 * b for b in first_fit(pdf["length"].tolist(), capacity)], slot=pdf.index)

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "i"]
    left = ranked.where("not whole").select(*kept)
    # one group of fewer than 10,000 rows: fewer than k pieces of each class k, and one class per length below C/32
    left = left.groupBy((F.col("k") * 0).alias("g")).applyInPandas(rest, PIECES + ", i long, sequence_id long, slot long")
    both = full.select(*kept, "sequence_id", "slot").unionByName(left)
    w = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return both.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                       F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))
