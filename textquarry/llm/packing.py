"""Packing token sequences into windows by best-fit decreasing.

Overlong documents are first cut into full windows. What is left has at most ``window`` different lengths, and pieces of
one length are interchangeable, so best-fit decreasing works on the histogram of lengths: a segment tree indexed by
remaining capacity finds the tightest open windows, and a whole run of equal pieces goes into a run of equal windows at
once. The plan has a row for each such run; its size depends on ``window`` alone, not on the rows, which makes it fit to
broadcast. Each piece then looks up its place by its length and its rank among the pieces of that length. Ranks come
from counts of hashed slices of each length, so that a length that a third of all pieces share is not ranked in one task.

Cases: null text is empty, and an empty document still has its closing id; repeated rows are packed each; the order of
equal rows does not matter, they are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, per_value, salted, table

#: The split of byte-level vocabularies (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BREAK = re.compile("(?<=[a-zA-Z]) (?=[a-zA-Z])")
#: Code points of a text that are encoded at once.
PART = 1 << 20


def _byte_letters() -> dict[str, int]:
    """The byte of each printable stand-in in a byte-level vocabulary: itself where printable, else the next free code point from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts under a byte-level BPE file (JSON), as little-endian unsigned 32-bit numbers.

    Where the file is a plain byte-level BPE whose ids rise in the order of its merges, they rank the merges, and a second
    library encodes by ranks, several times as fast with the same ids. Any other file, and a text that holds the string
    of a special token, goes through the file's own library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ranked = self._ranked(spec)

    def _ranked(self, spec: dict):
        import tiktoken

        model, split, letters = spec["model"], spec["pre_tokenizer"], _byte_letters()
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or not split or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split.get("use_regex", True):
            return None
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        single = {i for t, i in vocab.items() if len(t) == 1}
        if None in merged or any(b <= a for a, b in itertools.pairwise(merged)) or single | set(merged) != set(vocab.values()) or len(single) != 256 or max(single) > merged[0]:
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _in_parts(self, text: str) -> Iterator[str]:
        """The text, cut before blanks between letters, where the tokenizer splits whatever else the text holds."""
        at = 0
        while len(text) - at > PART:
            m = _BREAK.search(text, at + PART)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranked is None or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(array("I", self.ranked.encode_ordinary(part)).tobytes() for part in self._in_parts(text))


_loaded: dict[str, Encoder] = {}


def token_pieces(df: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of each document: key, start, length, ids_crc32, doc_tokens. The closing id counts."""
    made = {"start": "long", "length": "int", "ids_crc32": "long", "doc_tokens": "long"}

    def start():
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Encoder(tokenizer)
        encoder, end = _loaded[tokenizer], array("I", [end_id]).tobytes()

        def one(t: str | None) -> list[tuple]:
            ids = encoder.encode(t) + end
            n = len(ids) >> 2
            return [(s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]

        return one

    return per_value(df.select(key, text), text, made, start, many=True)


class _Tightest:
    """A segment tree over remaining capacities: which is the smallest of at least so much that an open window has?"""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += n
            at >>= 1

    def find(self, least: int) -> int | None:
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:  # up, until a right neighbour has an open window, and down to its smallest
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on {length: pieces}. Rows: length, first rank, rank after the last, window of the first, offset."""
    tree, runs, plan, made = _Tightest(window), {}, [], 0
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while at < n:
            capacity = tree.find(length)
            if capacity is None:
                capacity = window
                q = (n - at) // (window // length) or 1
                first, made = made, made + q
            else:
                first, have = runs[capacity].pop()
                q = min(have, (n - at) // (capacity // length)) or 1
                if q < have:
                    runs[capacity].append((first + q, have - q))
                tree.add(capacity, -q)
            each = min(capacity // length, n - at)  # a window that takes a piece is the tightest for the next one too
            for _ in range(each):
                plan.append((length, at, at + q, first, window - capacity))
                at, capacity = at + q, capacity - length
            runs.setdefault(capacity, []).append((first, q))
            tree.add(capacity, q)
    return plan


def pack(pieces: DataFrame, window: int = 1024, slice_rows: int = 50_000) -> DataFrame:
    """pieces (read more than once: materialise them) with sequence_id and offset: their place in the packed sequences."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most window rows
    plan = spark.createDataFrame(best_fit_plan(counts, window), "p_length int, p_from long, p_to long, p_window long, p_offset int")
    cols = pieces.columns
    slices = max(16, sum(counts.values()) // slice_rows)
    sliced = pieces.withColumn("_slice", salted(slices, *cols))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")).select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*cols)) - 1
    ranked = sliced.withColumn("_rank", rank).join(base, ["length", "_slice"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
    return placed.select(*cols, (F.col("p_window") + F.col("_rank") - F.col("p_from")).alias("sequence_id"), F.col("p_offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024) -> DataFrame:
    return pack(materialise(token_pieces(docs, tokenizer, window)), window).withColumn("length", F.col("length").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
