"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is the word, not the byte: an item's windows of ``window`` words are
the patterns, two neighbouring words are a block. A shift table over block hashes
tells how far the search may jump when a block ends no pattern; where the shift is
zero, the bucket of the block's hash names the patterns to try, and these are
compared word by word, byte by byte. Cursors in many stretches of text advance
together, so each step is a few numpy operations over all of them.

Items are searched in blocks of bounded size, one pass over the documents each
(the passes are chained in one stage, nothing is shuffled), so the benchmark may
be of any size while what is broadcast stays bounded.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, slices
from .words import Words, scan

WINDOW = 13
#: Bytes of item text searched for, and broadcast, at once.
BLOCK_BYTES = 8 << 20
_TABLE_BITS = 16
_STRETCH = 256  # words that one cursor searches
_LEFT, _RIGHT = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Patterns:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, length: int, hashes: np.ndarray, texts: list[tuple[bytes, ...]]) -> None:
        self.length, self.block, self.texts = length, min(2, length), texts
        self.hashes = hashes  # patterns x length
        reach = length - self.block
        self.shift = np.full(1 << _TABLE_BITS, reach + 1, dtype=np.int64)
        for at in range(reach + 1):
            slot = self.slot(hashes[:, at + self.block - 1], hashes[:, at])
            np.minimum.at(self.shift, slot, reach - at)
        last = self.slot(hashes[:, -1], hashes[:, -self.block])
        self.order = np.argsort(last, kind="stable")
        count = np.bincount(last, minlength=1 << _TABLE_BITS)
        self.bucket = np.concatenate(([0], np.cumsum(count)))

    def slot(self, right: np.ndarray, left: np.ndarray) -> np.ndarray:
        code = right * _RIGHT if self.block == 1 else left * _LEFT + right * _RIGHT
        return (mix64(code) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, words: Words, stream: np.ndarray, where: np.ndarray) -> list[tuple[int, int]]:
        """(index of the first word, pattern) of every occurrence. stream: word
        hashes with a 0 between texts; where: the word index of each entry."""
        n, m = len(stream), self.length
        begin = np.arange(0, n, _STRETCH)
        stop = np.minimum(begin + _STRETCH, n)
        pos = np.maximum(begin, m - 1)
        held = []
        live = pos < stop
        pos, stop = pos[live], stop[live]
        while len(pos):
            jump = self.shift[self.slot(stream[pos], stream[pos - self.block + 1])]
            held.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        ends = np.concatenate(held) if held else np.empty(0, np.int64)
        slot = self.slot(stream[ends], stream[ends - self.block + 1])
        many = self.bucket[slot + 1] - self.bucket[slot]
        ends, base = np.repeat(ends, many), np.repeat(self.bucket[slot], many)
        pattern = self.order[base + np.arange(len(base)) - np.repeat(np.cumsum(many) - many, many)] if len(base) else base
        for k in range(m):  # cheap comparison of hashes first
            same = stream[ends - m + 1 + k] == self.hashes[pattern, k]
            ends, pattern = ends[same], pattern[same]
        found = []
        for end, p in zip(ends.tolist(), pattern.tolist(), strict=True):
            first = int(where[end - m + 1])
            if all(words.word(first + k) == w for k, w in enumerate(self.texts[p])):
                found.append((first, p))
        return found


class Search:
    """A block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = scan([text])
            own = [words.word(i) for i in range(len(words.hash))]
            if own:
                for i in range(max(1, len(own) - window + 1)):
                    owners[tuple(own[i : i + window])].add(item)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in sorted(owners):
            by_length[len(pattern)].append(pattern)
        self.groups = []
        for length, patterns in sorted(by_length.items()):
            flat = scan([b" ".join(p) for p in patterns])
            self.groups.append((_Patterns(length, flat.hash.reshape(-1, length), patterns), [sorted(owners[p], key=str) for p in patterns]))

    def spans(self, words: Words) -> list[tuple[int, int, list[str]]]:
        """(first word, words, items) of every occurrence of a window."""
        n_docs = len(words.first) - 1
        stream = np.zeros(len(words.hash) + n_docs, dtype=np.uint64)
        at = np.arange(len(words.hash)) + words.doc
        stream[at] = words.hash
        where = np.zeros(len(stream), dtype=np.int64)
        where[at] = np.arange(len(words.hash))
        return [(first, g.length, owners[p]) for g, owners in self.groups for first, p in g.find(words, stream, where)]


_FOUND = T.StructType(
    [T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_words", T.LongType())]
)


_FOUND_ARROW = pa.struct([("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("n_words", pa.int64())])


def _search_udf(block, window: int) -> object:
    """A column function: (text, spans so far, items so far) -> found."""

    @F.arrow_udf(_FOUND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        search = Search(block.value, window)
        for text, before_spans, before_items in batches:
            rows = []
            held = pa.RecordBatch.from_arrays([text.cast(pa.large_binary()), before_spans, before_items], ["text", "spans", "items"])
            for part in slices(held, "text"):
                raw, spans, items = (c.to_pylist() for c in part.columns)
                words = scan(raw)
                names = [set(i) for i in items]
                for first, length, owners in search.spans(words):
                    doc = int(words.doc[first])
                    own = first - int(words.first[doc])
                    spans[doc] += [own, own + length]
                    names[doc].update(o for o in owners if o is not None)
                rows += [{"spans": _merged(s), "items": sorted(n), "n_words": c} for s, n, c in zip(spans, names, np.diff(words.first).tolist(), strict=True)]
            yield pa.array(rows, _FOUND_ARROW)

    return found


def _merged(flat: list[int]) -> list[int]:
    """Overlapping word ranges made one, as a flat list of starts and ends."""
    out: list[int] = []
    for a, b in sorted(zip(flat[0::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of at most ``block_bytes`` (a longer item alone)."""
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        raw = text.encode("utf-8", "surrogatepass")
        if block and size + len(raw) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, raw))
        size += len(raw)
    if block:
        yield block


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, into: str = "contamination") -> DataFrame:
    """``docs`` with a column ``into``: struct of spans (word ranges that
    occur in items, as starts and ends), items (ids found) and n_words.

    Null texts have no words; empty tables give no rows or no findings; repeated
    document rows are judged each alone; repeated items count once by id; an item
    without an id is searched for, but has no name among those found; items without
    a word are never found. Columns of ``docs`` pass through untouched
    (one named like the result is replaced).
    """
    empty = F.struct(F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(None).cast("bigint").alias("n_words"))
    out = docs.withColumn(into, empty)
    blocks = item_blocks(benchmark, block_bytes=block_bytes)
    for block in itertools.chain([next(blocks, [])], blocks):  # at least one pass, which counts the words
        shared = spark.sparkContext.broadcast(block)  # bounded by block_bytes
        out = out.withColumn(into, _search_udf(shared, window)(F.col(text_col), F.col(f"{into}.spans"), F.col(f"{into}.items")))
    return out


def hit_words(found: str = "contamination") -> Column:
    """Words of a document inside the ranges found."""
    return F.aggregate(F.transform(f"{found}.spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, b: a + b)


def decontamination_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; repeated rows are judged each
    alone; items with a null id make hits and aren't counted; an empty benchmark finds
    nothing; columns other than doc_id and text aren't looked at.
    """
    found = contamination(spark, docs.select("doc_id", "text"), benchmark)
    out = found.select(
        "doc_id",
        F.col("contamination.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size("contamination.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged.

    Null and empty texts have no words and stay; repeated rows are judged each
    alone; an empty benchmark keeps all; an empty table gives no rows; a column may
    have any name.
    """
    name = "contamination"
    while name in docs.columns:
        name += "_"
    found = contamination(spark, docs, benchmark, into=name)
    hit = hit_words(name)
    bad = (hit > 0) & (20 * hit >= F.col(f"{name}.n_words"))
    return found.where(~bad).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    """What items_sha256 holds for these ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
