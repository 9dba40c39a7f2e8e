"""Exact token counts and ids through tables of distinct pre-tokens.

A tokenizer of this kind first cuts a text into pre-tokens and then splits each
one by itself, so what a pre-token becomes needs to be worked out once.

``token_counts`` does so as a join. A first pass takes every distinct pre-token
of the corpus with its frequency; each is counted once. In a second pass the
pre-token frequencies of a document meet that table: the most frequent
pre-tokens, as many as fit a stated number of bytes, are broadcast and joined on
the spot, the others by a shuffle. No ids are built.

``Encoder.code`` is for those who need the ids: many texts are cut at once (bulk.py),
and each worker keeps a bounded table of the pre-tokens that it has met.

Texts of common characters (bulk.PLAIN, once normalised) are cut here, by rules that
have been checked character by character against the library (tests); any other
text is cut by the library's own pre-tokenizer.
Special strings in a text are what the library makes of them: one token each.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bulk import PLAIN, Coder
from .common import slices, written

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Distinct pre-tokens kept by a worker (about 50 bytes each, plus those of texts that aren't plain); beyond it the table starts over.
TABLE_LIMIT = 2_000_000
#: Bytes of pre-tokens that are broadcast, a fixed cost for each included.
BROADCAST_BYTES = 16 << 20
_ENTRY_BYTES = 48
#: Distinct pre-tokens that a task gathers before it passes them on.
GATHERED = 500_000
OVER_LIMIT = 2048

_PLAIN = re.compile(r"[\x00-\u036f]*")
_SPACES = r"\t\n\x0b\f\r \x85\xa0"  # white space below U+0370, as the library sees it


def _of_kind(kind: str, below: int = 0x370) -> str:
    """The characters below U+0370 of a general category, for a character class."""
    return "".join(re.escape(c) for c in map(chr, range(below)) if unicodedata.category(c)[0] == kind)


def _patterns(below: int) -> tuple[str, str]:
    """The cutting patterns of the two makes of tokenizer file, classes spelt out."""
    letter, digit = _of_kind("L", below), _of_kind("N", below)
    # Alternatives of the files' patterns.
    word = rf"[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digit}]|[^{_SPACES}{letter}{digit}]+"
    byte = rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digit}]+| ?[^{_SPACES}{letter}{digit}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
    return word, byte


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself
    if it is printable, else the next one from U+0100 on."""
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_SPELT = dict(enumerate(_byte_characters()))


class Encoder:
    """A tokenizers file with a table of the pre-tokens met so far."""

    def __init__(self, path: str, limit: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.limit = limit or TABLE_LIMIT
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.lower = spec["model"].get("end_of_word_suffix") == "</w>" and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        own_bytes = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": spec["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        self.known = plain and spec["model"]["type"] == "BPE" and (self.lower or own_bytes)
        make = 0 if self.lower else 1
        self._cut, self._cut_ascii = (re.compile(_patterns(below)[make]).findall for below in (0x370, 0x80))
        self._split = self.library.model.tokenize
        self.ids: dict[str, list[int]] = {}
        self.bulk = Coder(self.lower, self.split, self.limit)

    def normal(self, text: str) -> str:
        """The text as it is cut."""
        if not self.lower:
            return text
        if text.isascii():
            return text.lower()
        plain = unicodedata.normalize("NFC", text).lower()
        return plain if _PLAIN.fullmatch(plain) else self.library.normalizer.normalize_str(text)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a normalised text without special strings."""
        if text.isascii():
            return self._cut_ascii(text)
        if _PLAIN.fullmatch(text):
            return self._cut(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        return self.cut(self.normal(text))

    def parts(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as parts of their own."""
        return [text] if self._special is None or "<|" not in text else [p for p in self._special.split(text) if p]

    def split(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        spelt = piece if piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(_SPELT)
        return [t.id for t in self._split(spelt)]

    def frequencies(self, text: str | None) -> tuple[int, Counter]:
        """The special strings of a text, counted, and the frequencies of its pre-tokens."""
        fixed, found = 0, Counter()
        for part in self.parts(text or ""):
            if part in self.special:
                fixed += 1
            else:
                found.update(self.pieces(part))
        return fixed, found

    def whole(self, text: str | None) -> list[int]:
        """The ids as the library gives them, for files of another make."""
        return self.library.encode(text or "", add_special_tokens=False).ids

    def code(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each."""
        plain: list[bytes] = []
        odd: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            text = text or ""
            own = self.normal(text) if self.known else text
            if self.known and (own.isascii() or PLAIN.fullmatch(own)) and not ("<|" in text and self._special and self._special.search(text)):
                plain.append(own.encode())
            else:
                odd[i] = self._coded(text)
        ids, counts = self.bulk.code(plain) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
        if not odd:
            return ids, counts
        runs, all_counts, at, done = [], np.empty(len(texts), dtype=np.int64), 0, 0
        for i in range(len(texts)):
            own = np.array(odd[i], dtype=np.uint32) if i in odd else ids[at : at + counts[done]]
            if i not in odd:
                at, done = at + len(own), done + 1
            runs.append(own)
            all_counts[i] = len(own)
        return np.concatenate(runs), all_counts

    def _coded(self, text: str) -> list[int]:
        """The ids of one text, whatever its characters."""
        if not self.known:
            return self.whole(text)
        out: list[int] = []
        for part in self.parts(text):
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.pieces(part):
                own = self.ids.get(piece)
                if own is None:
                    if len(self.ids) >= self.limit // 8:
                        self.ids.clear()
                    own = self.ids[piece] = self.split(piece)
                out += own
        return out


class PieceModel:
    """A sentencepiece file; it has no pre-tokens to share, texts are encoded whole."""

    known = False

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def whole(self, text: str | None) -> list[int]:
        return self.library.encode(text or "", num_threads=1)

    def code(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        each = [self.whole(t) for t in texts]
        return np.array([i for own in each for i in own], dtype=np.uint32), np.array([len(own) for own in each], dtype=np.int64)


@lru_cache(maxsize=2)
def encoder(path: str, limit: int | None = None) -> Encoder | PieceModel:
    """One per worker and file; ``limit``: pre-tokens kept."""
    return PieceModel(path) if path.endswith(".model") else Encoder(path, limit)


def _whole_counts(text: Column, tokenizer: str) -> Column:
    """The number of tokens of texts that have no pre-tokens to share."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = encoder(tokenizer)
        for batch in batches:
            yield pa.array([len(model.whole(t.as_py())) for t in batch], pa.int64())

    return counted(text)


def distinct_pieces(docs: DataFrame, tokenizer: str, gathered: int = GATHERED) -> DataFrame:
    """(piece, freq, tokens): every distinct pre-token of all texts, its frequency and its number of tokens."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, found = encoder(tokenizer), Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["piece", "freq"])

        for batch in batches:
            for text in batch.column("text"):
                for part in model.parts(text.as_py() or ""):
                    if part not in model.special:
                        found.update(model.pieces(part))
                if len(found) > gathered:
                    yield passed()
                    found.clear()
        yield passed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer)
        for batch in batches:
            tokens = pa.array([len(model.split(p)) for p in batch.column("piece").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("freq"), tokens], names=["piece", "freq", "tokens"])

    once = docs.select("text").mapInArrow(gather, "piece string, freq bigint").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return once.mapInArrow(count, "piece string, freq bigint, tokens bigint")


def _frequent(pieces: DataFrame, limit: int) -> tuple[dict[str, int], bool]:
    """The most frequent pre-tokens that fit ``limit`` bytes, and whether they are all."""
    level = F.floor(F.log2("freq") * 4).cast("int")
    size = F.octet_length("piece") + F.lit(_ENTRY_BYTES)
    levels = pieces.groupBy(level.alias("level")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("level")).collect()  # at most 256 rows
    least, held = None, 0
    for row in levels:
        held += row["bytes"]
        if held > limit:
            break
        least = row["level"]
    if least is None:
        return {}, not levels
    kept = pieces.where(level >= least).select("piece", "tokens").toArrow()
    return dict(zip(kept.column("piece").to_pylist(), kept.column("tokens").to_pylist(), strict=True)), held <= limit


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer: str, limit: int = OVER_LIMIT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit).

    tokenizer: a path, the same on every executor (public_tokenizers.path(...)).
    A null or empty text has no bytes and no tokens; repeated rows and tied ids
    are counted each alone; an empty table gives no rows; other columns, whatever
    they are called, are left out. A sentencepiece file, or a tokenizers file of
    an unknown make, has no pre-tokens to share: its texts are encoded whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    if not encoder(tokenizer).known:
        out = docs.select("doc_id", "n_bytes", _whole_counts(F.col("text"), tokenizer).alias("n_tokens"))
        return out.withColumn("over_limit", F.col("n_tokens") > limit)
    pieces = written(spark, distinct_pieces(docs, tokenizer), "pieces")
    table, complete = _frequent(pieces, broadcast_bytes)
    frequent = spark.sparkContext.broadcast(table)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = encoder(tokenizer), frequent.value
        for batch in batches:
            for part in slices(batch, "text"):
                totals, rest = [], []
                for t in part.column("text").to_pylist():
                    total, found = model.frequencies(t)
                    try:
                        total += sum(map(int.__mul__, found.values(), map(tokens.__getitem__, found)))
                        rest.append([])
                    except KeyError:
                        total += sum(n * tokens[p] for p, n in found.items() if p in tokens)
                        rest.append([{"piece": p, "n": n} for p, n in found.items() if p not in tokens])
                    totals.append(total)
                kind = pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(totals, pa.int64()), pa.array(rest, kind)],
                    names=["doc_id", "n_bytes", "n_tokens", "rest"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.mapInArrow(join, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, rest array<struct<piece:string,n:bigint>>")
    if complete:
        out = joined.drop("rest")
    else:
        joined = written(spark, joined.withColumn("row", F.monotonically_increasing_id()), "joined")
        out = joined.where(F.size("rest") == 0).select("doc_id", "n_bytes", "n_tokens")
        rest = joined.where(F.size("rest") > 0).withColumn("rest", F.explode("rest"))
        rest = rest.select("row", "doc_id", "n_bytes", "n_tokens", "rest.piece", "rest.n").join(pieces.select("piece", "tokens"), "piece")
        rest = rest.groupBy("row", "doc_id", "n_bytes", "n_tokens").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
        out = out.unionByName(rest.select("doc_id", "n_bytes", (F.col("n_tokens") + F.col("more")).alias("n_tokens")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
