"""Token counts and ids against the library, and the file format's round trip."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.idfile import Shard, read_shard, write_shard
from plumbline.llm.tokenfiles import exported, read_token_files, token_file_report, write_token_files
from plumbline.llm.tokens import Encoder, PieceModel, encoder, token_counts

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = ["", " ", "\n\n", "x<|endoftext|>y <|startoftext|>", "don't I'll 'S", "  a  b\n\n c ", "é é İİ ßẞ Σς", "日本語 text 🎉", "a\x85b\xa0c\x1cd\x1fe​f", "12³ ½x", "<|ENDOFTEXT|>", "a\n", "\t\tx  ", "ΑΣ ͯ x", "'s't're", "a" * 5000]


def counted(model, texts):
    """Token counts by way of pre-token frequencies."""
    return [fixed + sum(n * len(model.split(p)) for p, n in found.items()) for fixed, found in map(model.frequencies, texts)]


def coded(model, texts):
    ids, counts = model.code(texts)
    return [own.tolist() for own in np.split(ids, np.cumsum(counts)[:-1])]


def library(path):
    return Tokenizer.from_file(P.path(path))


@pytest.mark.parametrize("path", FILES)
def test_odd_texts(path):
    own, lib = Encoder(P.path(path)), library(path)
    want = [lib.encode(t, add_special_tokens=False).ids for t in ODD]
    assert counted(own, ODD) == [len(w) for w in want]
    assert coded(own, ODD) == want


@pytest.mark.parametrize("path", FILES)
def test_every_character_that_is_cut_here(path):
    own, lib = Encoder(P.path(path)), library(path)
    texts = [p.format(chr(c)) for c in range(0x370) for p in ("a{0}b", "a {0} b", "{0}{0}1", " {0}", "{0} ", "\n{0}x")]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert counted(own, texts) == [len(w) for w in want]
    assert coded(own, texts) == want


@pytest.mark.parametrize("path", FILES)
def test_every_script(path):
    """Every assigned character of the basic plane and some beyond it, in runs of neighbours and alone."""
    own, lib = Encoder(P.path(path)), library(path)
    chars = [chr(c) for c in [*range(0x370, 0xD800), *range(0xE000, 0x10000), *range(0x1F300, 0x1F700), *range(0x20000, 0x20100)]]
    texts = ["a" + "".join(chars[i : i + 16]) + " b " + " ".join(chars[i : i + 16]) + "\n1" for i in range(0, len(chars), 16)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert coded(own, texts) == want and counted(own, texts) == [len(w) for w in want]


def test_table_is_thinned(monkeypatch):
    import plumbline.llm.tokens as T

    monkeypatch.setattr(T, "TABLE_LIMIT", 5)
    own, lib = Encoder(P.path(FILES[0])), library(FILES[0])
    for t in ("one two three four", "five six seventeenhundred eight nine", "one two ten eleven twelve"):
        assert coded(own, [t]) == [lib.encode(t, add_special_tokens=False).ids] and len(own.bulk.table) <= 5


@pytest.mark.parametrize("path", FILES)
def test_random_texts(path):
    """Runs of spaces, quotes, digits and letters of one to three bytes in every order, short and long."""
    own, lib, rng = Encoder(P.path(path)), library(path), random.Random(3)
    for alphabet in ("a's ", "ab'stmdrevl  \n", " \t\n\r\xa0\u2003x1", "é“”—€aB'1² .", "the cat 's'T're'", "abcdefghijklmnopqrstuvwxyz.", "a\u0301e\u0300 '"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice((0, 1, 2, 5, 20, 90)))) for _ in range(300)]
        assert coded(own, texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", FILES)
def test_real_texts(path):
    own, lib = Encoder(P.path(path)), library(path)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert coded(own, texts) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_counts(spark, documents):
    rows = [(1, None), (2, ""), (3, "héllo wörld"), (3, "héllo wörld"), (4, "tok " * 3000)]
    out = token_counts(spark, documents(rows, extra=True), P.path(FILES[0])).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out[:2]] == [(0, 0, False)] * 2
    assert out[2] == out[3] and out[2]["n_bytes"] == 13 and out[4]["over_limit"]
    assert token_counts(spark, documents([]), P.path(FILES[0])).count() == 0
    pieces = PieceModel(P.path("piece_bpe_32k.model"))
    assert isinstance(encoder(P.path("piece_bpe_32k.model")), PieceModel)
    out = token_counts(spark, documents([(1, "a b"), (2, None)]), P.path("piece_bpe_32k.model")).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in out] == [len(pieces.library.encode("a b")), 0]


@pytest.mark.parametrize("held", [0, 700, 1 << 24])
def test_counts_whatever_is_broadcast(spark, documents, held):
    """All, some or none of the pre-tokens meet the documents by a shuffle."""
    lib = library(FILES[0])
    rows = [(i % 40, t) for i, t in enumerate([*ODD, *(" ".join(f"w{j % (i + 2)}’s 字x{i}" for j in range(i)) for i in range(60)), None, None])]
    rows.append((None, "no id, once"))
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts(spark, documents(rows), P.path(FILES[0]), broadcast_bytes=held).collect()))
    want = sorted((d is not None, d or 0, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in rows)
    assert got == want


@pytest.mark.parametrize(("n", "block"), [(0, 8), (1, 8192), (5, 2), (1000, 128), (30_000, 700), (30_000, 8192), (200_000, 1 << 20)])
def test_round_trip(n, block):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49_408, n), np.minimum(rng.zipf(1.3, n), 50) - 1, np.full(n, 7), np.arange(n) % 3):
        raw = write_shard(Shard(["5", None], np.array([n, 0]), ids), block)
        back = read_shard(raw)
        assert (back.ids == ids).all() and back.names == ["5", None] and back.lengths.tolist() == [n, 0]


def test_damage_is_noticed():
    whole = write_shard(Shard(["1"], np.array([5000]), np.random.default_rng(0).zipf(1.5, 5000) % 90), 1000)
    for place in (7, 40, 120, len(whole) // 2, len(whole) - 3):  # header, model and blocks
        raw = bytearray(whole)
        raw[place] ^= 64
        with pytest.raises(ValueError):
            read_shard(bytes(raw))
    with pytest.raises(ValueError):
        read_shard(whole[: len(whole) // 2])
    with pytest.raises(ValueError):
        read_shard(b"nothing")


def test_ids_are_coded_in_fewer_bits_than_their_frequencies_need():
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    ids, _ = Encoder(P.path(FILES[0])).code(docs)
    count = np.bincount(ids)
    share = count[count > 0] / len(ids)
    raw = write_shard(Shard(["x"], np.array([len(ids)]), ids))
    assert 8 * len(raw) / len(ids) < -(share * np.log2(share)).sum() - 1
    assert (read_shard(raw).ids == ids).all()


def test_predictable_ids_are_small():
    raw = write_shard(Shard(["1"], np.array([200_000]), np.tile(np.arange(100, 200), 2000)))
    assert len(raw) < 30_000  # 6.6 bits an id if order 0 alone were used: 166 000


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_files(spark, tmp_path, kind):
    rows = [(9, "last one"), (1, "first"), (4, None), (4, "b"), (4, "b"), (2, "z " * 2000), (None, "no id"), (None, "")]
    rows = [(r[0] if kind == "bigint" or r[0] is None else f"doc–{r[0]}", r[1]) for r in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("part", F.lit("clash")).withColumn("row", F.lit(0))
    out = token_file_report(spark, docs, P.path(FILES[0])).collect()
    lib = library(FILES[0])
    want = sorted((r[0] is not None, r[0] or 0, lib.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows)
    key = lambda d, n, crc: (d is not None, d or 0, n, crc)
    assert sorted(key(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == sorted(key(d if has else None, len(i), zlib.crc32(struct.pack(f"<{len(i)}I", *i))) for has, d, i in want)
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(out, key=lambda r: r["start"])]
    assert in_order == sorted(in_order)
    path = str(tmp_path / "ids")
    write_token_files(docs, path, P.path(FILES[0]), shard_ids=500)
    assert read_token_files(spark, path).count() == len(rows)
    assert sum(len(read_shard(b).names) for _, b in exported(spark, path)) == len(rows)
    assert token_file_report(spark, docs.limit(0), P.path(FILES[0])).count() == 0
