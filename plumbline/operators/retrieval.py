"""Lexical, vector and hybrid retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .ranking import DEPTH, fused, ranked

K1, B = 1.2, 0.75
# Weights of the fields of elements and of chunks.
ELEMENT_FIELDS = {"name": 3.0, "semantic_label": 2.0, "object_type": 1.5, "description": 1.0, "site": 1.0, "building": 1.0, "storey": 1.0, "space": 1.0}
TIE_BREAKER, MATERIAL_BOOST = 0.3, 1.5
CHUNK_FIELDS = {"text": 1.0, "section_title": 0.5, "section_path": 0.25}


def analysed(text: Column) -> Column:
    """The terms of a text: lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Terms that are counted at once.
TERMS = 1 << 20


def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (``columns`` and terms) with a row for each distinct term: columns, term, tf, dl.

    Each row is counted where it lies, by Arrow: nothing is shuffled. Rows without a term are left out.
    """
    kept = rows.select(*columns, "terms").where(F.size("terms") > 0)
    fields = [(f.name, f.dataType) for f in kept.schema if f.name in columns]
    out = T.StructType([*(T.StructField(n, t) for n, t in fields), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("dl", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dl = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(dl):  # about TERMS terms at once
                n = max(1, int(np.searchsorted(np.cumsum(dl[at:]), TERMS, "right")))
                part, own = batch.slice(at, n), dl[at : at + n]
                coded = part.column("terms").flatten().dictionary_encode()
                words = max(1, len(coded.dictionary))
                pairs, tf = np.unique(np.repeat(np.arange(n), own) * words + coded.indices.to_numpy(), return_counts=True)
                row = pa.array(pairs // words)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(row) for c, _ in fields), coded.dictionary.take(pa.array(pairs % words)).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(own[pairs // words], pa.int32())], names=out.names
                )
                at += n

    return kept.mapInArrow(run, out)


def postings(df: DataFrame, key: str, field: str, terms: Column) -> DataFrame:
    """(id, field, term, tf, dl) of one field, a row of ``df`` being a document; write it to keep an index."""
    one = df.select(F.col(key).alias("id"), F.lit(field).alias("field"), terms.alias("terms"))
    return counted(one, ["id", "field"]).select("id", "term", "tf", "dl", "field")


def bm25(index: DataFrame, queries: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Score of each (query, id, field) with a matching term.

    index: postings; queries: (query_id, term); n_docs: (field, n, avg_dl). Only
    the postings of asked terms are read on; whether the asked side is broadcast is
    left to its measured size. The postings of a document lie together, as ``postings``
    leaves them, so they are added up before anything is shuffled.
    """
    asked = queries.select("query_id", "term").distinct()
    hit = index.join(asked.select("term").distinct(), "term")
    df_ = hit.groupBy("field", "term").agg(F.count("*").alias("df"))
    stats = df_.join(F.broadcast(n_docs), "field").withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    scored = hit.join(stats, ["field", "term"]).withColumn("s", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl"))))
    return scored.join(asked, "term").groupBy("query_id", "id", "field").agg(F.sum("s").alias("score"))


def field_stats(index: DataFrame) -> DataFrame:
    """Documents and mean length of each field."""
    one = index.groupBy("field", "id").agg(F.first("dl").alias("dl"))
    return one.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))


def best_fields(scores: DataFrame, weights: dict[str, float], tie: float = TIE_BREAKER) -> DataFrame:
    """The best weighted field and ``tie`` times the others, per (query, id)."""
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(w))])
    w = scores.withColumn("w", F.col("score") * weight[F.col("field")]).where("w IS NOT NULL")
    return w.groupBy("query_id", "id").agg((F.max("w") + tie * (F.sum("w") - F.max("w"))).alias("score"))


def summed_fields(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """All weighted fields added up, per (query, id)."""
    return best_fields(scores, weights, tie=1.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Of a pass: bytes of query vectors, which go to all tasks, and ranks that a task holds. Of a
#: step: cosines, and candidates.
QUERY_BYTES, HELD, CELLS, STRETCH = 32 << 20, 1 << 22, 1 << 21, 2048


def dense(vectors: DataFrame, queries: DataFrame, where: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """Exact search: candidates (id, vector) filtered first, then cosine with every
    query (query_id, vector), then the best ``depth`` of each query: query_id, id, score, rank.

    Queries go to the tasks in blocks of ``QUERY_BYTES`` and ``HELD`` ranks, each a pass over the
    candidates; a task hands on its own best of each query and nothing else, holds them as
    arrays, and computes ``CELLS`` cosines at once. Ties go by id; null, zero and not finite
    vectors, and those of another length than the query, have no cosine.
    """
    pool = (vectors if where is None else vectors.where(where)).select("id", F.col("vector").cast("array<double>").alias("vector"))
    query_type, id_type = queries.schema["query_id"].dataType.simpleString(), pool.schema["id"].dataType.simpleString()
    schema = f"query_id {query_type}, id {id_type}, score double"
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    size, n = asked.agg(F.coalesce(F.sum(8 * F.size("vector") + 64), F.lit(0)), F.count("*")).first()
    blocks, best = max(1, -(-size // QUERY_BYTES), -(-n * depth // HELD)), None
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect() if size else []
        part = pool.mapInArrow(_nearest(block, depth, pool.sparkSession.createDataFrame([], schema)), schema)
        best = part if best is None else best.unionByName(part)
    return ranked(best, ["query_id"], depth=depth)


def _unit(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows as unit vectors, and which of them have a direction."""
    v = np.array(rows, dtype=np.float64)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares stay finite
        v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    return v, np.isfinite(v).all(axis=1)


def _nearest(queries: list, depth: int, empty: DataFrame):
    by_size: dict[int, list] = {}
    for q in queries:
        if len(q["vector"]) and None not in q["vector"]:
            by_size.setdefault(len(q["vector"]), []).append(q)
    asked = []
    for size, rows in by_size.items():
        unit, good = _unit([r["vector"] for r in rows])
        asked.append((size, [r["query_id"] for r, g in zip(rows, good, strict=True) if g], unit[good]))
    types = [pa.field(f.name, to_arrow_type(f.dataType)) for f in empty.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Best(len(names), depth, types[1].type) for _, names, _ in asked]
        for batch in batches:
            vectors = batch.column(1)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for best, (size, names, q) in zip(held, asked, strict=True):
                own = np.flatnonzero(lengths == size)
                if not names:
                    continue
                for at in range(0, len(own), STRETCH):
                    some = own[at : at + STRETCH]
                    x = vectors.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), size)  # nulls are not finite
                    v, good = _unit(x)
                    v, some = v[good], some[good]
                    best.name(batch.column(0).take(pa.array(some)))
                    step = max(1, CELLS // max(1, len(some)))
                    for k in range(0, len(q), step):
                        best.add(k, np.einsum("ij,kj->ki", v, q[k : k + step]))  # every pair is added up in the same order
        for best, (_, names, _) in zip(held, asked, strict=True):
            for own, ids, scores in best.rows():
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in own], types[0].type), ids, pa.array(scores)], schema=pa.schema(types))

    return run


class Best:
    """The first ``depth`` by score, then id, of each of n queries, as arrays; a missing id
    comes first, as in an ascending sort. What is taken in is named a stretch at a time."""

    def __init__(self, n: int, depth: int, id_type: pa.DataType) -> None:
        self.depth, self.scores, self.at = depth, np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)
        self.ids, self.new = pa.array([], id_type), 0

    def name(self, ids: pa.Array) -> None:
        """The ids of the next stretch. They and those held are numbered in their order."""
        used, back = np.unique(self.at, return_inverse=True)
        kept = self.ids.take(pa.array(used)) if len(self.ids) else self.ids
        every = pa.concat_arrays([kept, ids])
        order = pc.sort_indices(pa.table({"id": every}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
        place = np.empty(len(every), np.int64)
        place[order] = np.arange(len(every))
        self.ids = every.take(pa.array(order))
        if len(kept):
            self.at = place[back.reshape(self.at.shape)]
        self.own = place[len(kept) :]
        width = min(self.depth, self.scores.shape[1] + len(ids))
        grown = width - self.scores.shape[1]
        if grown > 0:
            self.scores = np.pad(self.scores, ((0, 0), (0, grown)), constant_values=-np.inf)
            self.at = np.pad(self.at, ((0, 0), (0, grown)))

    def add(self, first: int, scores: np.ndarray) -> None:
        """Scores of the named stretch for queries from ``first`` on: a line for each."""
        for k, line in enumerate(scores, first):
            some = np.flatnonzero(line >= self.least(k))
            self.take(k, some, line[some])

    def least(self, k: int) -> float:
        """What a score must reach to be among the best of query k."""
        return self.scores[k].min() if self.scores.shape[1] else np.inf

    def take(self, k: int, some: np.ndarray, own: np.ndarray) -> None:
        """Scores ``own`` of ``some`` of the named stretch for query k."""
        if len(some) > self.depth:
            best = own >= np.partition(own, len(own) - self.depth)[len(own) - self.depth]
            some, own = some[best], own[best]
        if len(some):
            s, at = np.concatenate([self.scores[k], own]), np.concatenate([self.at[k], self.own[some]])
            order = np.lexsort((at, -s))[: self.scores.shape[1]]
            self.scores[k], self.at[k] = s[order], at[order]

    def rows(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(query, ids, scores) of what is held, some queries at a time."""
        for k in range(0, len(self.scores), 1000):
            own, at = np.nonzero(self.scores[k : k + 1000] > -np.inf)
            if len(own):
                yield own + k, self.ids.take(pa.array(self.at[k : k + 1000][own, at])), self.scores[k : k + 1000][own, at]


def engine_score(score: Column) -> Column:
    """Cosine mapped to [0, 1] as vector stores report it."""
    return (1 + score) / 2


def hybrid(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Fusion of two ranked sources; either may be empty, neither may be missing."""
    if lexical is None or vector is None:
        raise ValueError("a source failed")
    return fused(lexical, vector, ["query_id"])


def checked_vector(values: list[float], dim: int = 1024) -> list[float]:
    """A query vector: exactly ``dim`` finite numbers."""
    if len(values) != dim or any(isinstance(v, bool) or not math.isfinite(v) for v in values):
        raise ValueError(f"a query vector has {dim} finite components")
    return values


def preflight(properties: dict, expected: dict) -> None:
    """Refuse to search an index made for another space, projection or record type."""
    wrong = {k: (properties.get(k), v) for k, v in expected.items() if properties.get(k) != v}
    if wrong:
        raise ValueError(f"index does not fit: {wrong}")


def embedded(df: DataFrame, text: str, embed, dim: int) -> DataFrame:
    """Vectors of a text column by an injected function of list[str], in batches;
    wrong length, not finite or not of unit norm is an error."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                vectors = embed(part.column(text).to_pylist())
                for v in vectors:
                    checked_vector(v, dim)
                    if abs(math.sqrt(sum(x * x for x in v)) - 1) > 1e-3:
                        raise ValueError("a vector is not of unit norm")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", vector array<float>"
    return df.mapInArrow(run, schema)
