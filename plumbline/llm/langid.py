"""Language identification by averaged hashed subword embeddings.

Subwords are the byte 3-grams and 4-grams of the lower-cased text, where every
run of non-letters is one boundary byte. Each is hashed to a row of an embedding
matrix, a text is the mean of its rows, and a linear layer with softmax gives the
languages. Embeddings and layer are trained by stochastic gradient descent in
numpy on a bounded sample of labelled texts (documented parameter, per language);
a part of the sample is kept out of training and fits a temperature, which
calibrates the scores, and the score below which a prediction is rejected.

Prediction is one pass over the documents. Where there are few languages the
product of embeddings and layer is formed first and its rows are averaged: both
are linear, so the logits are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, slices

BUCKETS = 1 << 15
DIMENSIONS = 16
#: Labelled texts of each language that are learned from, and of all languages, about.
SAMPLE_PER_LANGUAGE = 1500
SAMPLE = 60_000
#: Share of correctly predicted calibration texts that rejection may cost.
REJECT_SHARE = 0.002
UNKNOWN = "und"

_LETTER = np.full(256, 32, dtype=np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def subwords(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each subword length: the bucket of each subword, and the index of its text."""
    raw = [b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b"  " for t in texts]
    data = _LETTER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    keep = np.ones(len(data), dtype=bool)  # a run of boundaries becomes one
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[keep].astype(np.uint32), doc[keep]
    found = []
    code = data[:-1] | data[1:] << np.uint32(8)
    for n, salt in zip((3, 4), _SALTS, strict=True):
        m = max(0, len(data) - n + 1)
        code = code[:m] | data[n - 1 :][:m] << np.uint32(8 * (n - 1))
        inside = doc[:m] == doc[n - 1 :][:m]
        found.append((((code * salt) >> np.uint32(17))[inside].astype(np.int64), doc[:m][inside]))
    return found


@dataclass
class Model:
    """A trained identifier. Its size hardly grows with the number of languages."""

    languages: list[str]
    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score of each text; `und` and 0 without a letter."""
        letters = np.array([any(map(str.isalpha, t)) if t else False for t in texts], dtype=bool)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        count = np.zeros(len(texts))
        few = len(self.languages) <= DIMENSIONS  # their product first: as exact, fewer numbers
        table = self.embeddings @ self.layer if few else self.embeddings
        total = np.zeros((len(texts), table.shape[1]))
        for bucket, doc in subwords(texts):
            if len(bucket):
                first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                total[doc[first]] += np.add.reduceat(table[bucket], first, axis=0, dtype=np.float64)
                count += np.bincount(doc, minlength=len(texts))
        mean = total / np.maximum(count, 1)[:, None]
        logits = ((mean if few else mean @ self.layer) + self.bias) / self.temperature
        p = _softmax(logits)
        best = p.argmax(axis=1)
        score = np.where(letters, p[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's subwords and the share of each."""
    bucket, n = np.unique(np.concatenate([b for b, _ in subwords([text])]), return_counts=True)
    return bucket.astype(np.uint16), (n / max(1, n.sum())).astype(np.float32)


def train(rows: list[np.ndarray], counts: list[np.ndarray], labels: list[str], *, epochs: int = 6, rate: float = 2.0, batch: int = 32, seed: int = 7, reject_share: float = REJECT_SHARE) -> Model:
    """Fit on texts given as their features; every fifth is kept for calibration."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    index = {lang: i for i, lang in enumerate(languages)}
    target = np.array([index[x] for x in labels])
    held = np.arange(len(rows)) % 5 == 4
    if held.all() or not held.any():
        held[:] = False
    emb = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    layer[: min(layer.shape), : min(layer.shape)] = np.eye(min(layer.shape))
    bias = np.zeros(len(languages), dtype=np.float32)
    learn = np.flatnonzero(~held)
    steps = max(1, epochs * ((len(learn) + batch - 1) // batch))
    step = 0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(learn), max(1, (len(learn) + batch - 1) // batch)):
            mean = np.stack([counts[i] @ emb[rows[i]] for i in some])
            p = _softmax(mean @ layer + bias)
            p[np.arange(len(some)), target[some]] -= 1
            lr = rate * (1 - step / steps)
            back = p @ layer.T
            layer -= lr * (mean.T @ p) / len(some)
            bias -= lr * 0.1 * p.mean(axis=0)
            for g, i in zip(back, some, strict=True):
                emb[rows[i]] -= (lr * 40) * np.outer(counts[i], g)
            step += 1
    model = Model(languages, emb, layer, bias.astype(np.float64), 1.0, 0.0)
    judge = np.flatnonzero(held) if held.any() else learn
    logits = np.stack([counts[i] @ emb[rows[i]] @ layer + model.bias for i in judge])
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    wanted = np.full(logits.shape, 0.001 / len(languages))  # smoothed, or separable samples would ask for scores of 1
    wanted[np.arange(len(judge)), target[judge]] += 0.999
    loss = [-(wanted * np.log(_softmax(logits / t) + 1e-12)).sum(axis=1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(logits / model.temperature)
    right = p.argmax(axis=1) == target[judge]
    if right.any():
        model.reject_below = float(min(0.5, np.quantile(p.max(axis=1)[right], reject_share)))
    return model


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [features(t) for t in part.column("text").to_pylist()]
            rows, counts = (pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([rows, counts, part.column("lang"), part.column("key")], names=["rows", "counts", "lang", "key"])


def fit(spark: SparkSession, docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the documents not held out.

    Every language that occurs is learned. The texts to learn from are picked by a
    hash, about ``per_language`` of each language and ``sample`` in all, copies once;
    what reaches the driver are their features, of bounded size for texts of any length.
    """
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    have = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not have:
        return train([], [], [])
    unit = 1 << 30
    each = max(1, min(per_language, sample // len(have)))
    share = F.create_map(*[x for lang, n in sorted(have.items()) for x in (F.lit(lang), F.lit(min(unit, unit * each // n)))])
    key = F.xxhash64("text", "lang")
    picked = usable.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(unit)) < share[F.col("lang")]).select("text", "lang", key.alias("key"))
    once = picked.groupBy("key", "lang").agg(F.min("text").alias("text"))
    found = once.mapInArrow(_features, "rows binary, counts binary, lang string, key bigint").toArrow()
    order = np.argsort(found.column("key").to_numpy(), kind="stable")[np.random.default_rng(1).permutation(found.num_rows)].tolist()
    lang = found.column("lang").to_pylist()
    # Read where they lie: no copies of all features besides those that are trained on.
    at = {c: found.column(c).combine_chunks() for c in ("rows", "counts")}
    rows = [np.frombuffer(at["rows"][i].as_buffer(), dtype=np.uint16).astype(np.int32) for i in order]
    counts = [np.frombuffer(at["counts"][i].as_buffer(), dtype=np.float32) for i in order]
    return train(rows, counts, [lang[i] for i in order])


_PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct(lang_pred, score, rejected) of a text column."""
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages doubles

    @F.arrow_udf(_PREDICTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = [np.empty(0)]
            for part in slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                lang, score = own.predict(part.column(0).to_pylist())
                langs += lang
                scores.append(score)
            lang, score = pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())
            rejected = pc.or_(pc.equal(lang, UNKNOWN), pc.less(score, own.reject_below))
            yield pa.StructArray.from_arrays([lang, score, rejected], names=["lang_pred", "score", "rejected"])
        give_back()

    return run(text)


def language_report(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score and rejected.

    A null text, or one without a letter, is `und` with score 0 and rejected; so
    is every text when there is nothing to learn from. Ties go to the language
    that sorts first; repeated rows are judged each alone; an empty table gives no
    rows; a null doc_id counts as the empty id. Columns other than doc_id, text
    and lang are not looked at.
    """
    model = model or fit(spark, docs)
    out = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), predicted(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def identified(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, columns unchanged.

    Null and empty texts, and texts without a letter, go; ties and repeated rows
    are as in language_report; an empty table gives no rows.
    """
    model = model or fit(spark, docs)
    name = "_language"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, predicted(spark, model, F.col("text"))).where(~F.col(f"{name}.rejected")).drop(name)
