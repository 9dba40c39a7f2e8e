"""Quality by co-training of two views: the text itself, and what the page says of it.

The text view sees shares of byte values, repeats and lengths of words and lines;
the metadata view sees source, language and declared length. Both are logistic
regressions fitted in numpy on a bounded, documented sample of labelled rows. In
each round either view labels the unlabelled pool, and what it is most sure of, in
the proportion of the classes, becomes training data of the *other* view. At the
end each view is calibrated on labelled rows kept aside, and a logistic layer over
the two calibrated log-odds scores every document in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, slices
from .words import scan

#: Labelled rows of each class, and unlabelled rows, that are learned from, about.
LABELLED_PER_CLASS = 4000
POOL = 6000
ROUNDS = 4
#: Share of each class's pool rows that a view may pass on in a round, and how sure it must be.
PASS_ON = 0.05
SURE = 0.95
#: Share of good calibration rows that the threshold may reject.
REJECT_SHARE = 0.004
_HASHED = 64


def text_features(texts: list[bytes | None]) -> np.ndarray:
    """A row of features for each text; null or empty: zeros but for the constant."""
    n = len(texts)
    raw = [t or b"" for t in texts]
    size = np.array([len(t) for t in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    owner = np.repeat(np.arange(n, dtype=np.int64) * 256, size)
    hist = np.bincount(owner + data, minlength=256 * n).reshape(n, 256).astype(np.float64)
    per_byte = 1 / np.maximum(size, 1)[:, None]
    words = scan(texts)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    h, doc = words.hash, words.doc
    again = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    order = np.lexsort((h, doc))
    sh, sd = h[order], doc[order]
    fresh = np.ones(len(sh), dtype=bool)
    fresh[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    distinct = np.bincount(sd[fresh], minlength=n)
    letters = np.bincount(doc, weights=words.end - words.start, minlength=n)
    lines = hist[:, 10] + 1
    upper = hist[:, 65:91].sum(axis=1)
    alpha = upper + hist[:, 97:123].sum(axis=1)
    symbols = hist[:, 33:48].sum(axis=1) + hist[:, 58:65].sum(axis=1) + hist[:, 91:97].sum(axis=1) + hist[:, 123:127].sum(axis=1)
    extra = np.stack(
        [
            again / some,
            distinct / some,
            np.log1p(count) / 10,
            letters / some / 10,
            np.log1p(count / lines) / 5,
            upper / np.maximum(alpha, 1),
            symbols / some,
            hist[:, 32] / some,
            (distinct < 0.5 * some).astype(float),
            np.ones(n),
        ],
        axis=1,
    )
    return np.concatenate([np.sqrt(hist * per_byte), extra], axis=1)


def meta_features(source: list[str | None], lang: list[str | None], n_chars: list[int | None]) -> np.ndarray:
    """A row of features for each document's metadata; nulls have their own."""
    import zlib

    out = np.zeros((len(source), 2 * _HASHED + 5))
    for i, (s, g, c) in enumerate(zip(source, lang, n_chars, strict=True)):
        out[i, 0 if s is None else 1 + zlib.crc32(s.encode("utf-8", "surrogatepass")) % (_HASHED - 1)] = 1
        out[i, _HASHED + (0 if g is None else 1 + zlib.crc32(g.encode("utf-8", "surrogatepass")) % (_HASHED - 1))] = 1
        size = np.log1p(max(c or 0, 0)) / 10
        out[i, 2 * _HASHED :] = (c is None, size, size * size, size**3, 1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None, steps: int = 12) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method with a ridge penalty."""
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty * np.eye(len(w))
        move = np.linalg.solve(curve, slope)
        w -= move * min(1.0, 10 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """The two views, their calibration and the layer over them."""

    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    calibration: list[np.ndarray] = field(default_factory=list)
    layer: np.ndarray | None = None
    threshold: float = 0.0

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        if self.text is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        odds = [np.clip(np.stack([x @ w, np.ones(len(x))], 1) @ c, -30, 30) for x, w, c in zip((text, meta), (self.text, self.meta), self.calibration, strict=True)]
        both = np.clip(np.stack([*odds, np.ones(len(text))], 1) @ self.layer, -30, 30)
        return tuple(1 / (1 + np.exp(-o)) for o in (*odds, both))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit both views. Every fourth labelled row is kept aside for calibration."""
    if len(label) < 8 or len(set(label.tolist())) < 2:
        return Model()
    aside = np.arange(len(label)) % 4 == 3
    if len(set(label[aside].tolist())) < 2 or len(set(label[~aside].tolist())) < 2:
        aside[:] = False
    learn, judge = np.flatnonzero(~aside), np.flatnonzero(aside) if aside.any() else np.arange(len(label))
    views = [(text, pool_text), (meta, pool_meta)]
    taught: list[dict[int, float]] = [{}, {}]  # pool row -> pseudo-label, by view
    weights: list[np.ndarray] = []
    for turn in range(rounds + 1):
        weights = []
        for (x, pool), own in zip(views, taught, strict=True):
            rows = np.array(sorted(own), dtype=np.int64)
            y = np.concatenate([label[learn], [own[r] for r in rows]])
            trust = np.concatenate([np.ones(len(learn)), np.full(len(rows), 0.5)])
            weights.append(logistic(np.concatenate([x[learn], pool[rows]]), y, weight=trust))
        if turn == rounds or not len(pool_text):
            break
        share = label[learn].mean()
        for (_, pool), w, other in zip(views, weights, reversed(taught), strict=True):
            p = 1 / (1 + np.exp(-np.clip(pool @ w, -30, 30)))
            for value, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                free = [r for r in np.argsort(-sure, kind="stable").tolist() if sure[r] >= SURE and r not in other]
                for r in free[: int(PASS_ON * part * len(pool)) + 1]:
                    other[r] = value
    model = Model(text=weights[0], meta=weights[1])
    y = label[judge].astype(float)
    for (x, _), w in zip(views, weights, strict=True):
        model.calibration.append(logistic(np.stack([x[judge] @ w, np.ones(len(judge))], 1), y, penalty=0.1))
    odds = [np.stack([x[judge] @ w, np.ones(len(judge))], 1) @ c for (x, _), w, c in zip(views, weights, model.calibration, strict=True)]
    model.layer = logistic(np.stack([*odds, np.ones(len(judge))], 1), y, penalty=0.1)
    good = model.scores(text[judge], meta[judge])[2][y == 1]
    model.threshold = float(min(0.5, np.quantile(good, REJECT_SHARE)))
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            label = part.column("label")
            x = text_features(part.column("text").cast(pa.large_binary()).to_pylist())
            m = meta_features(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
            yield pa.RecordBatch.from_arrays([label, pa.array(list(x)), pa.array(list(m)), part.column("key")], names=["label", "x", "m", "key"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = LABELLED_PER_CLASS, pool: int = POOL) -> Model:
    """Learn from ``labels.quality`` of a sample of labelled documents and an unlabelled pool.

    Rows are picked by a hash, about ``per_class`` labelled ids of each class and
    ``pool`` others, each once, so what reaches the driver is bounded. Of several
    labels of a document the lowest counts, and of several rows of a labelled id one;
    null labels don't count.
    """
    unit = 1 << 30
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    have = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(have) < 2:
        return Model()
    total = docs.count()
    share = F.create_map(*[x for k, n in have.items() for x in (F.lit(k), F.lit(min(unit, unit * per_class // n)))])
    at = F.pmod(F.xxhash64("doc_id"), F.lit(unit))
    picked = known.where(at < share[F.col("label")])  # bounded by per_class, so it may be broadcast
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("bigint").alias("n_chars")).join(F.broadcast(picked), "doc_id", "left")
    in_pool = F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(unit)) < min(unit, unit * pool // max(1, total))
    rows = rows.where(F.col("label").isNotNull() | in_pool)
    # one row of each labelled id, and each text of the pool once, however often they are repeated
    own = F.struct(F.xxhash64("doc_id", "text").alias("key"), "text", "source", "lang", "n_chars", F.col("label").cast("int").alias("label"))
    which = F.when(F.col("label").isNull(), F.xxhash64("doc_id", "text")).otherwise(F.xxhash64("doc_id"))
    rows = rows.groupBy(which.alias("which"), F.col("label").isNull().alias("in_pool")).agg(F.min(own).alias("own")).select("own.*")
    found = rows.mapInArrow(_features, "label int, x array<double>, m array<double>, key bigint").toArrow()
    order = np.argsort(found.column("key").to_numpy(), kind="stable")
    label = np.array([np.nan if v is None else float(v) for v in found.column("label").to_pylist()])[order]

    def matrix(name: str, width: int) -> np.ndarray:
        return np.asarray(found.column(name).combine_chunks().flatten()).reshape(-1, width)[order]

    if not len(label):
        return Model()
    x, m = matrix("x", 266), matrix("m", 2 * _HASHED + 5)
    del found  # held twice otherwise while training
    ok = ~np.isnan(label)
    return co_train(x[ok], m[ok], (label[ok] > 0).astype(int), x[~ok], m[~ok])


_SCORED = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_text", "p_meta", "score")] + [T.StructField("kept", T.BooleanType())])


def scored(spark: SparkSession, model: Model, text: Column, source: Column, lang: Column, n_chars: Column) -> Column:
    """struct(p_text, p_meta, score, kept) of a document."""
    shared = spark.sparkContext.broadcast(model)  # a few thousand numbers

    @F.arrow_udf(_SCORED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = shared.value
        for arrays in batches:
            held = pa.RecordBatch.from_arrays([arrays[0].cast(pa.large_binary()), *arrays[1:]], ["text", "source", "lang", "n_chars"])
            parts = []
            for part in slices(held, "text"):
                raw, *meta = (c.to_pylist() for c in part.columns)
                parts.append(own.scores(text_features(raw), meta_features(*meta)))
            text_p, meta_p, both = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0),) * 3
            yield pa.StructArray.from_arrays([pa.array(v) for v in (text_p, meta_p, both, both >= own.threshold)], names=["p_text", "p_meta", "score", "kept"])
        give_back()

    return run(text, source, lang, n_chars.cast("bigint"))


def quality_report(spark: SparkSession, docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document doc_id, p_text, p_meta, score (all probabilities of good quality) and kept.

    Null texts and metadata have features of their own; empty texts are scored as
    such; without labels of both classes every score is 0.5 and everything is
    kept; a score equal to the threshold is kept; repeated rows are scored each
    alone; an empty table gives no rows; other columns are not looked at.
    """
    model = model or fit(spark, docs, labels)
    p = scored(spark, model, *(F.col(c) for c in ("text", "source", "lang", "n_chars")))
    return docs.select("doc_id", p.alias("p")).select("doc_id", "p.*")


def good_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged.

    Nulls, empty texts, ties with the threshold and repeated rows are as in
    quality_report; an empty table gives no rows; a column may have any name.
    """
    model = model or fit(spark, docs, labels)
    name = "_quality"
    while name in docs.columns:
        name += "_"
    p = scored(spark, model, *(F.col(c) for c in ("text", "source", "lang", "n_chars")))
    return docs.withColumn(name, p).where(F.col(f"{name}.kept")).drop(name)
