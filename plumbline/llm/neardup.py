"""Near-duplicate texts: consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of five-word shingles, over all documents, in a hashed
   table of fixed size (a count sketch with its collision background subtracted,
   so a shingle's relative frequency is estimated without bias and, in relative
   terms, better the larger the corpus). It is summed by slices and broadcast.
2. Each text becomes ``BANDS`` x ``ROWS`` improved consistent weighted samples of
   its shingles under weights tf x (3 + idf) / 4; two texts agree in a sample with
   a probability equal to their weighted Jaccard similarity. ROWS samples make a
   band. Texts equal word for word are one class from here on.
3. Classes that share a band are candidates. First every bucket's smallest class
   is compared with the others (a row for each, never all pairs); links found make
   components. In buckets that still hold several, classes whose shingles are too
   much their own to reach 0.8 with anyone leave, the one with the most in common
   with others becomes the next pivot, and what is left is compared across
   components, in stretches of bounded size, where the common weights allow 0.8.
   No pairs are listed; what leaves a stretch are links. Comparing is exact: the
   weighted Jaccard similarity of the whole texts.

The idf moves weights by a quarter at most: it lets passages that very many
documents share count less, without driving the copies of a large group apart.

At 0.8 a pair shares a band with probability 1 - (1 - 0.8^4)^16 > 0.9997.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Owned, give_back, joined_by_hot, mix64, slices, tasks, windows, written
from .components import components, local_roots, merged
from .words import Words, scan, shingles

_BUCKET = ["band", "value"]
SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Cells of the hashed document-frequency table; it is broadcast, four bytes a cell.
CELLS = 1 << 20
_SLICES = 1024
#: Texts of a bucket that are compared with each other at once, at most about.
STRETCH = 256
#: Relative frequencies well below this all count as rare.
RARE = 1e-4
_QUANTILES = 1 << 16
#: A task that compares texts takes about so many bytes of them.
_TASK_BYTES = 1 << 18


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Weights:
    """What weighs a shingle: the idf of each cell, and the tables of the sampler.

    All of it is computed once, on the driver, so that executors with other
    processors sample alike.
    """

    def __init__(self, counts: np.ndarray, documents: int) -> None:
        total = counts.sum()
        own = counts - (total - counts) / max(1, len(counts) - 1)
        share = np.clip(own, 0, None) / max(1, documents)
        idf = np.clip(np.log(1 / (share + RARE)) / np.log(1 / RARE), 0, 1)
        self.cell = np.round((3 + idf) / 4 * 4096).astype(np.float32) / np.float32(4096)
        gamma = _gamma_quantiles(_QUANTILES)
        self.r = gamma.astype(np.float32)
        self.log_c = np.log(gamma).astype(np.float32)
        self.log = np.round(np.log(np.maximum(np.arange(1 << 16), 1) / 4096) * 1024).astype(np.float32) / np.float32(1024)

    def vectors(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of each text, their weights, and where each text's begin."""
        h, doc = shingles(words, SHINGLE)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.empty(0, np.int64)
        tf = np.diff(np.append(first, len(h)))
        h, doc = h[first], doc[first]
        weight = tf * self.cell[_cell(h, len(self.cell))]
        return h, weight.astype(np.float32), np.searchsorted(doc, np.arange(len(words.first)))

    def samples(self, h: np.ndarray, weight: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """A row of samples for each text that has shingles. The smallest value of a
        text also names the shingle and the step it comes from, so it is the sample."""
        scaled = np.minimum(weight * 4096, 1e9).astype(np.int64)
        small = scaled < len(self.log)
        log_w = np.where(small, self.log[np.where(small, scaled, 0)], np.round(np.log(np.maximum(scaled, 1) / 4096) * 1024).astype(np.float32) / np.float32(1024))
        starts = begin[:-1][np.diff(begin) > 0]
        out = np.empty((len(starts), BANDS * ROWS), dtype=np.float32)
        mask = np.uint64(_QUANTILES - 1)
        for k in range(BANDS * ROWS):
            x = h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
            x *= np.uint64(0xFF51AFD7ED558CCD)
            x ^= x >> np.uint64(33)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
            r = self.r[(x & mask).astype(np.intp)]
            log_c = self.log_c[((x >> np.uint64(16)) & mask).astype(np.intp)]
            beta = ((x >> np.uint64(32)) & mask).astype(np.float32) / np.float32(_QUANTILES)
            step = np.floor(log_w / r + beta)
            out[:, k] = np.minimum.reduceat(log_c - r * (step - beta + np.float32(1)), starts)
        return out


def _cell(h: np.ndarray, cells: int) -> np.ndarray:
    return ((h * np.uint64(0xD1342543DE82EF95)) >> np.uint64(40)).astype(np.int64) % cells


def document_frequencies(docs: DataFrame, cells: int = CELLS) -> np.ndarray:
    """Documents in which each cell's shingles occur, summed over all of ``docs``."""
    width = cells // _SLICES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                words = scan(piece.column("text").cast(pa.large_binary()).to_pylist())
                h, doc = shingles(words, SHINGLE)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                if len(h):
                    h = h[np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))]
                    counts += np.bincount(_cell(h, cells), minlength=cells)
        give_back()
        used = np.flatnonzero(counts.reshape(_SLICES, width).any(axis=1))
        for i in range(0, len(used), 64):
            some = used[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([counts[s * width : (s + 1) * width].astype("<i4").tobytes() for s in some], pa.binary())], names=["slice", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of the slices of this partition only
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, dtype="<i4" if len(raw) == 4 * width else "<i8").astype(np.int64)
                total[s] = total[s] + values if s in total else values
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int32()), pa.array([v.astype("<i8").tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])

    parts = docs.select("text").mapInArrow(part, "slice int, counts binary")
    summed = parts.repartition("slice").coalesce(4 * tasks(docs.sparkSession, 0)).mapInArrow(added, "slice int, counts binary").toArrow()
    out = np.zeros(cells, dtype=np.int64)
    for s, raw in zip(summed.column(0).to_pylist(), summed.column(1).to_pylist(), strict=True):
        out[s * width : (s + 1) * width] = np.frombuffer(raw, dtype="<i8")
    return out


def text_key(words: Words, i: int, raw: bytes | None) -> bytes | None:
    """The same for texts equal word for word; without a word, for equal texts; null for null."""
    if raw is None:
        return None
    own = words.hash[words.first[i] : words.first[i + 1]]
    return hashlib.blake2b(own.tobytes() if len(own) else raw, digest_size=16, person=b"words" if len(own) else b"bytes").digest()


def _signatures(weights: Broadcast):
    """Texts -> the key of each and the value of each of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Weights = weights.value
        for batch in batches:
            for part in slices(batch, "text"):
                raw = part.column("text").cast(pa.large_binary()).to_pylist()
                words = scan(raw)
                h, weight, begin = own.vectors(words)
                bits = np.ascontiguousarray(own.samples(h, weight, begin)).view(np.uint32).astype(np.uint64).reshape(-1, BANDS, ROWS)
                bands = np.zeros(bits.shape[:2], dtype=np.uint64)
                for j in range(ROWS):
                    bands = mix64(bands * np.uint64(0x100000001B3) + bits[:, :, j] + np.uint64(1))
                rows: list = [None] * len(raw)
                for i, b in zip(np.flatnonzero(np.diff(begin) > 0).tolist(), bands.view(np.int64), strict=True):
                    rows[i] = b
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([text_key(words, i, r) for i, r in enumerate(raw)], pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "bands"],
                )
        give_back()

    return run


def _similar(weights: Broadcast):
    """Pairs of keys with both texts -> the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Weights = weights.value
        left: tuple[bytes, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for part in slices(batch, "text_b"):
                a, b, text_a, text_b = (part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
                h, w, begin = own.vectors(scan([t.encode("utf-8", "surrogatepass") for t in text_b]))
                links, score = [], []
                for i, key in enumerate(a):
                    if left is None or left[0] != key:  # rows come in runs of one a
                        left = (key, *own.vectors(scan([text_a[i].encode("utf-8", "surrogatepass")]))[:2])
                    value = weighted_jaccard(left[1], left[2], h[begin[i] : begin[i + 1]], w[begin[i] : begin[i + 1]])
                    if value >= SIMILARITY:
                        links.append(i)
                        score.append(value)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in links], pa.binary()), pa.array([b[i] for i in links], pa.binary()), pa.array(score, pa.float64())], names=["a", "b", "similarity"])
        give_back()

    return run


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger weights; shingles sorted and distinct."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = np.minimum(wa[i], wb[j]).sum(dtype=np.float64)
    return float(both / max(1e-12, wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - both))


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document doc_id, key, component (of its group alone, null without a text)
    and class_id, the smallest doc_id of its group.

    Two texts are linked if their weighted Jaccard similarity is 0.8 or more, or
    if they are equal word for word; groups are what links connect. A null text
    is a group of its own; texts without a word are linked if they are equal; a
    text of fewer than five words has one shingle of them all. Repeated rows fall
    into one group. A row without an id is linked as any other; a group of such rows
    alone has no class_id. An empty table gives no rows; columns other than doc_id
    and text are not looked at.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    with Owned(spark) as work:
        counts = document_frequencies(texts)
        rows, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        weights = spark.sparkContext.broadcast(Weights(counts, rows))  # of fixed size
        parts = tasks(spark, 4 * _TASK_BYTES * spark.sparkContext.defaultParallelism + (size or 0), _TASK_BYTES)  # four for each core, and by size
        id_type = texts.schema["doc_id"].dataType.simpleString()
        signed = written(spark, texts.mapInArrow(_signatures(weights), f"doc_id {id_type}, key binary, bands array<bigint>"), "signatures")
        classes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
        classes = written(spark, classes, "classes", [signed])
        members = written(spark, classes.select("key", F.posexplode("bands").alias("band", "value")), "bands")
        buckets = members.groupBy("band", "value").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1")
        buckets = written(spark, buckets.drop("n"), "buckets", [members])
        members = written(spark, joined_by_hot(spark, members, buckets, _BUCKET), "members", [members])
        asked = members.select("key").distinct()
        wanted = classes.join(asked, "key", "left_semi").select(F.col("first_id").alias("doc_id"), "key")
        found = texts.join(wanted, "doc_id").coalesce(parts).mapInArrow(_checked, "key binary, text string")
        nameless = wanted.where("doc_id IS NULL").select("key")  # classes of rows without an id only
        if not nameless.isEmpty():
            unnamed = texts.where("doc_id IS NULL AND text IS NOT NULL").select("text").mapInArrow(_with_key, f"text string, `{_KEY}` binary")
            found = found.unionByName(unnamed.withColumnRenamed(_KEY, "key").join(nameless, "key", "left_semi"))
        found = written(spark, found.dropDuplicates(["key"]).coalesce(parts), "texts")
        stars = written(spark, members.where("pivot <> key").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct(), "stars", [members])
        links = written(spark, _verified(stars, found, weights, parts), "links")
        labels = components(spark, links, [links])
        # Buckets that hold several components still. A text is out if the shingles it has
        # in common with any other of them weigh too little for 0.8, whatever the partner.
        placed = written(spark, _mixed(spark, members.select("band", "value", "key"), labels, [members]), "mixed", [members])
        measured = written(spark, _linkable(found, placed, weights, parts), "linkable", [placed])
        able = placed.drop("component").join(measured.where(F.col("common") >= SIMILARITY * F.col("total") - 1e-6), "key")
        able = written(spark, _mixed(spark, able, labels, [placed, measured]), "able", [placed, measured])
        # The text with the most in common with others is the next pivot of its bucket.
        best = able.groupBy("band", "value").agg(F.max(F.struct(F.col("common") / F.col("total"), F.col("key"), F.col("component"))).alias("best"))
        again = joined_by_hot(spark, able, written(spark, best, "best", [able]), _BUCKET).where(F.col("component") != F.col("best.component"))
        again = again.select(F.least("key", "best.key").alias("a"), F.greatest("key", "best.key").alias("b")).distinct()
        again = written(spark, again.join(stars, ["a", "b"], "left_anti"), "again", [able])
        labels = merged(spark, labels, written(spark, _verified(again, found, weights, parts), "links"))
        # What is left is compared within its buckets, in stretches of bounded size, where the common weights allow 0.8.
        able = written(spark, _mixed(spark, able.drop("component"), labels, [able]), "left", [able])
        sizes = able.groupBy("band", "value").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("parts"))
        dealt = joined_by_hot(spark, able, written(spark, sizes, "sizes", [able]), _BUCKET).withColumn("stretch", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        dealt = written(spark, dealt, "rest", [able])
        # What is known of a text is joined to it once; only then do rows go to each stretch they meet.
        ready = dealt.join(found.join(classes.select("key", "bands"), "key"), "key").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        ready = ready.withColumn("first", F.least("stretch", "with")).withColumn("second", F.greatest("stretch", "with")).drop("with", "parts")
        order = ["band", "value", "first", "second"]
        more = ready.repartition(*order).sortWithinPartitions(*order).mapInArrow(_within(weights), "a binary, b binary")
        more = written(spark, more, "links")
        if not more.isEmpty():
            labels = merged(spark, labels, more)
        grouped = classes.select("key", "first_id").join(labels, classes.key == labels.node, "left").select("key", "first_id", F.coalesce("component", "key").alias("component"))
        grouped = written(spark, grouped, "grouped", [classes])
        lowest = written(spark, grouped.groupBy("component").agg(F.min("first_id").alias("class_id")), "lowest", [grouped])
        grouped = written(spark, joined_by_hot(spark, grouped, lowest, ["component"]).select("key", "component", "class_id"), "groups", [grouped])
        work.keep(signed, grouped)
    return joined_by_hot(spark, signed.select("doc_id", "key"), grouped, ["key"], "left").select("doc_id", "key", "component", F.coalesce("class_id", "doc_id").alias("class_id"))


def _within(weights: Broadcast):
    """Stretches of a bucket with bands, text, component, total and common weight
    -> links that join texts of other components, as stars."""

    def compare(rows: pa.RecordBatch, own: Weights) -> tuple[list, list]:
        keys, component = rows.column("key").to_pylist(), rows.column("component").to_pylist()
        number = {c: i for i, c in enumerate(set(component))}
        group = np.array([number[c] for c in component])
        side, total, common = (rows.column(c).to_numpy() for c in ("stretch", "total", "common"))
        low = side == side.min()
        cross = rows.column("first")[0].as_py() != rows.column("second")[0].as_py()
        if cross and low.all():
            return [], []
        left, right = (np.flatnonzero(low), np.flatnonzero(~low)) if cross else (np.arange(len(keys)),) * 2
        most = np.minimum(common[left][:, None], common[right][None, :])
        ask = (group[left][:, None] != group[right][None, :]) & (most >= SIMILARITY * (total[left][:, None] + total[right][None, :] - most) - 1e-6)
        band = rows.column("band")[0].as_py()
        if band:  # a pair is compared in the first bucket that it shares
            bands = np.array(rows.column("bands").to_pylist(), dtype=np.int64)[:, :band]
            for i, r in enumerate(left):
                some = np.flatnonzero(ask[i])
                ask[i, some] = ~(bands[right[some]] == bands[r]).any(axis=1)
        if not ask.any():
            return [], []
        at = np.unique(np.concatenate((left[ask.any(axis=1)], right[ask.any(axis=0)])))
        overlap = np.zeros((len(keys), len(keys)))
        overlap[np.ix_(at, at)] = _overlaps(own, [rows.column("text")[int(i)].as_py().encode("utf-8", "surrogatepass") for i in at])
        shared = overlap[np.ix_(left, right)]
        near = ask & (shared >= SIMILARITY * (total[left][:, None] + total[right][None, :] - shared) - 1e-9)
        i, j = np.nonzero(near)
        root = local_roots(len(keys), left[i], right[j])
        linked = np.flatnonzero(root != np.arange(len(keys)))
        return [keys[k] for k in root[linked]], [keys[k] for k in linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, stops in windows(batches, ("band", "value", "first", "second")):
            a: list[bytes] = []
            b: list[bytes] = []
            for start, stop in zip(starts, stops, strict=True):
                x, y = compare(rows.slice(start, stop - start), weights.value)
                a += x
                b += y
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        give_back()

    return run


def _overlaps(own: Weights, texts: list[bytes], columns: int = 4096) -> np.ndarray:
    """Weight that each two texts have in common: sums of the smaller weights.

    A shingle that occurs k times is k columns of one weight, so the smaller of two
    weights is a product of zeros and ones; columns are taken ``columns`` at a time.
    """
    words = scan(texts)
    h, doc = shingles(words, SHINGLE)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    turn = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    weight = own.cell[_cell(h, len(own.cell))].astype(np.float64)
    code = mix64(h + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    kept = count[where] > 1  # others are in one text alone
    doc, weight = doc[kept], weight[kept]
    _, where = np.unique(where[kept], return_inverse=True)
    out = np.zeros((len(texts), len(texts)))
    for at in range(0, int(where.max()) + 1 if len(where) else 0, columns):
        part = (where >= at) & (where < at + columns)
        table = np.zeros((len(texts), columns), dtype=np.float32)
        table[doc[part], where[part] - at] = 1
        scale = np.zeros(columns, dtype=np.float32)
        scale[where[part] - at] = weight[part]
        out += (table * scale) @ table.T
    return out


def _mixed(spark: SparkSession, rows: DataFrame, labels: DataFrame, of: list[DataFrame]) -> DataFrame:
    """``rows`` (band, value, key, ...) with component, of buckets with several components; they come from the tables ``of``."""
    placed = rows.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    placed = written(spark, placed, "placed", of)
    several = placed.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return joined_by_hot(spark, placed, written(spark, several.select("band", "value"), "several", [placed]), _BUCKET)


def _linkable(texts: DataFrame, placed: DataFrame, weights: Broadcast, parts: int) -> DataFrame:
    """Of each text in ``placed``: key, the total weight of its shingles, and the
    weight of those that occur in another text of ``placed`` too."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, weight, begin, keys in _vectors_of(batches, weights):
            sums = np.add.reduceat(np.append(weight, 0).astype(np.float64), np.minimum(begin[:-1], len(weight))) * (np.diff(begin) > 0)
            yield pa.RecordBatch.from_arrays([keys, pa.array(sums)], names=["key", "total"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, weight, begin, keys in _vectors_of(batches, weights):
            owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), keys.take(pa.array(owner)), pa.array(weight)], names=["h", "key", "weight"])

    own = texts.join(placed.select("key").distinct(), "key", "left_semi").coalesce(parts)
    single = own.mapInArrow(shingled, "h bigint, key binary, weight float").groupBy("h").agg(F.count("*").alias("n"), F.first("key").alias("key"), F.first("weight").alias("weight")).where("n = 1")
    alone = single.groupBy("key").agg(F.sum(F.col("weight").cast("double")).alias("alone"))
    return own.mapInArrow(totals, "key binary, total double").join(alone, "key", "left").select("key", "total", (F.col("total") - F.coalesce("alone", F.lit(0.0))).alias("common"))


def _vectors_of(batches: Iterator[pa.RecordBatch], weights: Broadcast) -> Iterator[tuple]:
    own: Weights = weights.value
    for batch in batches:
        for part in slices(batch, "text"):
            yield *own.vectors(scan(part.column("text").cast(pa.large_binary()).to_pylist())), part.column("key")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is the one that the key stands for; an id may have several."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw = part.column("text").cast(pa.large_binary()).to_pylist()
            words = scan(raw)
            keys = part.column("key").to_pylist()
            same = pa.array([text_key(words, i, r) == keys[i] for i, r in enumerate(raw)], pa.bool_())
            yield part.select(["key", "text"]).filter(same)


def _verified(pairs: DataFrame, texts: DataFrame, weights: Broadcast, parts: int) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar enough, by about ``parts`` tasks."""
    right = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = right.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").coalesce(parts).mapInArrow(_similar(weights), "a binary, b binary, similarity double")


def near_duplicate_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document doc_id, class_id and kept (it is the one of its group that stays)."""
    return near_duplicates(spark, docs).select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the key of their text as a last column."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw = part.column("text").cast(pa.large_binary()).to_pylist()
            words = scan(raw)
            keys = pa.array([text_key(words, i, r) for i, r in enumerate(raw)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, _KEY])


#: A column of this name is put next to those of the documents.
_KEY = "key of the text"


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group, columns unchanged: the one with the
    smallest doc_id, and of a group's rows repeated under that id the first by its
    text. Rows with a null text or id all stay."""
    found = near_duplicates(spark, docs)
    gone = found.where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # Ids that several rows share, with texts of several groups maybe: settle these rows alone, by their text.
    from pyspark.sql import Window
    from pyspark.sql import types as T

    shared = docs.join(twice, "doc_id", "left_semi").select(*docs.columns)
    keyed = shared.where("text IS NOT NULL").mapInArrow(_with_key, T.StructType([*shared.schema.fields, T.StructField(_KEY, T.BinaryType())]))
    first = found.join(twice, "doc_id", "left_semi").where(F.col("doc_id") == F.col("class_id"))
    first = first.select("doc_id", F.col("key").alias(_KEY), F.col("component").alias("group of the text")).where(F.col(_KEY).isNotNull()).distinct()
    rank = F.row_number().over(Window.partitionBy("group of the text").orderBy("text"))
    one = keyed.join(first, ["doc_id", _KEY]).withColumn("place in the group", rank).where(F.col("place in the group") == 1)
    null_text = shared.where("text IS NULL")
    single = docs.join(gone.unionByName(twice).distinct(), "doc_id", "left_anti")
    return single.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(null_text.select(*docs.columns))
