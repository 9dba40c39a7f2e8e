"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens (only longer ones are cut);
packing looks at lengths alone. Pieces are dealt by hash into cohorts of bounded
size, each a packing problem of its own, and every cohort is worked on by several
islands in parallel. An individual is a grouping of pieces into bins. Crossover
takes whole well-filled bins of one parent into the other, drops the bins that now
hold a piece twice, and puts the displaced pieces back by best fit. After each
epoch the elite of every island migrates to the next island of its cohort. When
the epochs are over, the best island's grouping is the cohort's, and the bins
that are not full enough are opened and packed once more together with those of
neighbouring cohorts, so that the waste of a part-filled last bin is shared.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, slices, written
from .tokens import encoder

CAPACITY = 1024
#: Bytes of text cut into pre-tokens at once.
SLICE = 4 << 20
END_ID = 2
COHORT = 16384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Islands in a task, and tasks, at most.
PER_TASK = 16
MOST_TASKS = 4096
#: Cohorts whose part-filled bins are packed again together.
MERGE = 16

Bin = list[int]


def best_fit(lengths: list[int], order: list[int], capacity: int, bins: list[Bin] | None = None) -> list[Bin]:
    """Put the pieces of ``order`` one by one where they leave the least room,
    into ``bins`` or new ones. Of equally good bins the latest opened is taken."""
    bins = [b[:] for b in bins] if bins else []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    have = 0  # bit r is set while some bin has r tokens of room
    for i, b in enumerate(bins):
        room = capacity - sum(lengths[p] for p in b)
        by_room[room].append(i)
        have |= 1 << room
    for p in order:
        size = lengths[p]
        fits = have >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                have &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(p)
        by_room[room - size].append(at)
        have |= 1 << (room - size)
    return bins


def fitness(lengths: list[int], bins: list[Bin], capacity: int) -> tuple[int, int]:
    """Lower is better: the number of bins, then how evenly they are filled."""
    return len(bins), -sum(sum(lengths[p] for p in b) ** 2 for b in bins)


def crossover(lengths: list[int], mine: list[Bin], other: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Inject well-filled bins of ``other`` into ``mine`` and repair by best fit."""
    full = sorted(range(len(other)), key=lambda i: (-sum(lengths[p] for p in other[i]), i))
    top = full[: max(1, len(full) // 2)]
    chosen = [other[i] for i in rng.sample(top, max(1, len(top) // 2))]
    taken = {p for b in chosen for p in b}
    kept, displaced = [], []
    for b in mine:
        if taken.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [p for p in b if p not in taken]
    displaced.sort(key=lambda p: (-lengths[p], p))
    return best_fit(lengths, displaced, capacity, chosen + kept)


def mutated(lengths: list[int], bins: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Open the emptiest bins and a few others, and put their pieces back."""
    order = sorted(range(len(bins)), key=lambda i: (sum(lengths[p] for p in bins[i]), i))
    open_ = set(order[:2] + rng.sample(order, min(len(order), 2)))
    loose = [p for i in open_ for p in bins[i]]
    loose.sort(key=lambda p: (-lengths[p], rng.random()))
    return best_fit(lengths, loose, capacity, [b for i, b in enumerate(bins) if i not in open_])


def least_bins(lengths: list[int], capacity: int) -> int:
    """No grouping has fewer bins: total room, and pieces over half of the capacity."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[list[Bin]], generations: int = GENERATIONS, population: int = POPULATION) -> list[Bin]:
    """The best grouping that one island finds, from its own start and the elites
    it was sent. It stops as soon as the lower bound is met."""
    goal = least_bins(lengths, capacity)
    rng = random.Random(seed)
    rated = lambda bins: (fitness(lengths, bins, capacity), bins)
    people = [rated(bins) for bins in elites]
    if not people:
        order = sorted(range(len(lengths)), key=lambda p: (-lengths[p], p))
        people.append(rated(best_fit(lengths, order, capacity)))
    best = min(people, key=lambda r: r[0])
    if best[0][0] <= goal:
        return best[1]
    while len(people) < population:
        jitter = sorted(range(len(lengths)), key=lambda p: -lengths[p] * (1 + 0.1 * rng.random()))
        people.append(rated(best_fit(lengths, jitter, capacity)))
    for _ in range(generations):
        people.sort(key=lambda r: r[0])
        if people[0][0][0] <= goal:
            break
        a, b = sorted(rng.sample(range(len(people)), 2))
        child = crossover(lengths, people[a][1], people[b][1], capacity, rng)
        people[-1] = min(rated(child), rated(mutated(lengths, child, capacity, rng)), key=lambda r: r[0])
    return min(people, key=lambda r: r[0])[1]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, kept: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its text (null: none) and the end id. If it is
    longer than ``capacity`` it is cut into pieces of that length, the first
    taking the rest. ``kept`` bounds the pre-tokens that a worker keeps,
    ``slice_bytes`` the text that it cuts at once.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(tokenizer, kept)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                row, piece, start, length, crc = [], [], [], [], []
                coded, counts = model.code(part.column("text").to_pylist())
                stops = np.cumsum(counts)
                every = np.insert(coded.astype("<u4"), stops, end_id).tobytes()
                stops = (stops + np.arange(1, len(stops) + 1)).tolist()
                for i, n in enumerate((counts + 1).tolist()):
                    ids = memoryview(every)[4 * (stops[i] - n) : 4 * stops[i]]
                    at, k = 0, 0
                    while at < n:
                        size = min(capacity, n) if at else (n - 1) % capacity + 1
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at, k = at + size, k + 1
                ids_col = part.column("doc_id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids_col, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=[n for n, _ in fields],
                )
        give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join(f"{n} {t}" for n, t in fields))


def _grouping(bins: list[Bin], n: int) -> bytes:
    """Bin number of each of n pieces, packed."""
    own = [0] * n
    for i, b in enumerate(bins):
        for p in b:
            own[p] = i
    return struct.pack(f"<{n}I", *own)


def _bins(grouping: bytes) -> list[Bin]:
    own = struct.unpack(f"<{len(grouping) // 4}I", grouping)
    bins: list[Bin] = [[] for _ in range(max(own, default=-1) + 1)]
    for p, i in enumerate(own):
        bins[i].append(p)
    return [b for b in bins if b]


def _epoch(capacity: int, epoch: int, generations: int):
    """Evolve each island of a batch: (cohort, island, lengths, elites) -> its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, size = [], []
            for cohort, island, lengths, elites in zip(*(batch.column(c).to_pylist() for c in ("cohort", "island", "lengths", "elites")), strict=True):
                bins = evolve(lengths, capacity, cohort * 1000 + island * 10 + epoch, [_bins(e) for e in elites], generations)
                best.append(_grouping(bins, len(lengths)))
                size.append(len(bins))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cohort"), batch.column("island"), batch.column("lengths"), pa.array(best, pa.binary()), pa.array(size, pa.int64())],
                names=["cohort", "island", "lengths", "best", "n_bins"],
            )

    return run


def _islands(spark: SparkSession, problems: DataFrame, tasks: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """Best grouping of each problem (cohort, lengths, elites): cohort, best."""
    state = problems
    for epoch in range(epochs):
        spread = state.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        if epoch:  # the ring: an island keeps its own elite and gets its neighbour's
            left = (F.col("island") + islands - 1) % islands
            spread = spread.withColumn("elites", F.array_distinct(F.filter(F.transform("bests", lambda b: F.when(b.island.isin(F.col("island")) | (b.island == left), b.best)), lambda e: e.isNotNull())))
        spread = spread.select("cohort", "island", "lengths", "elites").repartition(tasks, "cohort", "island")  # small rows, long work: a stated number, so they aren't merged
        done = spread.mapInArrow(_epoch(capacity, epoch, generations), "cohort bigint, island int, lengths array<int>, best binary, n_bins bigint")
        done = written(spark, done, f"islands{epoch}")
        state = done.groupBy("cohort").agg(F.first("lengths").alias("lengths"), F.collect_list(F.struct("n_bins", "island", "best")).alias("bests"))
    return state.select("cohort", F.array_min("bests")["best"].alias("best"))


_OUT = "length bigint, doc_id {id}, piece int, start bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, cohort bigint, reopen boolean"


def _placed(rows: list[dict], bins: list[Bin], base: int, cohort: int, worth: int, capacity: int) -> list[dict]:
    """The rows with their bin's number and their place in it."""
    out = []
    for i, b in enumerate(bins):
        fill = sum(rows[p]["length"] for p in b)
        at = 0
        for p in b:
            out.append(rows[p] | {"sequence_id": base + i, "offset": at, "cohort": cohort, "reopen": fill < worth})
            at += rows[p]["length"]
    return out


def _place(capacity: int, worth: int, schema: pa.Schema):
    """Rows of solved cohorts (cohort, items, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                out = _placed(row["items"], _bins(row["best"]), row["cohort"] << 32, row["cohort"], worth, capacity)
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _again(capacity: int, base: int, generations: int, schema: pa.Schema):
    """Pack the rows of one group of cohorts anew; their present bins are the elite to beat."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = sorted(table.drop_columns(["group"]).to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        lengths = [r["length"] for r in rows]
        present: dict[int, Bin] = {}
        for p, r in enumerate(rows):
            present.setdefault(r["sequence_id"], []).append(p)
        anew = best_fit(lengths, sorted(range(len(rows)), key=lambda p: (-lengths[p], p)), capacity)
        bins = evolve(lengths, capacity, group, [anew, [*present.values()]], generations)
        return pa.Table.from_pylist(_placed(rows, bins, base + group << 32, group, 0, capacity), schema=schema)

    return run


def packed(spark: SparkSession, parts: DataFrame, capacity: int = CAPACITY, cohort: int = COHORT, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    ``parts`` is read twice, so it should be a written table. Repeated rows are
    packed each alone, an empty table gives no rows, other columns are left out;
    neither nulls nor clashing names in them matter.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    item = F.struct("length", *(c for c in columns if c != "length"))
    cohorts = max(1, -(-parts.count() // cohort))
    # the row's number parts rows that repeat each other
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(cohorts))
    # A full piece is a sequence by itself; it takes no part in the search.
    full = parts.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    rest = parts.where(F.col("length") < capacity)
    dealt = written(spark, rest.groupBy(key.alias("cohort")).agg(F.sort_array(F.collect_list(item)).alias("items")), "cohorts")
    problems = dealt.select("cohort", F.transform("items", lambda i: i["length"].cast("int")).alias("lengths"), F.array().cast("array<binary>").alias("elites"))
    best = _islands(spark, problems, min(-(-cohorts * islands // PER_TASK), MOST_TASKS), capacity, islands, epochs, generations)
    ddl = _OUT.format(id=parts.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(T._parse_datatype_string(ddl))
    worth = capacity - capacity // 64
    first = written(spark, dealt.join(best, "cohort").mapInArrow(_place(capacity, worth, schema), ddl), "first")
    groups = -(-cohorts // MERGE)  # of as many cohorts each as can be
    loose = first.where("reopen").withColumn("group", F.expr(f"cohort * {groups} div {cohorts}"))
    again = loose.groupBy("group").applyInArrow(_again(capacity, cohorts, generations, schema), ddl)
    names = [*columns, "sequence_id", "offset"]
    return first.where("NOT reopen").select(names).unionByName(again.select(names)).unionByName(full.select(names))


def packed_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, kept: int | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is a piece of one token, the end id; repeated rows and
    tied ids are packed each alone; equally good places go to the bin opened last;
    an empty table gives no rows; columns other than doc_id and text are left out.
    """
    return packed(spark, written(spark, pieces(docs, tokenizer, capacity, kept=kept, slice_bytes=slice_bytes), "pieces"), capacity)
