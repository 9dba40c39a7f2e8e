"""Linking the mentions in a text to the elements of one project.

A catalogue is checked, put in order and given a fingerprint. A text is read in
three passes, each on what the ones before left over: identifiers, exact names
(the longest first, from the left), and names that are nearly right. Every span
that was looked at gets an outcome; an element that several spans lead to is one
link, by its strongest method.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions import ids
from plumbline.functions.text import osa_similarities, tokens

FUZZY, MARGIN, CANDIDATES = 0.85, 0.10, 200
LONGEST_NAME, SHORTEST_NAME = 8, 4
MOST_ELEMENTS, MOST_TOKENS, MOST_MENTIONS, MOST_LINKS, MOST_SPANS = 200_000, 4_000, 256, 32, 16
#: Tasks that identifiers are dealt to.
TASKS = 192
LEVELS = ("space", "storey", "building")
# Names of kinds of things, which identify none of them.
STOP_NAMES = frozenset(
    "abertura ceiling cobertura coluna column door element elemento fachada floor janela laje material muro opening parede "
    "pavimento pilar piso porta roof sala slab space stair storey telhado teto viga wall window".split()
)
_EDGE, _AFTER = r"(?<![0-9A-Za-z_$])", r"(?![0-9A-Za-z_$])"
ELEMENT_ID, GLOBAL_ID = rf"{_EDGE}el_[0-9a-f]{{32}}{_AFTER}", rf"{_EDGE}[0-9A-Za-z_$]{{22}}{_AFTER}"
#: Methods, the strongest first.
METHODS = ["element_id", "global_id", "exact_name_location", "exact_name", "fuzzy_name"]


def normal_name(name: str) -> str:
    return " ".join(t for t, _, _ in tokens(name))


def eligible_name(name: str | None, stop: frozenset[str] = STOP_NAMES) -> bool:
    """Whether a name may be linked: one to eight words, four characters at least with
    the spaces between them, and no stop name."""
    normal = normal_name(name or "")
    return 1 <= len(normal.split()) <= LONGEST_NAME and len(normal) >= SHORTEST_NAME and normal not in stop


@dataclass
class Mention:
    """A span of the text and what became of it."""

    start: int
    stop: int
    outcome: str
    element_id: str | None = None
    method: str | None = None
    score: float | None = None
    runner_up: float | None = None
    candidates: int = 0
    levels: list[str] = field(default_factory=list)


class Linker:
    """Links texts to elements: dicts with element_id, global_id, name and maybe space, storey, building."""

    def __init__(self, elements: list[dict], stop: frozenset[str] = STOP_NAMES) -> None:
        self.stop = stop
        self.by_id = {"element_id": {}, "global_id": {}}
        self.by_name: dict[str, list[dict]] = {}
        for e in sorted(elements, key=lambda e: e["element_id"]):
            for kind, known in self.by_id.items():
                if e.get(kind):
                    known[e[kind]] = e["element_id"]
            if eligible_name(e.get("name"), stop):
                self.by_name.setdefault(normal_name(e["name"]), []).append(e)
        self.with_word: dict[str, list[str]] = {}
        for name in sorted(self.by_name):
            for word in set(name.split()) - stop:
                self.with_word.setdefault(word, []).append(name)
        self.places = {level: {normal_name(e[level]): e[level] for e in elements if eligible_name(e.get(level), stop)} for level in LEVELS}

    def mentions(self, text: str) -> list[Mention]:
        """Every span with its outcome, in order. A text of too many words, or with too many
        mentions, is one span with an outcome of its own: others aren't held up by it."""
        words = tokens(text)
        if len(words) > MOST_TOKENS:
            return [Mention(0, len(text), "refused_word_bound", candidates=len(words))]
        found = list(self._identified(text))
        free = [w for w in words if all(w[2] <= m.start or m.stop <= w[1] for m in found)]
        said = " ".join(["", *(w for w, _, _ in words), ""])
        here = {level: sorted(v for n, v in known.items() if f" {n} " in said) for level, known in self.places.items()}
        runs, run = [], []
        at = 0
        while at < len(free):
            size = next((n for n in range(min(LONGEST_NAME, len(free) - at), 0, -1) if self._phrase(free[at : at + n]) in self.by_name), 0)
            if size:
                found.append(self._named(free[at : at + size], here))
                runs.append(run)
                run = []
            else:
                run.append(free[at])
            at += size or 1
        for run in [*runs, run]:
            found += self._nearly(run)
        if len(found) > MOST_MENTIONS:
            return [Mention(0, len(text), "refused_mention_bound", candidates=len(found))]
        return sorted(found, key=lambda m: (m.start, m.stop))

    @staticmethod
    def _phrase(words: list[tuple[str, int, int]]) -> str:
        return " ".join(w for w, _, _ in words)

    def _identified(self, text: str) -> Iterator[Mention]:
        """Identifiers, of overlapping ones the first."""
        spans = sorted((m.start(), m.end(), kind) for kind, pattern in (("element_id", ELEMENT_ID), ("global_id", GLOBAL_ID)) for m in re.finditer(pattern, text))
        end = 0
        for start, stop, kind in spans:
            if start >= end:
                end = stop
                element = self.by_id[kind].get(text[start:stop])
                yield Mention(start, stop, "linked", element, kind, 1.0, candidates=1) if element else Mention(start, stop, "unresolved_unknown_identifier")

    def _named(self, words: list[tuple[str, int, int]], here: dict[str, list[str]]) -> Mention:
        """An exact name; of several elements the one that the places in the text single out."""
        left = self.by_name[self._phrase(words)]
        n, used = len(left), []
        for level in LEVELS:
            if len(left) > 1 and here[level]:
                if len(here[level]) > 1:
                    return Mention(words[0][1], words[-1][2], "ambiguous_location_conflict", candidates=n)
                left = [e for e in left if e.get(level) == here[level][0]]
                used.append(level)
        if len(left) != 1:
            return Mention(words[0][1], words[-1][2], "ambiguous_duplicate_name", candidates=n)
        return Mention(words[0][1], words[-1][2], "linked", left[0]["element_id"], "exact_name" if n == 1 else "exact_name_location", 1.0, candidates=n, levels=used)

    def near(self, phrase: str) -> list[tuple[float, str]] | None:
        """(similarity, element) of the elements whose name shares a word with the phrase,
        the best first; None if there are too many."""
        names = sorted({n for w in set(phrase.split()) - self.stop for n in self.with_word.get(w, ())})
        if sum(len(self.by_name[n]) for n in names) > CANDIDATES:
            return None
        scores = osa_similarities([phrase] * len(names), names).tolist()
        return sorted(((s, e["element_id"]) for s, n in zip(scores, names, strict=True) for e in self.by_name[n]), key=lambda x: (-x[0], x[1]))

    def _nearly(self, run: list[tuple[str, int, int]]) -> Iterator[Mention]:
        """Names that are nearly right, in words that stand together."""
        at = 0
        while at < len(run):
            for size in range(min(LONGEST_NAME, len(run) - at), 0, -1):
                start, stop = run[at][1], run[at + size - 1][2]
                near = self.near(self._phrase(run[at : at + size]))
                if near is None:
                    yield Mention(start, stop, "unresolved_candidate_bound", candidates=CANDIDATES + 1)
                    break
                if near and near[0][0] >= FUZZY:
                    score, element = near[0]
                    other = next((s for s, e in near if e != element), 0.0)
                    close = score - other < MARGIN
                    yield Mention(start, stop, "ambiguous_fuzzy_margin" if close else "linked", None if close else element, None if close else "fuzzy_name", score, other, len(near))
                    break
            else:
                size = 1
                near = self.near(run[at][0])
                if near and near[0][0] > 0:
                    yield Mention(run[at][1], run[at][2], "unresolved_below_threshold", score=near[0][0], candidates=len(near))
            at += size

    def links(self, text: str) -> list[tuple[str, str, float, list[tuple[int, int]]]]:
        """(element, method, score, spans) of each element that is linked, in the order of the text."""
        held: dict[str, list[Mention]] = {}
        for m in self.mentions(text):
            if m.outcome == "linked":
                held.setdefault(m.element_id, []).append(m)
        if len(held) > MOST_LINKS or any(len(v) > MOST_SPANS for v in held.values()):
            raise ValueError("a text has too many links, or a link too many mentions")
        out = []
        for element, own in held.items():
            best = min(own, key=lambda m: (METHODS.index(m.method), m.start))
            out.append((element, best.method, best.score, sorted({(m.start, m.stop) for m in own})))
        return sorted(out, key=lambda link: (link[3][0], link[0]))


# ------------------------------------------------------------------ as tables


def catalogue_issues(elements: DataFrame, project: str) -> DataFrame:
    """(element_id, issue) of records that a catalogue of ``project`` can't hold."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issue = F.when(~F.col("project_id").eqNullSafe(project), "other_project")
    for c in ("element_id", "global_id", "ifc_class"):
        issue = issue.when(blank(c), f"no_{c}")
    single = elements.select("element_id", issue.alias("issue")).where("issue IS NOT NULL")
    for c in ("element_id", "global_id"):
        twice = elements.where(~blank(c)).groupBy(c).agg(F.min("element_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        single = single.unionByName(twice.select(F.col("first").alias("element_id"), F.lit(f"duplicate_{c}").alias("issue")))
    return single


def catalogue_fingerprint(elements: DataFrame, fields: list[str]) -> DataFrame:
    """One digest per project over its elements in the order of their ids."""
    row = ids.framed(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["element_id", *fields]))
    rows = elements.select("project_id", "element_id", F.sha2(row.cast("binary"), 256).alias("row"))  # of fixed size, whatever the fields hold
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("element_id", "row"))), lambda r: r["row"])
    return rows.groupBy("project_id").agg(F.concat(F.lit("cat_"), F.substring(F.sha2(F.array_join(ordered, "").cast("binary"), 256), 1, 32)).alias("fingerprint"))


def identifier_mentions(chunks: DataFrame, elements: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, identifier, method, element_id): every element id and global id in a text,
    each once; element_id is null for those that no element has."""
    found = lambda pattern, method: F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), lambda x: F.struct(x.alias("identifier"), F.lit(method).alias("method")))
    every = F.array_distinct(F.concat(found(ELEMENT_ID, "element_id"), found(GLOBAL_ID, "global_id")))
    asked = chunks.select(key, F.explode(every).alias("x")).select(key, "x.*")
    known = elements.select(F.explode(F.array(*(F.struct(F.col(c).alias("identifier"), F.lit(c).alias("method")) for c in ("element_id", "global_id")))).alias("x"), "element_id").select("x.*", "element_id")
    asked = asked.repartition(TASKS, "identifier", "method")  # neither side is bounded: none is broadcast, or sorted in one task
    return asked.join(known.hint("merge"), ["identifier", "method"], "left").select(key, "identifier", "method", "element_id")


_MENTION = T.ArrayType(
    T.StructType(
        [T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]
        + [T.StructField(n, T.StringType()) for n in ("outcome", "element_id", "method")]
        + [T.StructField("score", T.DoubleType()), T.StructField("runner_up", T.DoubleType()), T.StructField("candidates", T.IntegerType()), T.StructField("levels", T.ArrayType(T.StringType()))]
    )
)


def mentions_of(spark: SparkSession, text: Column, elements: DataFrame, stop: frozenset[str] = STOP_NAMES) -> Column:
    """The mentions of a column of texts, against one project's elements.

    The catalogue is broadcast; more than ``MOST_ELEMENTS`` elements are refused, as a
    project has no more. A null text has no mentions.
    """
    columns = [c for c in ("element_id", "global_id", "name", *LEVELS) if c in elements.columns]
    rows = elements.select(*columns).limit(MOST_ELEMENTS + 1).toArrow().to_pylist()
    if len(rows) > MOST_ELEMENTS:
        raise ValueError(f"a catalogue has more than {MOST_ELEMENTS} elements")
    shared = spark.sparkContext.broadcast(rows)
    kept: dict[int, Linker] = {}

    @F.arrow_udf(_MENTION)
    def run(texts: pa.Array) -> pa.Array:
        if 0 not in kept:
            kept[0] = Linker(shared.value, stop)
        return pa.array([None if t is None else [m.__dict__ for m in kept[0].mentions(t)] for t in texts.to_pylist()], to_arrow_type(_MENTION))

    return run(text)
