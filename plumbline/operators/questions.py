"""What a question asks for, as Columns: its words are an array, and what they say is
told by where certain words stand next to each other.

A run of words is looked for with ``first_run``: for each place in it the words, or the
pattern, that may stand there. Numbers with units alone are read by a small function
(``language.conditions``), since what they mean depends on what went before.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.functions.text import fold_of, words_of_folded
from plumbline.operators.language import GLOBAL_ID, ORDINALS, class_found, conditions, global_ids, materials_found

Slot = list[str] | str

# Words for storeys, projects, ids and what stops a project's name.
FLOORS = ["piso", "andar", "nivel"]
PROJECT, PROJECTS = ["projeto", "projecto"], ["projetos", "projectos", "modelos"]
NAMED = [*PROJECT, "modelo"]
STOPS = ["no", "na", "nos", "nas", "com", "sem"]

#: Runs of words that ask for a field, in order of priority: "" in a slot means that it may be missing.
FIELDS: list[tuple[str, list[list[Slot]]]] = [
    ("project_id", [[["project_id", "projectid"]], [["project"], ["id"]], [["id", "identificador", "codigo"], ["de", "do"], PROJECT], [["id", "codigo"], PROJECT]]),
    ("storey", [[["por"], FLOORS]]),
    ("project", [[["quantos", "quantas"], PROJECTS], [["quais", "que"], ["", "sao"], ["", "os", "as"], ["", "meus", "minhas"], PROJECTS]]),
    ("material", [[["materiais"]]]),
    ("classification", [[["classificacao", "classificacoes"]]]),
    ("storey", [[["pisos", "andares", "niveis"]]]),
    ("ifc_class", [[["tipos", "classes"]]]),
    ("count", [[["quantos", "quantas", "contar", "contagem", "quantidade"]], [["numero"], ["de"]]]),
]


def _stands(word: Column, slot: Slot) -> Column:
    return F.regexp_like(word, F.lit(slot)) if isinstance(slot, str) else word.isin(slot)


def _full(run: list[Slot]) -> list[list[Slot]]:
    """A run with what may be missing there or not."""
    ways = [[None, [w for w in s if w]] if isinstance(s, list) and "" in s else [s] for s in run]
    return [[s for s in way if s is not None] for way in product(*ways)]


def first_run(words: Column, run: list[Slot]) -> Column:
    """Where the first run of such words begins (from 0), or null."""
    at = F.sequence(F.lit(0), F.size(words) - len(run))
    here = lambda i: _all([F.coalesce(_stands(F.get(words, i + k), slot), F.lit(False)) for k, slot in enumerate(run)])
    return F.when(F.size(words) >= len(run), F.try_element_at(F.filter(at, here), F.lit(1)))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def has_run(words: Column, run: list[Slot]) -> Column:
    found = [first_run(words, way).isNotNull() for way in _full(run)]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def field_asked(words: Column) -> Column:
    """The field that an aggregation is over, by the first rule that has a run among the words."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, runs in FIELDS:
        found = has_run(words, runs[0])
        for run in runs[1:]:
            found = found | has_run(words, run)
        out = out.when(found, name)
    return out


def marks(folded: Column) -> Column:
    """Words, signed numbers and marks of a folded text, in order."""
    return F.regexp_extract_all(folded, F.lit(r"((?<!\w)-\d+|\w+|[^\w\s])"), F.lit(1))


def _plain(number: Column) -> Column:
    """An integer without leading zeros, and without a sign if it is zero."""
    return F.regexp_replace(F.regexp_replace(number, r"^(-?)0+(?=\d)", "$1"), "^-0$", "0")


def storey_asked(words: Column) -> Column:
    """The storey that a folded question's marks() name: a number after a word for it or before one as
    an ordinal, an ordinal word on either side, a label, the ground floor, the basement."""
    ordinal = F.create_map(*(F.lit(x) for k, w in enumerate(ORDINALS) for x in (w, str(k + 1))))
    whole, label = r"^-?\d+$", r"^[a-z]\d+$"

    def at(run: list[Slot], place: int) -> Column:
        return F.get(words, first_run(words, run) + place)

    digits = F.coalesce(at([r"^-?\d+$", ["o"], FLOORS], 0), at([r"^-?\d+$", ["."], ["o"], FLOORS], 0), F.regexp_replace(at([r"^\d+o$", FLOORS], 0), "o$", ""))
    ground = [["r"], ["/"], ["c"]], [["terreo"]], *([["res"], *dash, ["do"], *other, ["chao"]] for dash in ([], [["-"]]) for other in ([], [["-"]]))
    zero = F.lit(False)
    for run in ground:
        zero = zero | first_run(words, run).isNotNull()
    return F.coalesce(
        _plain(at([[*FLOORS, "storey"], whole], 1)), _plain(F.regexp_replace(digits, "^-", "")), F.try_element_at(ordinal, at([list(ORDINALS), FLOORS], 0)), F.try_element_at(ordinal, at([FLOORS, list(ORDINALS)], 1)),
        F.upper(at([[*FLOORS, "storey"], label], 1)), F.when(zero, "0"), F.when(first_run(words, [["cave"]]).isNotNull(), "-1"),
    )


def _bare(text: Column) -> Column:
    """Lower case without the accents that the words looked for may have."""
    return F.translate(F.lower(text), "áàâãéêíóôõúç", "aaaaeeiooouc")


def _trimmed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), "[?.!…]+$", ""))


def _names(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with _name, _project_id and _project_name as they stand in a question.

    Words are what spaces and commas part. A project id follows words for one and looks like
    a code: a digit, an underscore or a capital in it. What follows a word for a project that
    is not part of those is its name, up to a preposition or a comma. A name is what stands
    between the first quotes; else the first word with an underscore, begun by a letter, that
    is neither a global id nor part of what names the project. Each step is a column of its
    own, so that no expression holds another one many times.
    """
    c = F.col
    df = df.withColumn("_said", F.filter(F.split(F.regexp_replace(text, ",", " , "), r"\s+"), lambda w: w != ""))
    df = df.withColumn("_plain", F.transform("_said", lambda w: F.regexp_replace(_bare(w), r"^[^\w]+|[^\w-]+$", "")))
    runs = [way for run in FIELDS[0][1] for way in _full(run)] + [[["project-id"]]]
    starts = F.array(*(F.struct(first_run(c("_plain"), run).alias("start"), F.lit(len(run)).alias("n")) for run in runs))
    df = df.withColumn("_marker", F.array_min(F.filter(starts, lambda m: m["start"].isNotNull())))
    df = df.withColumn("_after", c("_marker.start") + c("_marker.n"))
    df = df.withColumn("_value", F.regexp_extract(F.get("_said", c("_after")), "^[\"«']?([A-Za-z0-9_][A-Za-z0-9_-]*)", 1))
    df = df.withColumn("_project_id", F.when(F.regexp_like("_value", F.lit(r"[0-9_\p{Lu}]")), c("_value")))
    df = df.withColumn("_until", c("_after") + c("_project_id").isNotNull().cast("int"))
    places = F.sequence(F.lit(0), F.greatest(F.size("_said"), F.lit(1)) - 1)
    of_id = lambda i: F.coalesce((i >= c("_marker.start")) & (i < c("_until")), F.lit(False))
    own = F.filter(places, lambda i: F.get("_plain", i).isin(NAMED) & (i < F.size("_said") - 1) & ~of_id(i))
    df = df.withColumn("_trigger", F.try_element_at(own, F.lit(1)))
    df = df.withColumn("_rest", F.slice("_said", c("_trigger") + 2, F.size("_said")))
    stops = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_rest"), F.lit(1)) - 1), lambda i: (F.get("_rest", i) == ",") | ((i > 0) & F.lower(F.get("_rest", i)).isin(STOPS)))
    df = df.withColumn("_stop", F.coalesce(F.try_element_at(stops, F.lit(1)), F.size("_rest")))
    df = df.withColumn("_project_name", F.nullif(_trimmed(F.array_join(F.slice("_rest", F.lit(1), c("_stop")), " ")), F.lit("")))
    df = df.withColumn("_code", F.transform("_said", lambda w: F.regexp_extract(w, r"(?<![\w])([A-Za-z][A-Za-z0-9]*_\w*)", 1)))
    taken = lambda i: of_id(i) | F.coalesce(c("_project_name").isNotNull() & (i >= c("_trigger")), F.lit(False))
    free = F.filter(places, lambda i: (F.get("_code", i) != "") & ~taken(i) & ~F.regexp_like(F.get("_code", i), F.lit(f"^(?:{GLOBAL_ID})$")))
    between = [F.struct(F.nullif(F.instr(text, q[0]), F.lit(0)).alias("at"), F.trim(F.regexp_extract(text, f"{q[0]}([^{q[1]}]+){q[1]}", 1)).alias("t")) for q in ('""', "''", "«»")]
    quoted = F.array_min(F.filter(F.array(*between), lambda b: b["at"].isNotNull() & (b["t"] != "")))["t"]
    return df.withColumn("_name", F.coalesce(quoted, F.get("_code", F.try_element_at(free, F.lit(1)))))


_CONDITION = T.StructType([T.StructField("field", T.StringType()), T.StructField("op", T.StringType()), T.StructField("value", T.DoubleType())])


@F.arrow_udf(T.ArrayType(_CONDITION))
def conditions_of(folded: pa.Array) -> pa.Array:
    """conditions() of a column of folded questions."""
    names = ("field", "op", "value")
    rows = [None if t is None else [dict(zip(names, c, strict=True)) for c in conditions(t)] for t in folded.to_pylist()]
    return pa.array(rows, to_arrow_type(T.ArrayType(_CONDITION)))


def asked(df: DataFrame, column: str, into: str = "asked") -> DataFrame:
    """``df`` with what a column of questions asks for: ifc_class, materials, storey,
    conditions, global_ids, agg_field, name, project_id, project_name. Null asks for nothing."""
    text, kept = F.col(column), [c for c in df.columns if c != into]
    out = df.withColumn("_folded", fold_of(text))
    out = out.withColumn("_normal", words_of_folded(F.col("_folded"))).withColumn("_marks", marks(F.col("_folded"))).withColumn("_conditions", conditions_of(F.col("_folded")))
    out = _names(out.withColumn("_words", F.split("_normal", " ")), text)
    parts = F.struct(
        class_found(F.col("_normal")).alias("ifc_class"), materials_found(F.col("_normal")).alias("materials"), storey_asked(F.col("_marks")).alias("storey"), F.col("_conditions").alias("conditions"),
        global_ids(text).alias("global_ids"), field_asked(F.col("_words")).alias("agg_field"), F.col("_name").alias("name"), F.col("_project_id").alias("project_id"), F.col("_project_name").alias("project_name"),
    )
    return out.select(*kept, F.when(text.isNotNull(), parts).alias(into))
