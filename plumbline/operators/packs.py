"""Evidence by route, and what answers cite of it.

Each route turns the rows it retrieved into items of one shape: kind, project_id,
source_id, position (from 0, over all pages), content, provenance and caveats.
Every contribution keeps its own scale of scores; none is made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import MOST_ITEMS, SCORE_KINDS, ordered_provenance

DERIVED = "derived"  # the kind of source of a relation that was computed


def entry(method: str, rank: Column, score: Column | None = None, accepted: Column | None = None) -> Column:
    """One line of provenance; methods that carry no score get none."""
    kind = SCORE_KINDS.get(method) if score is not None else None
    return F.struct(
        F.lit(method).alias("method"), rank.cast("int").alias("rank"), F.lit(kind).cast("string").alias("score_kind"),
        (F.lit(None) if score is None else score).cast("double").alias("score"), (F.lit(None) if accepted is None else accepted).cast("boolean").alias("accepted"),
    )


def _sources() -> list[Column]:
    """What the two sources gave to a fused candidate, where they did."""
    found = [("bm25", "bm25_rank", "bm25_score"), ("dense_knn", "dense_rank", "dense_score")]
    return [F.when(F.col(rank).isNotNull() & F.col(score).isNotNull(), entry(method, F.col(rank), F.col(score))) for method, rank, score in found]


def _present(*of: Column) -> Column:
    return F.filter(F.array(*of), lambda x: x.isNotNull())


def _named(**rules: Column) -> Column:
    """Names of the rules that hold, in the order of names."""
    return F.array_sort(_present(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def _items(df: DataFrame, kind: str, source: str, provenance: Column, caveats: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "project_id", F.col(source).cast("string").alias("source_id"), F.col("position").cast("long").alias("position"), "content", ordered_provenance(provenance).alias("provenance"), caveats.alias("caveats"))


def hybrid_items(page: DataFrame) -> DataFrame:
    """A page of accepted candidates: what the reranker, the fusion and each source said of them."""
    told = _present(entry("reranker", F.col("reranked_rank"), F.col("reranker_score"), F.col("accepted")), entry("rrf_fusion", F.col("fused_rank"), F.col("fused_score")), *_sources())
    return _items(page, "canonical_element", "id", told, _named(truncated_projection=F.col("truncated")))


def snapshot_items(page: DataFrame) -> DataFrame:
    """A page of a frozen order, which holds ids alone: a rank and no score."""
    return _items(page, "canonical_element", "id", F.array(entry("snapshot_page", F.col("position") + 1)), _named(truncated_projection=F.col("truncated")))


def document_items(page: DataFrame, replayed: bool = False) -> DataFrame:
    """A page of passages, known by the id of their chunk as it was cut. They are not
    reranked; a replayed page has ranks only."""
    told = F.array(entry("snapshot_page", F.col("position") + 1)) if replayed else _present(entry("rrf_fusion", F.col("fused_rank"), F.col("fused_score"), F.lit(True)), *_sources())
    no_page = F.col("page_number").isNull() & F.col("page_span").isNull()
    caveats = _named(passage_truncated=F.col("truncated"), ocr_derived_passage=F.col("ocr"), page_region_unavailable=F.col("ocr") & (F.coalesce(F.size("page_regions"), F.lit(0)) <= 0), document_metadata_unavailable=no_page)
    return _items(page.where(F.when(F.col("project_id") != "", True).otherwise(F.raise_error(F.lit("a passage needs its project")).cast("boolean"))), "document_chunk", "base_chunk_id", told, caveats)


def graph_items(paths: DataFrame) -> DataFrame:
    """Verified paths (path_id, content, truncated, source_kinds, qualities by edge), known by the id of the path."""
    computed = F.exists("source_kinds", lambda k: k == DERIVED)
    tolerant = F.exists(F.arrays_zip("source_kinds", "qualities"), lambda e: (e["source_kinds"] == DERIVED) & (e["qualities"] == "tolerant"))
    caveats = _named(truncated_projection=F.col("truncated"), graph_derived_relation=computed, graph_tolerant_relation=computed & F.coalesce(tolerant, F.lit(False)))
    return _items(paths, "graph_path", "path_id", F.array(entry("graph_traversal", F.col("position") + 1)), caveats)


#: What holds of every pack of a route or of how it was asked for. Fixed values.
ROUTE_CAVEATS = {"snapshot": "snapshot_page_without_scores", "accept_all": "threshold_accept_all", "degraded": "degraded_route"}


def pack_caveats(items: DataFrame, circumstances: list[str], limit: int = MOST_ITEMS) -> DataFrame:
    """One row: the caveats of the pack as a whole, those of its circumstances included.

    An empty pack says so, and answers abstain on it.
    """
    n, conflict = F.count("*"), F.lit(False) if "conflict" not in items.columns else F.coalesce(F.bool_or("conflict"), F.lit(False))
    always = {ROUTE_CAVEATS[c]: F.lit(True) for c in circumstances}
    return items.agg(n.alias("n"), conflict.alias("conflict")).select(_named(no_evidence=F.col("n") == 0, items_truncated_by_limit=F.col("n") > limit, metadata_conflict=F.col("conflict"), **always).alias("caveats"))


def public_items(items: DataFrame) -> DataFrame:
    """What a client may see of items: no index, no generation, no storage id."""
    shown = F.transform("provenance", lambda p: F.struct(p["method"].alias("method"), p["rank"].alias("rank"), p["score_kind"].alias("score_kind"), p["score"].alias("score")))
    return items.select("reference", "kind", "project_id", "source_id", "content", shown.alias("provenance"), "caveats")


def citations(claims: DataFrame, references: DataFrame, answer: str = "answer_id") -> DataFrame:
    """For each answer the references that its claims cite, once each, in the order of
    references, with all that the server knows of them; nothing comes from the model.

    claims: answer, reference. A reference that isn't there cites nothing.
    """
    cited = claims.select(answer, "reference").distinct().join(references, "reference")
    return cited.withColumn("place", F.row_number().over(Window.partitionBy(answer).orderBy("reference")))


def document_labels(cited: DataFrame, answer: str = "answer_id") -> DataFrame:
    """A label for each document and page an answer cites, at the first reference to it."""
    first = Window.partitionBy(answer, "document_id", "page_number").orderBy("reference")
    # The wording of labels.
    page = F.coalesce(F.concat(F.lit(", página "), F.col("page_number").cast("string")), F.lit(""))
    one = cited.where(F.col("document_id").isNotNull()).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return one.select(answer, "reference", F.concat(F.lit("("), "reference", F.lit(": documento "), "document_id", page, F.lit(")")).alias("label"))


def path_labels(cited: DataFrame, answer: str = "answer_id") -> DataFrame:
    """A label for each path an answer cites: its id and its number of hops."""
    # The wording of labels.
    hops = F.concat(F.col("hop_count").cast("string"), F.when(F.col("hop_count") == 1, " salto").otherwise(" saltos"))
    return cited.where(F.col("path_id").isNotNull()).select(answer, "reference", F.concat(F.lit("("), "reference", F.lit(": caminho "), "path_id", F.lit(", "), hops, F.lit(")")).alias("label"))
