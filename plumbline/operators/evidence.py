"""Evidence packs, references, claims, citations and snapshots of rankings."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import support_form

MOST_ITEMS, MOST_REFERENCES, LEAST_QUOTE, PATH_CHARS = 200, 50, 8, 2000
SNAPSHOT_IDS, SNAPSHOT_BYTES = 200, 32 << 10


def merged(items: DataFrame) -> DataFrame:
    """Items (kind, project_id, source_id, store, position, content, method) once each:
    provenance united, first content kept, a conflict told; one id in two stores is an error."""
    out = items.groupBy("kind", "project_id", "source_id").agg(
        F.min("position").alias("position"), F.min_by("content", "position").alias("content"), (F.countDistinct("content") > 1).alias("conflict"), F.sort_array(F.collect_set("method")).alias("methods"), (F.countDistinct("store") > 1).alias("crossed")
    )
    crossed = F.raise_error(F.lit("an item comes from two stores")).cast("string")
    return out.withColumn("content", F.when(F.col("crossed"), crossed).otherwise(F.col("content"))).drop("crossed")


def pack(items: DataFrame, limit: int = MOST_ITEMS) -> DataFrame:
    """Groups of a pack: merged, put in order, cut to ``limit`` and only then grouped."""
    order = Window.orderBy("position", "kind", "source_id")
    top = merged(items).orderBy("position", "kind", "source_id").limit(limit + 1).withColumn("at", F.row_number().over(order))
    item = F.struct("at", "source_id", "content", "methods", "conflict")
    more = F.max("at").over(Window.partitionBy(F.lit(0))) > limit
    return top.withColumn("truncated", more).where(F.col("at") <= limit).groupBy("kind", "project_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("truncated").alias("truncated"))


def references(items: DataFrame, prefix: str = "E", order: str = "at", limit: int = MOST_REFERENCES) -> DataFrame:
    """E001, E002 … for the first items of a pack."""
    n = F.row_number().over(Window.orderBy(order))
    return items.orderBy(order).limit(limit).withColumn("n", n).withColumn("reference", F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), 3, "0"))).drop("n")


def supported(quote: Column, content: Column) -> Column:
    """Whether a normalised quote is long enough and stands in the normalised content."""
    return (F.char_length(quote) >= LEAST_QUOTE) & (F.instr(content, quote) > 0)


def validated(claims: DataFrame, items: DataFrame, answer: str = "answer_id") -> DataFrame:
    """Per answer whether every claim (reference, quote) holds: one bad claim and the answer abstains."""
    joined = claims.join(items.select("reference", "content"), "reference", "left")
    good = F.coalesce(supported(F.col("quote"), F.col("content")), F.lit(False))
    return joined.groupBy(answer).agg(F.bool_and(good).alias("accepted"), F.count("*").alias("claims"))


def aggregate_supported(claims: DataFrame, buckets: DataFrame) -> DataFrame:
    """Claims (key, n) with whether the bucket has exactly that count."""
    return claims.join(buckets.select("key", F.col("n").alias("actual")), "key", "left").withColumn("supported", F.coalesce(F.col("n") == F.col("actual"), F.lit(False)))


def path_text(names: Column, predicates: Column) -> Column:
    """A path as lines: a line for each node and relation, then the hops."""
    steps = F.zip_with(predicates, F.slice(names, 2, F.greatest(F.size(predicates), F.lit(1))), lambda p, n: F.concat(F.lit("-"), p, F.lit("-> "), n))
    return F.left(F.array_join(F.concat(F.slice(names, 1, 1), steps, F.array(F.concat(F.lit("hops: "), F.size(predicates).cast("string")))), "\n"), F.lit(PATH_CHARS))


def caveats(**rules: Column) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())


def ordered_provenance(entries: Column) -> Column:
    """Provenance structs distinct and in their total order."""
    return F.array_sort(F.array_distinct(entries))


def summary(packs: DataFrame) -> DataFrame:
    """Counts for observability: no content leaves."""
    return packs.select("kind", F.size("items").alias("n"), "truncated").groupBy("kind").agg(F.sum("n").alias("items"), F.count("*").alias("groups"), F.bool_or("truncated").alias("truncated"))


# ------------------------------------------------------------------ snapshots


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def sign_snapshot(ids: list[str], identity: dict, key: bytes, now: int | None = None, lifetime: int = 900) -> str:
    """A token for the frozen order of a ranking: hs1.payload.signature."""
    if len(ids) > SNAPSHOT_IDS or len(set(ids)) != len(ids):
        raise ValueError("too many ids, or repeated ones")
    now = int(time.time()) if now is None else now
    payload = json.dumps({"v": 1, "ids": ids, "identity": identity, "iat": now, "exp": now + lifetime}, sort_keys=True, separators=(",", ":")).encode()
    token = f"hs1.{_b64(payload)}.{_b64(hmac.new(key, payload, hashlib.sha256).digest())}"
    if len(token) > SNAPSHOT_BYTES:
        raise ValueError("token too large")
    return token


def open_snapshot(token: str, identity: dict, key: bytes, now: int | None = None) -> list[str]:
    """The ids of a token; checks size, structure, signature, schema, expiry and identity in this order."""
    if len(token) > SNAPSHOT_BYTES:
        raise ValueError("size")
    parts = token.split(".")
    if len(parts) != 3 or parts[0] != "hs1":
        raise ValueError("structure")
    try:
        payload, signature = (base64.urlsafe_b64decode(p + "=" * (-len(p) % 4)) for p in parts[1:])
    except ValueError as e:
        raise ValueError("structure") from e
    if not hmac.compare_digest(signature, hmac.new(key, payload, hashlib.sha256).digest()):
        raise ValueError("signature")
    data = json.loads(payload)
    if set(data) != {"v", "ids", "identity", "iat", "exp"} or data["v"] != 1:
        raise ValueError("schema")
    if (int(time.time()) if now is None else now) >= data["exp"]:
        raise ValueError("expired")
    if data["identity"] != identity:
        raise ValueError("identity")
    return data["ids"]


def snapshot_page(df: DataFrame, key: str, ids: list[str], offset: int, size: int) -> DataFrame:
    """A page of a frozen list, joined back to its records in order."""
    page = df.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(ids)][offset : offset + size], f"rank int, {key} string")
    return df.join(F.broadcast(page), key).orderBy("rank")


def quote_holds(quote: str, content: str) -> bool:
    """supported() for one pair of raw texts."""
    q = support_form(quote)
    return len(q) >= LEAST_QUOTE and q in support_form(content)


#: Scale of the score that each method may carry; the others carry none. Fixed values.
SCORE_KINDS = {"bm25": "bm25_score", "dense_knn": "dense_similarity", "rrf_fusion": "rrf_fused", "reranker": "reranker_probability", "structured_filter": "opensearch_query_score"}
METHOD_ORDER = ["bm25", "dense_knn", "rrf_fusion", "reranker", "structured_filter", "exact_lookup", "snapshot_page", "graph_traversal"]


def score_kind_issue(method: Column, kind: Column) -> Column:
    """Why an item's score doesn't go with its method; null if it does or there is none."""
    allowed = F.create_map(*(F.lit(x) for pair in SCORE_KINDS.items() for x in pair))
    wanted = F.try_element_at(allowed, method)
    return F.when(~method.isin(METHOD_ORDER), "unknown_method").when(kind.isNull(), None).when(wanted.isNull(), "method_without_score").when(kind != wanted, "other_scale")
