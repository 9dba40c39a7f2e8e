"""Grounded answers and graph requests: one call of an injected model, checked strictly.

Both work on a pack of at most a few hundred items on the driver; nothing here
touches a cluster but the final walk of a graph request.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from plumbline.functions.text import query_form

from .evidence import MOST_REFERENCES, quote_holds
from .graph import MAX_DEPTH, ranked_paths, validated, walks

OUTPUT_BYTES, PROJECTION_BYTES = 64 << 10, 256 << 10
PACK_VERSION = "1"
# What is said for each kind of reason.
NO_RESULTS = "Não encontrei elementos que correspondam à sua pesquisa no modelo BIM."
NO_EVIDENCE = "Não encontrei evidência suficiente no modelo BIM para responder com fiabilidade."
UNAVAILABLE = "Não consegui gerar uma resposta fundamentada nesta evidência. Tente reformular a pergunta."
MODEL_REASONS = ("insufficient_evidence", "out_of_scope")


class Refused(Exception):
    """A draft that may not be shown; ``reason`` is one of the closed codes."""

    def __init__(self, reason: str) -> None:
        super().__init__(reason)
        self.reason = reason


@dataclass
class Outcome:
    """An answer with its citations, or the reason there is none."""

    text: str
    reason: str | None = None
    citations: list[str] = field(default_factory=list)
    calls: int = 0


def message(reason: str) -> str:
    if reason in ("no_pack", "no_evidence", "no_usable_content"):
        return NO_RESULTS
    return NO_EVIDENCE if reason == "model_abstained" else UNAVAILABLE


def parse_draft(raw: str) -> list[dict]:
    """The claims of a draft: text with a quote, or an aggregate key and count, and a reference."""
    if len(raw.encode()) > OUTPUT_BYTES:
        raise Refused("output_too_large")
    try:
        data = json.loads(raw)
    except ValueError:
        raise Refused("malformed_output") from None
    if not isinstance(data, dict) or not set(data) <= {"status", "claims", "abstain_reason"} or data.get("status") not in ("answer", "abstain"):
        raise Refused("schema_violation")
    if data["status"] == "abstain":
        raise Refused("model_abstained" if data.get("abstain_reason") in MODEL_REASONS else "schema_violation")
    claims = data.get("claims")
    if not isinstance(claims, list) or data.get("abstain_reason") is not None:
        raise Refused("schema_violation")
    if not claims:
        raise Refused("no_claims")
    for c in claims:
        known = isinstance(c, dict) and set(c) in ({"text", "ref", "quote"}, {"text", "ref", "key", "count"})
        if not known or not all(isinstance(c[k], str) and c[k].strip() for k in c if k != "count") or ("count" in c and type(c["count"]) is not int):
            raise Refused("schema_violation")
    return claims


def check_claims(claims: list[dict], items: dict[str, str], aggregates: dict[str, dict[str, int]]) -> None:
    """One claim that doesn't hold refuses the whole draft."""
    for c in claims:
        if "quote" in c:
            if c["ref"] not in items:
                raise Refused("unknown_reference")
            if not quote_holds(c["quote"], items[c["ref"]]):
                raise Refused("quote_not_found")
        else:
            if c["ref"] not in aggregates:
                raise Refused("unknown_reference")
            if aggregates[c["ref"]].get(c["key"]) != c["count"]:
                raise Refused("aggregate_mismatch")


def grounded_answer(pack: dict | None, question: str, complete: Callable[[list[dict]], str]) -> Outcome:
    """Never raises, and calls the model once at most.

    pack: version, items (contents in order) and aggregates (bucket dicts in order).
    """
    calls = 0
    try:
        if pack is None:
            raise Refused("no_pack")
        if pack.get("version") != PACK_VERSION:
            raise Refused("unsupported_pack_version")
        if not pack.get("items") and not pack.get("aggregates"):
            raise Refused("no_evidence")
        items = {f"E{i:03d}": t for i, t in enumerate(pack.get("items", [])[:MOST_REFERENCES], 1) if t and t.strip()}
        aggregates = {f"A{i:03d}": b for i, b in enumerate(pack.get("aggregates", [])[:MOST_REFERENCES], 1) if b}
        if not items and not aggregates:
            raise Refused("no_usable_content")
        shown = json.dumps({"question": question, "items": items, "aggregates": aggregates}, sort_keys=True, ensure_ascii=False)
        if len(shown.encode()) > PROJECTION_BYTES:
            raise Refused("projection_too_large")
        calls = 1
        try:
            raw = complete([{"role": "system", "content": "Answer from the evidence alone, as JSON."}, {"role": "user", "content": shown}])
        except NotImplementedError:
            raise Refused("response_format_unsupported") from None
        except Exception:
            raise Refused("provider_unavailable") from None
        claims = parse_draft(raw)
        check_claims(claims, items, aggregates)
        return Outcome("\n".join(f"{c['text'].strip()} [{c['ref']}]" for c in claims), None, list(dict.fromkeys(c["ref"] for c in claims)), calls)
    except Refused as r:
        return Outcome(message(r.reason), r.reason, [], calls)


# ------------------------------------------------------------------ graph requests

# Predicates and direction of each spatial term, and terms that have none.
_PLACES = ["HAS_SITE", "HAS_BUILDING", "HAS_STOREY", "HAS_SPACE", "CONTAINS"]
SPATIAL_TERMS = {
    "acima": (["ABOVE"], "forward"),
    "abaixo": (["ABOVE"], "reverse"),
    "dentro": (_PLACES, "reverse"),
    "esta em": (_PLACES, "reverse"),
    "contem": (_PLACES, "forward"),
    "ligado a": (["CONNECTS_TO", "CONNECTS_PORT"], "forward"),
    "pertence a": (["MEMBER_OF_GROUP", "MEMBER_OF_SYSTEM"], "forward"),
}
REFUSED_TERMS = {
    "adjacente": "boxes that touch need not be adjacent",
    "perto": "no metric or threshold is documented",
    "suporta": "no predicate",
    "abre para": "no predicate",
    "comunica com": "no predicate",
}


def term_request(question: str) -> tuple[list[str], str] | str:
    """Predicates and direction of the spatial term of a question, or an outcome code."""
    padded = f" {query_form(question)} "
    for term, request in SPATIAL_TERMS.items():
        if f" {term} " in padded:
            return request
    return "unsupported_term" if any(f" {t} " in padded for t in REFUSED_TERMS) else "unsupported_intent"


def graph_answer(edges: DataFrame, anchors: DataFrame, intent: str, predicates: list[str] | None = None, direction: str = "forward", depth: int = 1) -> tuple[str, DataFrame | None]:
    """(outcome, paths) of a graph request from resolved anchors (node)."""
    found = anchors.take(2)
    if not found:
        return "no_anchor", None
    if len(found) > 1:
        return "anchor_ambiguous", None
    try:
        chosen = validated(intent, predicates, direction, depth if depth <= MAX_DEPTH else 0)
    except (KeyError, ValueError):
        return "unsupported_intent", None
    paths = ranked_paths(walks(edges.where(edges["predicate"].isin(chosen)), anchors, depth, direction))
    return ("no_paths", None) if paths.isEmpty() else ("paths", paths)


def release_order(accounted: dict[str, int], members: set[str], wanted: dict[str, int], budget: int) -> list[tuple[str, str]]:
    """Steps of a residency change: non-members go first, the largest first, then the
    wanted ones come, the smallest first; over the budget is an error, told before any step."""
    have = dict(accounted)
    steps = [("release", k) for k in sorted((k for k in have if k not in members), key=lambda k: (-have[k], k))]
    for _, k in steps:
        have.pop(k)
    for k in sorted((k for k in wanted if k not in have), key=lambda k: (wanted[k], k)):
        have[k] = wanted[k]
        if sum(have.values()) > budget:
            raise ValueError(f"{k} does not fit")
        steps.append(("acquire", k))
    return steps
