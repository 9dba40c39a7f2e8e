"""Grounded answers and graph requests: every way to be refused, and the one to pass."""

from __future__ import annotations

import json

import pytest

from plumbline.operators import answers as A

PACK = {"version": "1", "items": ["The wall is made of granite blocks."], "aggregates": [{"3": 12}]}


def say(**data):
    return lambda messages: json.dumps(data)


def claim(**c):
    return say(status="answer", claims=[{"text": "It is granite.", "ref": "E001", "quote": "made of GRANITE"} | c])


def test_supported_claims_pass():
    out = A.grounded_answer(PACK, "?", say(status="answer", claims=[{"text": "Granite.", "ref": "E001", "quote": "made of  granite"}, {"text": "Twelve.", "ref": "A001", "key": "3", "count": 12}]))
    assert out.reason is None and out.citations == ["E001", "A001"] and out.text == "Granite. [E001]\nTwelve. [A001]" and out.calls == 1


@pytest.mark.parametrize(
    ("pack", "model", "reason"),
    [
        (None, claim(), "no_pack"),
        ({"version": "0"}, claim(), "unsupported_pack_version"),
        ({"version": "1"}, claim(), "no_evidence"),
        ({"version": "1", "items": [" "]}, claim(), "no_usable_content"),
        ({"version": "1", "items": ["x" * 300_000]}, claim(), "projection_too_large"),
        (PACK, lambda m: 1 / 0, "provider_unavailable"),
        (PACK, lambda m: "{", "malformed_output"),
        (PACK, lambda m: "x" * 100_000, "output_too_large"),
        (PACK, say(status="answer", claims=[]), "no_claims"),
        (PACK, say(status="answer", claims=[{"text": "a"}]), "schema_violation"),
        (PACK, say(status="maybe"), "schema_violation"),
        (PACK, say(status="abstain", abstain_reason="insufficient_evidence"), "model_abstained"),
        (PACK, claim(ref="E009"), "unknown_reference"),
        (PACK, claim(quote="made of marble"), "quote_not_found"),
        (PACK, claim(quote="granite"), "quote_not_found"),
        (PACK, say(status="answer", claims=[{"text": "a", "ref": "A001", "key": "3", "count": 11}]), "aggregate_mismatch"),
        (PACK, say(status="answer", claims=[{"text": "a", "ref": "A001", "key": "3", "count": True}]), "schema_violation"),
    ],
)
def test_refusals(pack, model, reason):
    out = A.grounded_answer(pack, "?", model)
    assert out.reason == reason and out.text == A.message(reason) and not out.citations


def test_spatial_terms():
    assert A.term_request("o que está acima da porta") == (["ABOVE"], "forward")
    assert A.term_request("perto da porta") == "unsupported_term" and A.term_request("porta") == "unsupported_intent"


def test_graph_requests(spark):
    e = spark.createDataFrame([("a", "b", "CONTAINS", "1"), ("b", "c", "HAS_TYPE", "2")], "src string, dst string, predicate string, edge_id string")
    node = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    outcome, paths = A.graph_answer(e, node("a"), "descendants", depth=2)
    assert outcome == "paths" and [r["node"] for r in paths.collect()] == ["b"]
    assert A.graph_answer(e, node("c"), "descendants")[0] == "no_paths"
    assert A.graph_answer(e, node("a", "b"), "neighbors")[0] == "anchor_ambiguous"
    assert A.graph_answer(e, node(), "neighbors")[0] == "no_anchor"
    assert A.graph_answer(e, node("a"), "ancestors")[0] == "unsupported_intent"


def test_residency():
    assert A.release_order({"a": 5, "b": 9, "c": 1}, {"c"}, {"c": 1, "d": 4, "e": 2}, 8) == [("release", "b"), ("release", "a"), ("acquire", "e"), ("acquire", "d")]
    with pytest.raises(ValueError):
        A.release_order({}, set(), {"d": 9}, 8)


def test_command_line(spark, tmp_path, capsys):
    from plumbline import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"element_id":"1","name":"x"}\n{"element_id":"2"}\n')
    root = f"file://{tmp_path}/store"
    (tmp_path / "store").mkdir()
    assert cli.main(["validate", "element", str(tmp_path / "in")]) == 0
    assert cli.main(["ingest", "element", str(tmp_path / "in"), "--root", root, "--alias", "t", "--version", "1"]) == 0
    assert cli.main(["promote", "--root", root, "--alias", "t", "--version", "1"]) == 0
    assert cli.main(["rollback", "--root", root, "--alias", "t"]) == 1
    assert cli.main(["status", "--root", root]) == 0
    assert '"target": "t_v1"' in capsys.readouterr().out
    (tmp_path / "in/b.json").write_text("{bad\n")
    assert cli.main(["validate", "element", str(tmp_path / "in")]) == 1
