"""Router and parser on questions, table-driven."""

from __future__ import annotations

import pytest

from plumbline.operators import language as L
from plumbline.operators import questions as Q


@pytest.mark.parametrize(
    ("question", "route"),
    [
        ("Mostra 2O2Fr$t4X7Zf8NOew3FLOH", "exact_lookup"),
        ("Quantas paredes existem?", "aggregation"),
        ("Paredes de BETÃO", "structured"),
        ("algo com 3,5 m", "structured"),
        ("o que é adjacente ao átrio", "graph"),
        ("uma fotografia do capitel", "multimodal"),
        ("o relatório menciona obras", "document_hybrid"),
        ("Olá", "chat"),
        ("conforto térmico", "hybrid_semantic"),
        ("portanto", "hybrid_semantic"),
    ],
)
def test_routes(spark, question, route):
    df = spark.createDataFrame([(question,)], "q string")
    assert L.routed(df, "q").first()["routing"]["route"] == route


def test_previous_results_and_images(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("detalha o primeiro",)], "q string")
    assert L.routed(df, "q", previous=F.lit(True)).first()["routing"]["reason"] == "previous_result"
    df = spark.createDataFrame([("isto",), (None,)], "q string")
    rows = L.routed(df, "q", image=F.lit(True)).collect()
    assert rows[0]["routing"]["reason"] == "image_input"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("paredes com altura maior que 3 m", [("height", "gt", 3.0)]),
        ("espessura de pelo menos 30 cm", [("thickness", "gte", 0.3)]),
        ("entre 2 e 4 metros", [("height", "gte", 2.0), ("height", "lte", 4.0)]),
        ("mais de 10 m2", [("area", "gt", 10.0)]),
        ("menos de 5 de volume", [("volume", "lt", 5.0)]),
        ("2,5 m3 de volume", [("volume", "approx", 2.5)]),
        ("cerca de 7 mm", [("height", "approx", 0.007)]),
        ("altura maior que 3 m2", []),
        ("comprimento de 3 m", []),
        ("9" * 400 + " metros", []),
        ("largura igual a 1 m e largura igual a 1 m", [("thickness", "eq", 1.0)]),
    ],
)
def test_conditions(text, want):
    assert L.conditions(text) == want


def asked(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, q string")
    return [r["asked"] for r in Q.asked(df, "q").orderBy("k").collect()]


def test_storeys(spark):
    want = {
        "piso 03": "3", "2.º andar": "2", "segundo piso": "2", "piso L0": "L0", "no rés-do-chão": "0", "na cave": "-1", "nada": None, "piso -1": "-1", "piso-1": None, "andar 2a": None, "nível 007": "7", "3o piso": "3", "o 4 .o nivel": "4",
        "piso décimo": "10", "storey b2": "B2", "décimo storey": None, "r/c ou cave": "0", "terreo": "0", "res do chao": "0", "cave do piso 5": "5", "andar -0": "0", "": None, "piso": None, "escavem": None,
    }
    assert [r["storey"] for r in asked(spark, *want)] == list(want.values())


def test_fields(spark):
    want = {
        "quantos por piso": "storey", "quantas portas": "count", "identificador do projecto": "project_id", "código de projeto": "project_id", "codigo projeto": "project_id", "identificador projeto": None, "project id": "project_id", "Project_ID?": "project_id",
        "quais são os meus projetos": "project", "que modelos": "project", "quais as minhas projectos e materiais": "project", "quais meus os projetos": None, "quantos projetos": "project", "pisos e materiais": "material", "tipos de classificação": "classification",
        "as classes por andar": "storey", "número de coisas": "count", "numero coisas": None, "portas": None, "": None,
    }
    assert [r["agg_field"] for r in asked(spark, *want)] == list(want.values())


def test_names(spark):
    want = {
        "projeto Casa Azul com portas": (None, None, "Casa Azul"), 'mostra "Porta A"': ("Porta A", None, None), "project_id AB_12 e W_01": ("W_01", "AB_12", None), "id projeto nada": (None, None, None), "modelo Torre, piso 2": (None, None, "Torre"), "o projeto.": (None, None, None),
        "código do projecto: X-9": (None, "X-9", None), "W_02 no projeto Casa_3 Z_1": ("W_02", None, "Casa_3 Z_1"), "«Sala 3» e 'x'": ("Sala 3", None, None), "2O2Fr_t4X7Zf8NOew3FLOH e a_b": ("a_b", None, None), "_x 9_a": (None, None, None), "project-id Z9": (None, "Z9", None), "": (None, None, None),
    }
    got = {t: (r["name"], r["project_id"], r["project_name"]) for t, r in zip(want, asked(spark, *want), strict=True)}
    assert {t: g for t, g in got.items() if g != want[t]} == {}


def test_classes_and_ordinals(spark):
    assert L.class_of("a janela da parede") == "IfcWindow"
    assert L.class_of("fachada cortina") == "IfcCurtainWall"
    assert L.class_of("IfcBeam") == "IfcBeam"
    assert L.materials_of("tijolos e betões") == ["betao", "tijolo"]
    assert L.detail_ordinal("o segundo", 5) == 2 and L.detail_ordinal("o último", 5) == 5 and L.detail_ordinal("mais", 5) == 1
    assert L.strategy("exact_lookup") == ("structured", True)


def test_parser_column(spark):
    a, b = asked(spark, "quantas portas de madeira no piso 2 com altura maior que 2 m?", None)
    assert (a["ifc_class"], a["materials"], a["storey"], a["agg_field"]) == ("IfcDoor", ["madeira"], "2", "count")
    assert [tuple(c) for c in a["conditions"]] == [("height", "gt", 2.0)] and b is None
