"""Layer order on hand-written outfits."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF

from lookweave import dims
from lookweave.functions.text import lookup
from lookweave.operators import layering

CASES = [
    ([("하의", "코튼 드로즈"), ("하의", "차콜 슬랙스"), ("상의", "화이트 셔츠")], ["코튼 드로즈", "차콜 슬랙스", "화이트 셔츠"]),
    ([("신발", "화이트 스니커즈"), ("액세서리", "크루 양말")], ["크루 양말", "화이트 스니커즈"]),
    ([("아우터", "블레이저"), ("액세서리", "가죽 벨트"), ("상의", "셔츠"), ("하의", "슬랙스")], ["슬랙스", "셔츠", "가죽 벨트", "블레이저"]),
    ([("상의", "셔츠"), ("상의", "니트")], ["셔츠"]),
    ([("원피스", "롱 드레스"), ("상의", "셔츠"), ("하의", "치마")], ["롱 드레스"]),
    ([("하의", "브라운 드로즈"), ("상의", "브라운 자켓")], ["브라운 드로즈", "브라운 자켓"]),
    ([("액세서리", "안경"), ("액세서리", "시계"), ("액세서리", "모자")], ["시계", "안경", "모자"]),
    ([("액세서리", f"반지 {i}") for i in range(8)], [f"반지 {i}" for i in range(6)]),
]


@pytest.fixture(scope="module")
def placed(spark):
    rows = [(i, pos, cat, name) for i, (items, _) in enumerate(CASES) for pos, (cat, name) in enumerate(items)]
    frame = spark.createDataFrame(rows, "look long, pos int, category string, name string").withColumn(
        "slot", lookup(F.col("category"), dims.CATEGORY_SLOT, "unknown"))
    return layering.order_outfits(frame, "look", "pos", ["name"]).orderBy("look", "place").collect()


@pytest.mark.parametrize("case", range(len(CASES)))
def test_order(placed, case):
    assert [r["name"] for r in placed if r["look"] == case] == CASES[case][1]


def test_underwear_slots(spark):
    frame = spark.createDataFrame([("upper", "브라운 자켓"), ("lower", "브라운 드로즈"), ("bag", "트렁크 캐리어"), ("accessory", "속옷")], "slot string, name string")
    out = {r["name"]: (r["underwear"], r["body_slot"]) for r in layering.add_layers(frame).collect()}
    assert out == {"브라운 자켓": (False, "torso"), "브라운 드로즈": (True, "underwear-legs"), "트렁크 캐리어": (False, "carried"),
                   "속옷": (True, "underwear-accessory")}


def test_dropped_items_are_those_without_a_place(spark):
    rng = random.Random(3)
    rows = [(look, pos, rng.choice(["upper", "outer", "lower", "overall", "shoes", "bag", "accessory", "accessory", "unknown", None]), rng.choice(["볼캡", "크루 양말", "니트", "드로즈", None]))
            for look in range(60) for pos in range(1, rng.randint(2, 16))]
    frame = spark.createDataFrame(rows, "look long, pos int, slot string, name string")
    worn = {(r["look"], r["pos"]) for r in layering.order_outfits(frame, "look", "pos", ["name"]).collect()}
    dropped = [(r["look"], r["pos"]) for r in layering.dropped_items(frame, "look", "pos", ["name"]).collect()]
    assert len(dropped) == len(set(dropped)) and worn and dropped
    assert set(dropped) | worn == {r[:2] for r in rows} and not set(dropped) & worn


def test_places_are_found_without_joins_or_aggregates_over_rows(spark):
    for name in ("dropped_items", "layer_order"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and "Aggregate" not in plan, name
