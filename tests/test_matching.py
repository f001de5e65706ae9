"""Matching against brute force and the probes of the similarity score."""

import itertools
import random

from pyspark.sql import functions as F

from conftest import SF
from lookweave.functions.color import color_similarity
from lookweave.operators import matching
from lookweave.plans import bindings, q_matching


def brute(lists):
    """Best assignment by trying everything: most filled, largest sum, earliest candidates."""
    best = None
    for pick in itertools.product(*[range(len(o) + 1) for o in lists]):
        items = [o[i][0] for o, i in zip(lists, pick) if i < len(o)]
        if len(items) != len(set(items)):
            continue
        total = sum(o[i][1] for o, i in zip(lists, pick) if i < len(o))
        key = (len(items), total, [-i for i in pick])
        if best is None or key > best[0]:
            best = (key, list(pick))
    return best[1]


def random_lists(rng, positions, pool):
    out = []
    for _ in range(positions):
        items = rng.sample(range(pool), rng.randint(1, min(4, pool)))
        weights = sorted((rng.choice([400, 500, 600, 700]) for _ in items), reverse=True)
        out.append(list(zip(items, weights)))
    return out


def test_search_equals_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        lists = random_lists(rng, rng.randint(1, 5), rng.randint(1, 6))
        assert matching._best_assignment(lists) == brute(lists)


def test_assignment_of_frames_equals_brute_force(spark):
    """Also with many positions sharing one list, of which only as many as it has items can be served."""
    rng = random.Random(11)
    looks = {look: random_lists(rng, 5, 6) for look in range(25)}
    looks[100] = [[(1, 900), (2, 800)]] * 40 + [[(2, 950), (3, 100)]] * 3
    rows = [(look, pos, item, w / 1000, i + 1) for look, lists in looks.items() for pos, o in enumerate(lists, 1) for i, (item, w) in enumerate(o)]
    ranked = spark.createDataFrame(rows, "look long, pos int, item long, similarity double, rank int")
    got = {}
    for r in matching.assign(ranked).collect():
        got.setdefault(r["look"], set()).add((r["pos"], r["item"]))
    for look, lists in looks.items():
        order = sorted(range(len(lists)), key=lambda i: (len(lists[i]), i))
        if look == 100:  # two lists, three items: 1 and 2 or 3 by the largest sum
            assert got[look] == {(1, 1), (41, 2), (42, 3)}
            continue
        pick = brute([lists[i] for i in order])
        assert got.get(look, set()) == {(i + 1, lists[i][c][0]) for i, c in zip(order, pick) if c < len(lists[i])}


def test_large_look_is_searched_in_parts(spark, monkeypatch):
    """A look of many positions gives the same picks whether it is taken apart or searched as a whole, and one row per part."""
    rng = random.Random(8)
    lists = [[(10 * (p // 4) + i, w) for (i, w) in o] for p, o in enumerate(random_lists(rng, 120, 5))]  # thirty groups of four positions
    rows = [(1, p, i, w / 1000, k + 1) for p, o in enumerate(lists) for k, (i, w) in enumerate(o)] + [(2, 1, 5, 0.9, 1), (2, 2, 5, 0.8, 1)]
    ranked = spark.createDataFrame(rows, "look long, pos int, item long, similarity double, rank int")
    picks = lambda: {(r["look"], r["pos"], r["item"]) for r in matching.assign(ranked).collect()}
    parts, real = [], matching._in_parts
    monkeypatch.setattr(matching, "_in_parts", lambda x: parts.append((out := real(x)).select("look", "part").distinct().count()) or out)
    apart = picks()
    monkeypatch.setattr(matching, "LARGE", 10_000)
    assert apart == picks() and parts[0] >= 25 and parts[1] <= 2


def test_large_look_ends_quickly():
    rng = random.Random(2)
    lists = [sorted(((rng.randrange(120), rng.choice([440, 600, 920])) for _ in range(8)), key=lambda o: -o[1]) for _ in range(600)]
    lists = [list({item: w for item, w in o}.items()) for o in lists]
    picks = matching._best_assignment(lists)
    used = [o[i][0] for o, i in zip(lists, picks) if i < len(o)]
    assert len(used) == len(set(used)) == 120


ITEM = "id long, category string, name string, color string, gender string, user_added boolean, vec long, source_rank int, deleted boolean"
NEED = "look long, pos int, category string, vec long, gender string, colors string, materials string, fits string, details string, sleeve_length string, length string, subcategory string, neckline string"
SHIRT = dict(subcategory="셔츠", material="코튼", texture="평직", fit="레귤러", silhouette="기본", sleeve_length="", length="", neckline="", pattern="무지", finish="무광",
             construction="카라", primary_color="", secondary_colors="")


def wardrobe(spark, items, analyses):
    stored = spark.createDataFrame([(i, *[a[k] for k in matching.ANALYSIS]) for i, a in analyses.items()], "id long, " + ", ".join(f"{k} string" for k in matching.ANALYSIS))
    return matching.with_analysis(spark.createDataFrame(items, ITEM), stored)


def probe(spark, items, analyses, needs, cosines=(), references=()):
    """Scores by look and item of all given pairs."""
    needs = spark.createDataFrame(needs, NEED)
    pairs = spark.createDataFrame([(n["look"], n["pos"], i[0]) for n in needs.collect() for i in items], "look long, pos int, item long")
    got = matching.pair_similarity(pairs, wardrobe(spark, items, analyses), needs, spark.createDataFrame(list(cosines), "vec long, r_vec long, cosine double"),
                                   spark.createDataFrame(list(references), "item long, look long"))
    return {(r["look"], r["item"]): r for r in got.collect()}


def test_score_probes(spark):
    """Exact colour beats a wrong one, an unknown one gets the floor; stored attributes count, not the name; forms have to agree."""
    item = lambda i, name, color, category="상의", added=False, vec=None: (i, category, name, color, "all", added, vec, i, False)
    items = [item(1, "화이트 코튼 셔츠", "화이트"), item(2, "레드 코튼 셔츠", "레드"), item(3, "코튼 셔츠 4 colors", "색상 다양"),
             item(4, "직접 크롭", "레드", added=True, vec=7), item(5, "잘못 분류된 크롭", "화이트", "하의", True, 7), item(6, "혼합 엔진", "화이트", vec=9),
             item(7, "화이트 반팔 티셔츠", "화이트"), item(8, "화이트 긴팔 티셔츠", "화이트"), item(9, "레더 재킷", "화이트"), item(10, "화이트 나시", "화이트")]
    tee = SHIRT | dict(subcategory="티셔츠", construction="")
    analyses = {i: SHIRT for i in (1, 2, 3, 4, 6, 9)} | {5: SHIRT | dict(subcategory="팬츠"), 7: tee | dict(sleeve_length="반팔"), 8: tee | dict(sleeve_length="긴팔")}
    white = (1, 1, "상의", 3, "women", "화이트", "코튼", "레귤러", "셔츠", "", "", "", "")
    short = (2, 1, "상의", None, "women", "화이트", "코튼", "레귤러", "티셔츠", "반팔", "", "티셔츠", "")
    got = probe(spark, items, analyses, [white, short], [(7, 3, 0.0)], [(4, 1), (5, 1)])
    score = {k: r["similarity"] for k, r in got.items()}
    assert score[1, 1] == 0.9 and score[1, 1] > score[1, 2] and score[1, 1] > score[1, 3] and got[1, 3]["color_sim"] == 0.12
    assert score[1, 4] == 0.985 and got[1, 4]["direct"]  # cut from this look: the floor, whatever the picture
    assert score[1, 5] == 0 and not got[1, 5]["compatible"]  # a reference of another category stays out
    assert got[1, 6]["visual"] == 0.5 and got[1, 4]["visual"] == 0.5  # another engine: half marks; cosine 0: half marks as well
    assert score[2, 7] > 0.8 and score[2, 8] == 0 and not got[2, 8]["compatible"]
    assert score[1, 9] == score[1, 1]  # its name says leather jacket, its analysis cotton shirt
    assert score[2, 10] == 0  # not analysed: the sleeve is read off the name


def test_lists_equal_all_pairs(spark):
    """Merged lists against the score of every pair, with ties, near-identical pictures, uploads of other categories and conflicts."""
    rng = random.Random(3)
    analyses, items = {}, []
    for i in range(160):
        items.append((i, rng.choice(["상의", "상의", "하의"]), f"이름{i % 9} {rng.choice(['코튼', '니트', '티셔츠', ''])}", rng.choice(["화이트", "블랙", "레드", "네이비", ""]),
                      rng.choice(["all", "men", "women"]), i % 4 == 0, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), i % 23 == 0))
        if i % 3:
            analyses[i] = SHIRT | dict(material=rng.choice(["코튼", "울", "레더"]), fit=rng.choice(["슬림", "오버핏", ""]), subcategory=rng.choice(["셔츠", "티셔츠", "폴로 셔츠"]),
                                       sleeve_length=rng.choice(["반팔", "긴팔", ""]), secondary_colors=rng.choice(["", "블랙"]))
    needs = [(look, pos, rng.choice(["상의", "하의"]), rng.choice([None, 1, 2]), rng.choice(["men", "women"]), rng.choice(["화이트", "블랙,레드", "없는색", ""]), rng.choice(["코튼", "모직,면", ""]),
              rng.choice(["슬림", "여유", ""]), rng.choice(["셔츠", "카라", ""]), rng.choice(["반팔", ""]), "", rng.choice(["셔츠", "티셔츠", ""]), "") for look in range(12) for pos in range(3)]
    cosines = [(1, 1, 0.999), (2, 1, 0.87), (3, 1, 0.2), (1, 2, -0.5), (2, 2, 0.92), (3, 2, 0.85)]
    references = [(i, i % 12) for i in range(0, 160, 8)]
    by_id = {i[0]: i for i in items}
    want = {}
    for n in needs:
        want[n[0], n[1]] = [i for i, it in by_id.items() if not it[8] and (it[5] or (it[4] in ("all", n[4]) and it[1] == n[2]))]
    every = matching.pair_similarity(spark.createDataFrame([(k[0], k[1], i) for k, rows in want.items() for i in rows], "look long, pos int, item long"), wardrobe(spark, items, analyses),
                                     spark.createDataFrame(needs, NEED), spark.createDataFrame(cosines, "vec long, r_vec long, cosine double"), spark.createDataFrame(references, "item long, look long"))
    lists = {}
    for r in every.collect():
        it = by_id[r["item"]]
        if r["compatible"] and (r["direct"] or r["similarity"] >= .44 or r["visual"] >= .62 or (it[5] and r["similarity"] >= .4)):
            lists.setdefault((r["look"], r["pos"]), []).append((-r["similarity"], -r["color_sim"], not it[5], 999 if it[7] is None else it[7], r["item"]))
    expected = {(k, rank, x[4], -x[0]) for k, rows in lists.items() for rank, x in enumerate(sorted(rows)[:8], 1)}
    got = matching.candidates(wardrobe(spark, items, analyses), spark.createDataFrame(needs, NEED), spark.createDataFrame(cosines, "vec long, r_vec long, cosine double"),
                              spark.createDataFrame(references, "item long, look long"))
    assert {((r["look"], r["pos"]), r["rank"], r["item"], r["similarity"]) for r in got.collect()} == expected and len(expected) > 100


def test_work_follows_the_wishes_not_the_names(spark, monkeypatch):
    """Twice the names: about the same rows in every stage after the items themselves."""
    def stages(names):
        items = [(i, "상의", f"{'가나다라마바사아자차'[i % 10]}{'하파타카'[i // 10 % 4]}{i % names}호 셔츠", ["화이트", "블랙"][i % 2], "all", False, None, 1, False) for i in range(800)]
        needs = [(look, 1, "상의", None, "women", "화이트", ["코튼", "울"][look % 2], "", "셔츠", "", "", "", "") for look in range(20)]
        sizes, real = [], matching.materialize
        monkeypatch.setattr(matching, "materialize", lambda df: sizes.append((out := real(df)).count()) or out)
        both = matching.sides(wardrobe(spark, items, {0: SHIRT}), spark.createDataFrame(needs, NEED))
        before = len(sizes)
        matching.best_lists(both, spark.createDataFrame([], "vec long, r_vec long, cosine double"))
        monkeypatch.setattr(matching, "materialize", real)
        return sizes[before:]
    small, large = stages(200), stages(400)
    assert all(b <= 1.2 * a + 8 for a, b in zip(small, large)) and max(large) < 200


def test_color_similarity(spark):
    row = spark.range(1).select(color_similarity(F.lit("블랙"), F.lit("블랙")).alias("a"), color_similarity(F.lit("블랙"), F.lit("차콜")).alias("b"),
                                color_similarity(F.lit("블랙"), F.lit("화이트")).alias("c"), color_similarity(F.lit("블랙"), F.lit("무엇")).alias("d")).first()
    assert row["a"] == 1.0 and row["a"] > row["b"] > row["c"] and row["d"] == 0.0


def test_pairs_named_by_the_requirements_are_as_given_pairs(spark, monkeypatch):
    read, real = [], bindings.table
    monkeypatch.setattr(bindings, "table", lambda spark, sf, name: read.append(name) or real(spark, sf, name))
    got = q_matching.garment_similarity(spark, SF)
    assert read.count("lineitem") == 2  # the requirements and the references, each once
    needs = bindings.view(spark, SF, "need_v")
    pairs = needs.select("look", "pos", F.col("part").alias("item"))
    given = matching.pair_similarity(pairs, q_matching._items(spark, SF), needs, q_matching.cosines(spark, SF), bindings.view(spark, SF, "ref_v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, given.collect()))
