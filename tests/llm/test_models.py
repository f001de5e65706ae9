"""Language, toxicity and quality: searches against brute force, held-out accuracy, odd inputs."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from lookweave.llm import language, quality, queries, toxicity
from lookweave.llm.common import fold

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "123 !!"), (4, "123 !!"), (None, "word"), (5, "é" * 30_000), (6, "a b " * 30_000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "z", "x", 3) for i, t in ODD], "doc_id long, text string, score string, term string, n int")


# language


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(1)
    for n, k in itertools.product((1, 2, 5, 7), (1, 2, 3)):
        s = -rng.random((n, k)) * 6
        total = lambda path: sum(s[i, p] for i, p in enumerate(path)) - 4 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(k), repeat=n), key=total)
        assert total(language.viterbi(s, 4)) == pytest.approx(total(best))


def test_one_label_is_proved_only_where_it_is_best():
    rng = np.random.default_rng(2)
    proved = 0
    for _ in range(400):
        s = -rng.random((rng.integers(1, 60), 3)) * rng.choice([0.3, 2, 6]) * rng.random(3)
        s -= s.max(axis=1, keepdims=True)
        best = int(np.argmax(s.sum(axis=0)))
        if not language._may_switch(s, best):
            proved += 1
            path = language.viterbi(s)
            value = s[np.arange(len(s)), path].sum() - language.SWITCH * (np.diff(path) != 0).sum()
            assert value <= s[:, best].sum() + 1e-9
    assert proved > 50


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return language.fit(docs, fold(F.col("doc_id"), 5) != 0)


def test_held_out_languages(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id >= 200")
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_mixed_text_has_spans(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 1500")
    parts = {r["lang"]: " ".join(language.words_of(r["text"])[:120]) for r in docs.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    mixed = f"{parts['de']} {parts['fr']} {parts['en']}"
    found = language.spans(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).orderBy("start").collect()
    assert [r["lang"] for r in found] == ["de", "fr", "en"]
    assert abs(found[1]["start"] - len(parts["de"])) < 60


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("привет мир это текст", "ru"), ("hello world this is text", "en")] * 3)]
    learned = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert learned.label("ещё слова zz")[0] == "ru" and learned.label("Zulu")[0] == "en"
    assert learned.label("漢字")[0] in ("en", "ru")  # a script of none rules none out


def test_language_odd_inputs(spark, model):
    got = language.identify(odd(spark), model).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    none = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True))
    assert {r["lang_pred"] for r in language.identify(odd(spark), none).collect()} == {"und"}
    assert language.identify(odd(spark).limit(0), model).count() == 0


# toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_finds_words_at_distance_one():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(3, 8))) for _ in range(40)})
    trie = toxicity.Trie([*terms, "stem*"])
    for _ in range(3000):
        word = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        want = {t for t in terms if len(t) >= toxicity.EDIT_LENGTH and distance(word, t) == 1}
        assert set(trie.close(word)) == want, word
        assert set(trie.exact(word)) == {t for t in terms if t == word}
    assert trie.exact("stemming") == ["stem*"]


def test_quotation_is_told_from_abuse():
    lexicon = toxicity.Lexicon({"idiot": 5.0}, np.array([2.0, 1.0, -1.0, 0.0, 0.5, 0.0, -3.0]))
    abuse, typo, quote = "you are an idiot, really", "you are an idyot, really", 'he wrote "you idiot" in it'
    assert lexicon.score(abuse) > lexicon.score(typo) > lexicon.score("nothing here") > lexicon.score(quote)
    assert toxicity.in_quotes("he said “ bad word ” there".split(), 3) and not toxicity.in_quotes("he said bad word there".split(), 2)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op5_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = ((got["predicted"] == 1) & (got["toxic"] == 1)).sum()
    assert hit / (got["toxic"] == 1).sum() > 0.9 and hit / (got["predicted"] == 1).sum() > 0.9


def test_misspelled_held_out_terms_are_met(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels, held_out = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), fold(F.col("doc_id"), 4) == 2
    lexicon = toxicity.fit(docs, labels, ~held_out)
    for term in ("idiot", "disgusting", "trash", "clown", "pathetic", "worthless", "stupid", "moron", "loser"):
        for at in range(4):
            wrong = [term[:at] + "1" + term[at + 1:], term[:at] + term[at + 1:], term[:at] + "q" + term[at:], term[:at] + term[at + 1] + term[at] + term[at + 2:]]
            assert all(lexicon.match(w) for w in wrong), wrong
    assert lexicon.match("disgustingly")[1] and not lexicon.match("dizgustingly")[1]
    rows = docs.where(held_out).join(labels, "doc_id").where("toxic IN (0, 1)").select("toxic", "text").collect()
    insult = re.compile(r"(?i)\b(i)(d)(iot)|\b(d)(i)(sgust)|\b(t)(r)(ash)|\b(c)(l)(own)|\b(p)(a)(thetic)|\b(w)(o)(rthless)|\b(s)(t)(upid)|\b(m)(o)(ron)|\b(l)(o)(ser)")
    rows = [(r["toxic"], insult.sub(lambda m: m[m.lastindex - 1] + m[m.lastindex - 2] + m[m.lastindex], r["text"] or "")) for r in rows]
    marked = [toxic for toxic, text in rows if lexicon.score(text) >= toxicity.BOUND]
    assert sum(marked) > 0.9 * sum(toxic for toxic, _ in rows) and sum(marked) > 0.9 * len(marked)


def test_stems_and_swaps_allow_one_edit():
    trie = toxicity.Trie(["abcdef*", "vwxyz", "stem*"])
    rng = random.Random(8)
    for _ in range(3000):
        word = list("abcdefgh"[:rng.randint(5, 8)])
        for _ in range(rng.randint(0, 2)):
            word[rng.randrange(len(word))] = rng.choice(["", "a", "c", "xy"])
        word = "".join(word)
        best = min(distance("abcdef", word[:k]) for k in range(len(word) + 1))
        assert trie.close(word) == ["abcdef*"] * (best == 1), word
    assert trie.swapped("bacdefgg") == ["abcdef*"] and trie.swapped("vwyxz") == ["vwxyz"]
    assert trie.swapped("vwyxzz") == trie.swapped("tsem") == trie.swapped("abcdef") == []


def test_toxicity_odd_inputs(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, None), (None, 1), (4, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, lexicon).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] < 0.3 and r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0), F.lit(True))).count() == 0


# quality


def test_thresholds_are_ordered_and_tails_fall():
    rng = np.random.default_rng(4)
    rows, grades = [], []
    for _ in range(300):
        x = rng.normal()
        rows.append((np.array([5, 9], np.int32), np.array([x, 1.0], np.float32)))
        grades.append(int(np.searchsorted([-0.5, 0.5], x + 0.1 * rng.normal())))
    fitted = quality.fit_rows(rows, np.array(grades), 2)
    assert fitted.thresholds[0] < fitted.thresholds[1]
    tails = np.array([fitted.tails(float(fitted.weights[a] @ v)) for a, v in rows])
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert (np.round(tails.sum(axis=1)) == grades).mean() > 0.85


def test_gradient_of_the_likelihood():
    """Steps lower the loss down to what a fine search finds for one weight."""
    rows = [(np.array([1], np.int32), np.array([v], np.float32)) for v in (-1, -0.5, 0.2, 0.4, 1.0, 1.5)]
    grades = np.array([0, 1, 0, 1, 2, 1])

    def loss(w, t):
        p = lambda k, x: 1 / (1 + np.exp(-(t[k] - x))) if 0 <= k < 2 else float(k >= 2)
        return -sum(np.log(p(g, w * v[0]) - p(g - 1, w * v[0])) for (_, v), g in zip(rows, grades))

    fitted = quality.fit_rows(rows, grades, 2, rounds=2000, decay=0)
    got = loss(float(fitted.weights[1]), fitted.thresholds)
    best = min(loss(w, (a, a + d)) for w in np.linspace(-1, 6, 57) for a in np.linspace(-3, 3, 49) for d in np.linspace(0.1, 5, 50))
    assert got <= best + 1e-3


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fitted = quality.fit(docs, labels.where("doc_id % 2 = 0"), queries.rating(), 2)
    got = quality.score(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    chosen = got["tails"].map(lambda t: t[0] >= 0.5)
    assert (chosen == (got["quality"] == 1)).mean() > 0.97


def test_quality_odd_inputs(spark):
    docs, labels = odd(spark), spark.createDataFrame([(1, 1, None), (None, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    fitted = quality.fit(docs, labels, queries.rating(), 2)
    got = quality.score(docs, fitted).collect()
    assert len(got) == len(ODD) and all(0 <= r["expected"] <= 2 for r in got)
    empty = quality.fit(docs.limit(0), labels.limit(0), queries.rating(), 2)
    kept = quality.select(docs, empty)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert quality.select(docs.limit(0), empty).count() == 0


def test_whole_texts_are_read():
    assert quality.features("a" * 3_000_000 + "@@@")[0].size > quality.features("a" * 3_000_000)[0].size
    lexicon = toxicity.Lexicon({"idiot": 5.0}, np.array([2.0, 0, 0, 0, 0, 0, -3.0]))
    assert lexicon.score("word " * 100_000 + "idiot") > lexicon.score("word " * 100_000)
