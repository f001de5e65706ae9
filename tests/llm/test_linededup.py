"""Line dedup against comparing every line with all earlier ones."""

import random

from lookweave.llm import common, linededup


def brute(texts, percent=80):
    seen, gone = [], set()
    for doc, text in enumerate(texts):
        for i, line in enumerate((text or "").split("\n")):
            w = frozenset(line.encode().lower().split())
            if w:
                if any(100 * len(w & v) >= percent * len(w | v) for v in seen):
                    gone.add((doc, i))
                seen.append(w)
    return gone


def corpus(rng, lines=120):
    words = [f"w{min(int(rng.expovariate(0.02)), 300)}" for _ in range(300)]
    made, texts = ["Common line of all, here.", "", "  ", "a", "a b c d", "a b c d e"], [None, ""]
    for _ in range(lines):
        if rng.random() < 0.5 and len(made) > 8:
            line = rng.choice(made).split() or ["x"]
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice(words)
            made.append(" ".join(line))
        else:
            made.append(" ".join(rng.choices(words, k=rng.randint(1, 40))))
    for _ in range(40):
        texts.append("\n".join(rng.choices(made, k=rng.randint(1, 6))))
    return texts


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, key string, line int, n_chars long")


def removed(docs):
    return {(r["doc"], r["line"]) for r in linededup.removed_lines(docs, linededup.first_lines(docs)).collect()}


def test_removed_lines(spark):
    texts = corpus(random.Random(7))
    assert removed(rows(spark, texts)) == brute(texts)


def test_split_lists_and_second_pass(spark, monkeypatch):
    """Lists in cells, and more earlier lines on a token than the first pass takes."""
    monkeypatch.setattr(linededup, "LIST", 4)
    monkeypatch.setattr(linededup, "FIRST", 1)
    rng = random.Random(8)
    common = [f"c{i}" for i in range(12)]
    texts = ["\n".join(" ".join(rng.sample(common, rng.randint(4, 10))) for _ in range(4)) for _ in range(30)]
    assert removed(rows(spark, texts)) == brute(texts)


def test_documents_without_their_lines(spark):
    texts = ["one two three\nfour five", "four five\nsix seven\n", "one two three", None, "", "x y z\nFour  five"]
    docs = rows(spark, texts)
    got = {r["doc_id"]: r for r in linededup.drop_lines(docs, linededup.first_lines(docs), "n_chars").collect()}
    assert {k: r["text"] for k, r in got.items()} == {0: texts[0], 1: "six seven\n", 3: None, 4: "", 5: "x y z"}
    assert got[1]["n_chars"] == 10 and got[3]["n_chars"] == 0 and got[0]["line"] == 1 and got[0]["key"] == "x"


def test_empty_table_and_missing_ids(spark):
    assert removed(rows(spark, [])) == set()
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    assert removed(docs) == {(linededup.LARGEST, 0)}


def test_dropped_lines_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one line of words\nother", 5, "a", [1], 2), (2, "one line of words", 6, "b", [2], 3)], "doc_id long, text string, __doc int, __KEPT string, kept array<int>, n_chars long")
    got = linededup.drop_lines(docs, linededup.first_lines(docs), "n_chars")
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(1, "one line of words\nother", 5, "a", [1], 2)]


def test_words_are_hashed_as_they_are_split():
    rng, seen = random.Random(9), {}
    for _ in range(300):
        texts = [None if rng.random() < 0.1 else bytes(rng.choices(b"aB \n\t\v\f\r\0\x1c\xc3\xa9", k=rng.choice((0, 1, 5, 90)))) for _ in range(rng.randint(0, 4))]
        texts.append(b"L" * rng.randint(60, 70) + b" " + b"l" * 64)
        lines = [line.lower().split() for t in texts for line in (t or b"").split(b"\n")]
        hashes, counts = common.line_words(texts)
        assert counts.tolist() == [len(line) for line in lines] == common.word_counts(texts).tolist()
        words = [w for line in lines for w in line]
        assert len(hashes) == len(words) and all(seen.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(seen.values())) == len(seen)


def test_long_lines(spark):
    """Sketches of 64 and of 128 places, lines on both sides of the border."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    made = [rng.sample(words, rng.randint(50, 150)) for _ in range(25)]
    for _ in range(75):
        line = list(rng.choice(made))
        for _ in range(rng.randint(1, len(line) // 6)):
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            else:
                line.pop()
        made.append(line)
    texts = ["\n".join(map(" ".join, made[at:at + 4])) for at in range(0, len(made), 4)]
    want = brute(texts)
    assert 10 < len(want) < 75 and removed(rows(spark, texts)) == want


def test_postings_travel_together(spark, monkeypatch):
    """Rows that are dealt out by token are far fewer than the lines."""
    rng, dealt = random.Random(11), []
    words = [f"w{i}" for i in range(3000)]
    texts = ["\n".join(" ".join(rng.sample(words, 40)) for _ in range(10)) for _ in range(200)]
    docs = rows(spark, texts)
    plain = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, *by: (dealt.append(self.count()), plain(self, *by))[1])
    linededup.first_lines(docs)
    assert dealt and sum(dealt) < 2000
