"""Packing: token ids against the tokenizer itself, the layout, and the planner."""

import random
import zlib

import numpy as np
import pytest

from lookweave.llm import packing

TEXTS = [None, "", "  \n\t", "Hello, World.. it's fine!! ÉCOLE, İstanbul. ΣΑΣ, ok.,x 12345", "e\u0301a, \u00a0b\x1cc\u2003d. <|endoftext|> <|startoftext|>,", "word*** a. b, c.\nd,", "x" * 5000, "don't, we'll. 3,5. »q«, ñ. é,"]


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.vocabulary_path())
    model.encode_special_tokens = True
    return model


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, piece string")


def test_ids_are_the_tokenizers(model):
    rng = random.Random(3)
    alphabet = "ab cD.,'s!? \n\téÜ\u0301\u00a0»1"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(300)]
    want = [model.encode(t or "", add_special_tokens=False).ids for t in texts]
    words = packing.WordEncoder(packing.vocabulary_path())
    for step in (1, 7, 400):
        got = []
        for at in range(0, len(texts), step):
            ids, ends = words.encode([None if t is None else t.encode() for t in texts[at:at + step]])
            got += [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == want


def test_full_tables_start_anew(model, monkeypatch):
    monkeypatch.setattr(packing, "SLOTS", 128)
    monkeypatch.setattr(packing, "KNOWN", 64)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abc,.", k=rng.randint(1, 4))) for _ in range(8)) for _ in range(60)]
    texts.append(" ".join(texts))
    words = packing.WordEncoder(packing.vocabulary_path())
    ids, ends = words.encode([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_layout(spark, model):
    texts = TEXTS + ["lorem ipsum " * n for n in (1, 2, 700, 1024, 5000)] + ["same"] * 9
    got = packing.pack(documents(spark, texts)).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for doc, rows in got.sort_values("piece").groupby("doc_id"):
        ids = model.encode(texts[doc] or "", add_special_tokens=False).ids + [0]
        assert rows["length"].sum() == len(ids) and (rows["length"].iloc[:-1] == 2048).all()
        for r in rows.itertuples():
            assert zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == (rows["length"].cumsum() - rows["length"]).tolist() and rows["length"].sum() <= 2048


def test_empty_table_and_repeated_rows(spark):
    assert packing.pack(documents(spark, [])).count() == 0
    rows = documents(spark, ["a b"]).union(documents(spark, ["a b"]))
    got = packing.pack(rows).toPandas()
    assert len(got) == 2 and got["sequence_id"].nunique() == 1 and sorted(got["offset"]) == [0, 3]


def test_fullest_combination_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(1, 25)
        counts = {rng.randint(1, 25): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
        chosen = packing.fullest(counts, capacity)
        assert sum(k * c for k, c in chosen) == max(sums) and all(c <= counts[k] for k, c in chosen)


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    histogram = {k: rng.randint(0, 60) for k in range(1, 65)}
    bins = {}
    seen = {}
    for length, first, pieces, copies, start, offset in packing.plan(histogram, 64):
        assert first == seen.get(length, 0)
        seen[length] = first + pieces
        for q in range(pieces):
            bins.setdefault(start + q // copies, []).append((offset + q % copies * length, length))
    assert seen == {k: n for k, n in histogram.items() if n}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 64
    room = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= length), None)
        if at is None:
            room.append(64 - length)
        else:
            room[at] -= length
    assert len(bins) <= len(room)  # no worse than first fit decreasing


def test_few_words_are_encodings_at_a_time(model):
    """An encoding holds many times its word's ids, and a slice may have any number of new words."""
    words, sizes = packing.WordEncoder(packing.vocabulary_path()), []

    class Counted:
        def encode_batch_fast(self, some, **how):
            sizes.append(len(some))
            return model.encode_batch_fast(some, **how)

    words.model = Counted()
    text = " ".join(f"word{i}." for i in range(9000))
    ids, ends = words.encode([text.encode()])
    assert ids.tolist() == model.encode(text, add_special_tokens=False).ids and ends.tolist() == [len(ids)]
    assert sum(sizes) >= 9000 and max(sizes) <= 2048
