"""Secret scans: the base patterns as stated, costs against brute force, odd texts."""

import hashlib
import itertools
import random
import re

from lookweave.llm import secretscan


def base(text):
    """The three patterns word for word: leftmost matches, the failing ones dropped."""
    kinds = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
             ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16)]
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, flags, ok) in enumerate(kinds) for m in re.finditer(p, text, flags) if ok(m)]
    return [s for _, _, s in sorted(found)]


def test_base_spans():
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", " ", "=", ": ", '"', "AKIA", "ABCDEF0123456789XY", "deadbeef0123456789", "x", "é", "𝒳", "\n", "secret", "abcdefghijklmnop", "a1"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        found = secretscan.scan_text(text)
        want = base(text)
        counts = [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]
        row = found.row()
        assert list(row[:3]) == counts and row[3] == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = row[4].split(",") if row[4] else []
        assert [s for s in spans if not s.startswith("guess")] == want


def segment_bits(s):
    """Cost of a string as one segment, from the definitions."""
    options = []
    if len(s) == 1:
        options.append(secretscan._letter_bits(s))
    rank = secretscan._RANK.get(s.lower().translate(secretscan._LEET)) if len(s) >= 3 else None
    if rank is not None:
        options.append(1 + rank + 2 * (s.lower() != s.lower().translate(secretscan._LEET)) + 2 * (s != s.lower()))
    if len(s) >= 3 and all(p in secretscan._BESIDE for p in zip(s.lower(), s.lower()[1:])):
        options.append(1 + secretscan.log2(47) + secretscan.log2(len(s)) + 1)
    for size in range(1, len(s)):
        if len(s) >= 3 and len(s) % size == 0 and s == s[:size] * (len(s) // size):
            options.append(1 + sum(map(secretscan._letter_bits, s[:size])) + secretscan.log2(len(s) // size))
    if secretscan._DATE.fullmatch(s):
        options.append(1 + secretscan.log2(365 * 120))
    return min(options, default=float("inf"))


def test_costs_are_those_of_the_best_segmentation():
    rng = random.Random(7)
    for _ in range(150):
        value = "".join(rng.choices(["admin", "P4ss", "qwe", "12", "zz", "2024", "x", "K", "#"], k=rng.randint(1, 3)))[:9]
        best = float("inf")
        for cuts in itertools.product((0, 1), repeat=len(value) - 1):
            pieces, start = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    pieces.append(value[start:i])
                    start = i
            best = min(best, sum(map(segment_bits, [*pieces, value[start:]])))
        # a date is taken as far as it goes from a place, so a shorter one may be missed
        assert best - 1e-9 <= secretscan.guess_bits(value) <= best + 16, value


def test_hard_values_in_context_are_added():
    assert secretscan.scan_text("my password is x9$Kq2!vZp8w ok").row()[4] == "guess:15:27"
    assert secretscan.scan_text("my password is password123 ok").more == []
    assert secretscan.scan_text("the value x9$Kq2!vZp8w alone").more == []
    assert secretscan.scan_text("password=abcdefghijklm1").more == []  # a base span already


def test_rows(spark):
    data = [(1, None), (2, ""), (3, "z" * 100_000 + " token: abcdefabcdef99"), (3, "z" * 100_000 + " token: abcdefabcdef99"), (None, "AKIA" + "A" * 20)]
    got = secretscan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got] == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 0), (3, 1, 0, 0), (None, 0, 1, 0)]
    assert got[2]["spans"] == "assign:100001:100022" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert secretscan.scan(spark.createDataFrame([], "doc_id long, text string, spans string")).count() == 0


def test_values_of_one_class_are_priced():
    for value in ("qXvTzLkRbNmWcYpD", "kjqzxvwtrplm", "8305926174038"):
        assert secretscan.scan_text(f"my password is {value} ok").row()[4] == f"guess:15:{15 + len(value)}"
    assert secretscan.scan_text("my password is 12345678901234 aaaaaaaaaaaaaaaa").more == []


def test_words_of_the_documents_are_cheap_and_secrets_are_no_words(spark):
    data = [(i, "a non negotiable matter; token is kjqzxvwtrplm") for i in range(8)] + [(9, "the token is non-negotiable")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    ranks = secretscan.word_ranks(docs)
    assert "negotiable" in ranks and "kjqzxvwtrplm" not in ranks
    got = {r["doc_id"]: r["spans"] for r in secretscan.scan(docs).collect()}
    assert got[9] == "" and got[0] == "guess:34:46"


def test_long_values_are_read_to_their_end():
    rng = random.Random(9)
    value = "".join(rng.choices("ghijkmXYZ0123456789-_", k=900))
    assert secretscan.scan_text(f"credentials: {value} end").row()[4] == "guess:13:913"
    late = "z" * 200 + "x9$Kq2!vZp8w"
    assert secretscan.scan_text(f"pwd = {late}").row()[4] == f"guess:6:{6 + len(late)}"
    assert secretscan.scan_text("pwd = " + "ab1" * 20_000).more == []
    assert secretscan.guess_bits("ab1" * 20_000) < 40


def test_an_early_stop_is_below_the_whole_cost():
    rng = random.Random(10)
    for _ in range(300):
        value = "".join(rng.choices(["admin", "qwe", "zzzzzz", "2024", "x", "K9"], k=rng.randint(1, 30)))
        whole, early = secretscan.guess_bits(value), secretscan.guess_bits(value, enough=40)
        assert early == whole if whole < 40 else 40 <= early <= whole


def test_a_value_that_outgrows_its_base_span_is_added():
    assert secretscan.scan_text("secret = abcDEF123456$%^&*xyz").row()[4] == "assign:0:21,guess:9:29"
    assert secretscan.scan_text("pwd: Zq$0123456789abcdef!Kw").row()[4] == "guess:5:27,hex:8:24"
