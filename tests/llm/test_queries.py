"""The registered queries: names, columns, SQL twins; and the pipeline's stages against brute force."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import connect, differences
from conftest import SF
from lookweave.llm import decontam, queries

COLUMNS = {
    "op1": "doc_id piece start length ids_crc32 sequence_id offset", "op2": "doc_id held_out lang_pred score",
    "op3": "doc_id n_shingles component_id kept", "op5": "doc_id held_out score predicted",
    "op11": "vec_id n_links component_id kept", "op13": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op8": "doc_id n_assign n_access n_hex base_sha256 spans", "op10": "query_id rank vec_id score",
}


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name.split("_")[0], "").split()) <= set(frame.columns)
    got = frame.toPandas()
    if name in queries.ORACLES:
        assert differences(got, connect(SF).execute(queries.ORACLES[name]).df()) == []
    assert len(got) > 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, benchmark = docs.columns, [decontam.hashes_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    held = docs.toPandas()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before, held = held, docs.toPandas()
        if name == "packing":
            assert set(held["doc_id"]) == set(before["doc_id"])
            continue
        assert docs.columns == columns and set(held["doc_id"]) <= set(before["doc_id"]), name
        texts = dict(zip(before["doc_id"], before["text"]))
        if name == "line_dedup":
            seen = []
            for r in before.sort_values("doc_id").itertuples():
                kept = []
                for line in r.text.split("\n"):
                    w = frozenset(line.encode().lower().split())
                    if not w or not any(5 * len(w & v) >= 4 * len(w | v) for v in seen if 0.8 <= len(v) / len(w) <= 1.25):
                        kept.append(line)
                    if w:
                        seen.append(w)
                now = held.loc[held["doc_id"] == r.doc_id, "text"].tolist()
                assert now == ["\n".join(kept)] or (not now and not "".join(kept).split())
            assert (held["n_chars"] == held["text"].str.len()).all()
        else:
            assert all(texts[d] == t for d, t in zip(held["doc_id"], held["text"]))
        if name == "decontamination":
            def found(text):
                a = decontam.hashes_of(text)
                return any(decontam.best_window(a, b, d) for b in benchmark if set(b.tolist()) & set(a.tolist()) for d in range(-len(b), len(a)))
            gone = set(before["doc_id"]) - set(held["doc_id"])
            assert all(found(texts[d]) for d in gone) and not any(found(t) for t in held["text"])


ODD = [(1, 0, "user", "hi"), (1, 1, "assistant", "two words"), (1, 2, "user", None), (1, 3, "assistant", "a\nb"), (1, 3, "assistant", "zz"), (1, 3, "assistant", "zz"), (1, 4, None, "ok"), (1, 4, "user", None),
       (None, 1, "assistant", "no id"), (None, 2, "user", "no id"), (None, None, "user", None), (2, None, "assistant", None), (2, None, "user", "x"), (2, None, "user", None), (3, -4, "assistant", "w"), (3, -3, "user", "r")]


def test_odd_conversations(spark, tmp_path):
    """op6 and its twin over rows without conversation or turn, repeated turns, first turns that answer nothing."""
    import duckdb

    spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op6_chat_linking"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op6_chat_linking"]).df()
    assert differences(got, want) == []
    assert {"unidentified", "duplicate", "orphan", "invalid", "open"} <= set(got["status"]) | {"open"}
