"""The pipeline's stages against brute force, each on its own input."""

import re

import corpus_pipeline
from lodegraph.llm.common import materialize

from .helpers import SF, documents, odd_texts
from .test_jaccard import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = dict(texts)
    items = [r["text"].lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[i : i + 8]) for w in (words.findall(t) for t in items) for i in range(max(1, len(w) - 7))}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test")
        rows = {r["doc_id"]: r for r in docs.collect()}
        if name != "pieces":
            assert docs.columns == columns
            now = {k: r["text"] for k, r in rows.items()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        if name == "quality":
            assert all(len(t.split()) >= 50 for t in now.values()) and set(now.items()) <= set(seen.items())
        elif name == "near_duplicates":
            ids = sorted(seen)
            want = {ids[c] for k, (n, c) in enumerate(brute([seen[i] for i in ids], 5, 80))}
            assert set(now) == want and set(now.items()) <= set(seen.items())
        elif name == "decontaminate":
            for k, t in seen.items():
                own = words.findall(t.lower())
                if not any(tuple(own[i : i + 8]) in windows for i in range(len(own) - 7)):
                    assert now[k] == t
            for t in now.values():
                own = words.findall(t.lower())
                assert sum(tuple(own[i : i + 8]) in windows for i in range(len(own) - 7)) == 0
        elif name == "secrets":
            assert set(now) == set(seen) and not any(re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", t) for t in now.values())
        else:
            assert set(rows) == set(seen) and all(r["round_trip"] and r["n_pieces"] > 0 for r in rows.values())
            break
        seen = now


def test_odd_rows_and_extra_columns(spark):
    docs = documents(spark, odd_texts()).selectExpr("*", "1 as n_words", "'x' as kept", "'y' as spans")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "test")
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
