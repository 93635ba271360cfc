"""Repeated substrings against a brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from lodegraph.llm import substrings

from .helpers import SF, documents, odd_texts


def brute(datas, length):
    times = Counter(d[i : i + length] for d in datas for i in range(len(d) - length + 1))
    out = []
    for d in datas:
        hit = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if times[d[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(b for b, h in zip(d, hit, strict=True) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rnd = random.Random(seed)
    shared = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.choice([30, 39, 40, 41, 60, 90, 150]))) for _ in range(8)]
    out = []
    for _ in range(90):
        out.append("".join(rnd.choice([rnd.choice(shared), "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 60))), rnd.choice(shared)[:35], "ab" * rnd.randint(0, 40), "x" * rnd.randint(0, 60)]) for _ in range(rnd.randint(0, 6))))
    return out + out[:5]


@pytest.mark.parametrize(("length", "gram", "slots", "seed"), [(40, 8, 3, 1), (40, 16, 2, 2), (64, 32, 3, 3)])
def test_against_all_windows(spark, length, gram, slots, seed):
    texts = passages(seed) + [None, "", "z" * 39, "q" * 500, "q" * 41]
    want = brute([(t or "").encode() for t in texts], length)
    for r in substrings.remove_repeats(documents(spark, texts), length, gram, slots).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], (r, texts[r["doc_id"]])


def test_query_length_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    want = brute([r["text"].encode() for r in rows], 400)
    got = {r["doc_id"]: r for r in substrings.op4_substrings(spark, SF).collect()}
    assert [(got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_removed"], got[r["doc_id"]]["n_spans"], got[r["doc_id"]]["kept_sha256"]) for r in rows] == want


def test_repeated_rows_nulls_and_the_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_RANGES", 0)
    long = "".join(chr(97 + (k * k) % 23) for k in range(900))
    rows = [(1, long), (1, long), (None, long[:450] + "!"), (2, "short"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([(t or "").encode() for _, t in rows], 400)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *w)) for (d, _), w in zip(rows, want, strict=True))
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def test_odd_texts(spark):
    texts = [t for t in odd_texts() if t is None or len(t) < 20_000]
    want = brute([(t or "").encode() for t in texts], 64)
    for r in substrings.remove_repeats(documents(spark, texts), 64).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]


def test_windows_have_one_sample_in_texts_of_all_sizes(monkeypatch):
    # hashes that agree in their upper 32 bits: what is compared below these must not depend on the text's size
    own = substrings.gram_hashes
    monkeypatch.setattr(substrings, "gram_hashes", lambda data, gram: own(data, gram) >> np.uint64(32))
    short = np.random.default_rng(5).integers(97, 123, 2000, dtype=np.int64).astype(np.uint8)
    long = np.concatenate([short, np.zeros(1 << 24, np.uint8)])
    at, _, _, last = substrings.cover(short, 400, 32)
    long_at, _, _, _ = substrings.cover(long, 400, 32)
    assert at[:-1].tolist() == long_at[: len(at) - 1].tolist() and last[-1] == 1600
