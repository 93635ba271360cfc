"""Fixtures of texts: nulls, empty and very long texts, ties, repeats, odd characters."""

import random

SF = "/root/testdata/sf0.001"


def odd_texts() -> list[str | None]:
    rnd = random.Random(7)
    vocab = ["the", "of", "A", "and", "Zeta", "no", "x1", "É", "ſ", "K"]
    mixed = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    glued = ["".join(rnd.choice(["a", "B", " ", "\n", "\t", "|", "#", "é", "0", "\x1f", " ", "the of and "]) for _ in range(rnd.randint(0, 300))) for _ in range(60)]
    long = " ".join(f"w{rnd.randint(0, 4000)}" for _ in range(30_000))
    return [None, "", " ", "\n\n", "one", "one two", "a a a a a a", "a b a b a b a", *mixed, *glued, long, "same text here", "same text here"]


def documents(spark, texts, **more):
    rows = [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
