"""Quality rules as a short-circuit cascade, all in DataFrame functions.

Figures of a text (words are runs other than space and \\t..\\r) come from one set of expressions.
Each rule is a condition over them; cost (by the clock) and selectivity of each are measured on a bounded sample,
and the rules then run in the order of rejections per cost, a document leaving at its first rejection.
The order changes the work and which of several rules is named, never the verdict.

Null or empty text: no words, all figures 0, rejected by the base rule.  Repeated rows give repeated
results; an empty table gives an empty result.  Other columns pass through apply_rules, save that a column of the
input with the name of a figure gives way to the figure; keep_good gives all columns back as they are.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed, table

SPACE = " \t\n\x0b\x0c\r"
#: Up to so many words a 3-word window is one long: 44 bits of hash, 20 of position.
PACKED = 1 << 20
#: Seconds by which two jobs over one small sample differ without a reason.
NOISE = 0.02


def repeated_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows found twice or more in the text, the first included.

    Windows are sorted by hash and position; equal neighbours are compared word by word, so a
    hash that falls together with another counts for nothing.  The positions that repeated windows
    cover are then counted once each.
    """
    firsts = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))

    def covered(keys: Column, head: Callable[[Column], Column], at: Callable[[Column], Column]) -> Column:
        """keys: one sorted key a window; head and at: its hash and its position."""

        def both(i: Column) -> Column:
            p, q = at(F.get(keys, i)), at(F.get(keys, i + 1))
            same = [F.get(words, p + k) == F.get(words, q + k) for k in range(3)]
            return F.when(same[0] & same[1] & same[2], F.array(p, p + 1, p + 2, q, q + 1, q + 2)).otherwise(F.array().cast("array<int>"))

        pairs = F.filter(F.sequence(F.lit(0), F.size(keys) - 2), lambda i: head(F.get(keys, i)) == head(F.get(keys, i + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(pairs, both))))

    # short texts: hash and position in one long; long ones: the same with the whole hash beside the position
    short = F.sort_array(F.transform(firsts, lambda w, i: F.shiftleft(window(w, i), 20).bitwiseOR(i.cast("long"))))
    long = F.sort_array(F.transform(firsts, lambda w, i: F.struct(window(w, i).alias("h"), i.alias("p"))))
    return (
        F.when(n < 4, F.lit(0))
        .when(n <= PACKED, F.aggregate(F.array(short), F.lit(0), lambda a, k: a + covered(k, lambda x: F.shiftright(x, 20), lambda x: x.bitwiseAND(F.lit(PACKED - 1)).cast("int"))))
        .otherwise(F.aggregate(F.array(long), F.lit(0), lambda a, k: a + covered(k, lambda x: x["h"], lambda x: x["p"])))
        .cast("long")
    )


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(x, "\n", -1), lambda s: F.trim(s, F.lit(SPACE)) != "")
    names = ("_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return (
        docs.drop(*(c for c in names if c in docs.columns and c != text))
        .withColumn("_words", F.split(F.trim(x, F.lit(SPACE)), r"[ \x09-\x0D]+", -1))
        .withColumn("_words", F.when(F.get("_words", F.lit(0)) == "", F.array().cast("array<string>")).otherwise(F.col("_words")))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.size(F.regexp_extract_all(x, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"))
        .withColumn("n_dup_lines", F.aggregate(F.array(lines), F.lit(0), lambda a, l: a + F.size(l) - F.size(F.array_distinct(l))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words"), F.size("_words")))
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: name -> rejects.  Figures are there already; letters, capitals, bars and dup_lines take a pass over the text.
def rules(text: str = "text") -> dict[str, Column]:
    x = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.col("n_words")
    size = F.greatest(F.length(x), F.lit(1))
    return {
        "symbols": 10 * F.col("n_symbols") > 6 * n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "dup_lines": F.col("n_dup_lines") * 3 > F.size(F.split(x, "\n", -1)) * 2,
        "letters": F.length(F.regexp_replace(x, r"[^\p{L}]+", "")) * 2 < size,
        "capitals": F.length(F.regexp_replace(x, r"[^\p{Lu}]+", "")) * 10 > size * 4,
        "bars": 10 * F.size(F.filter(F.split(x, " ", -1), lambda w: w == "|")) > 3 * n,
    }


def order_rules(figured: DataFrame, text: str = "text", rounds: int = 3) -> list[str]:
    """Rule names by rejections per cost, both measured on the rows of figured (a sample).

    A rule's cost is the least time of some rounds over the sample beyond what a rule without any work takes, NOISE at
    least; equal gains go by the order of rules().  One job gives the rejections of all.
    """
    own = rules(text)
    sample = figured.select(text, "n_words", "word_chars", "n_symbols", "n_dup_lines").persist()
    try:
        got = sample.agg(*(F.sum(F.when(rejects, 1).otherwise(0)).alias(k) for k, rejects in own.items())).first()

        def seconds(rejects: Column) -> float:
            one = sample.agg(F.count(F.when(rejects, 1)))
            times = []
            for _ in range(rounds):
                begin = time.perf_counter()
                one.first()
                times.append(time.perf_counter() - begin)
            return min(times)

        # a rule that rejects none comes last at any cost
        found = [k for k in own if got[k]]
        idle = seconds(F.col("n_words") < 0) if len(found) > 1 else 0.0
        gain = {k: got[k] / max(seconds(own[k]) - idle, NOISE) if len(found) > 1 else 1.0 for k in found}
    finally:
        sample.unpersist()
    return sorted(own, key=lambda k: -gain.get(k, 0.0))


def sample_of(docs: DataFrame, text: str, sample_rows: int) -> DataFrame:
    total = docs.count()
    every = max(1, total // max(1, sample_rows))
    return docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(every)) == 0).limit(2 * sample_rows)


def apply_rules(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """docs with the figures, base_failed, rejected_by (null: none; 'base' comes first) and kept."""
    order = order_rules(figures(sample_of(docs, text, sample_rows), text), text)
    own = rules(text)
    by = F.when(F.col("base_failed"), F.lit("base"))
    for k in order:
        by = by.when(own[k], F.lit(k))
    out = (
        figures(docs, text)
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", by)
        .withColumn("kept", F.col("rejected_by").isNull())
        .drop("_words")
    )
    # a filter on the verdict must not be pushed below the figures: it would make each of them anew for each use
    return out.observe(f"quality_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs, whatever these are called."""
    own, back = renamed(docs)
    return back(apply_rules(own).where("kept").select(*own.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
