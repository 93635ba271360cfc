"""Language-model scores of whole documents: word counts of the training part, and a gated recurrent model.

Counts are gathered over all training documents: each task sums its words, the sums are added by word hash.  The words
that fit a table of table_words entries (all of them, up to that many; else those of the highest counts) go to
every executor; a document's other words are joined with the counts by shuffle, so that nothing is left out at any size.

The recurrent model knows the `vocabulary` most frequent words.  It learns from all words of all training documents, in
rounds: each round takes its share of the documents, each task trains the model on its own ones, and the weights are
averaged by the tasks' words.  It starts from weights that the driver trains on a sample of about train_documents training
documents, or fewer where texts are long; the sample's documents are in the rounds as well.  What doesn't grow with the corpus
are the vocabulary, the hidden units, the number of rounds and the sample for the start.
A word beyond the vocabulary counts as the unknown word times its share among the unknown words: (c + 1) over the sum of that.
Scores are log10.

Null and empty texts consist of the end alone.  A null doc_id counts as the empty text where its remainder is taken.
Without training documents all counts are 0 and the model stays as it begins.
"""

from __future__ import annotations

import copy
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, table, text_bytes
from .gru import UNKNOWN, Adam, Gru, keep_memory

#: The training documents are dealt to so many rounds; the rate halves each round.
ROUNDS, RATE = 3, 0.01
#: Words that a task gathers for a pass of training, at least, and rows of words side by side in it, at most.
BLOCK, LANES = 262_144, 1024
#: Words of the sample that the start is trained on, about.
START_WORDS = 400_000


def hash_of(word: bytes) -> int:
    """END is the empty word."""
    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


END = hash_of(b"")


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), c: over all rows of docs, the end of each included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def put() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([hash_of(w) for w in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for data in batch.slice(i, 256).column(0).to_pylist():
                    counts.update(data.lower().split())
                    counts[b""] += 1
                if len(counts) > 200_000:
                    yield put()
        if counts:
            yield put()

    rows = docs.select(text_bytes().alias("t")).mapInArrow(run, "word bigint, c bigint")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


class Lookup(dict):
    """Places of words in the table of frequent words, -1 for others; of bounded number."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.by_hash = dict(zip(hashes.view(np.uint64).tolist(), range(len(hashes)), strict=True))

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = at = self.by_hash.get(xxhash.xxh3_64_intdigest(word), -1)
        return at


_LOOKUPS: dict[bytes, Lookup] = {}


def lookup_of(hashes: np.ndarray) -> Lookup:
    """One lookup a worker process for the table in use: it serves all tasks that the process runs, and goes with the next table."""
    key = hashes.tobytes()
    if key not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[key] = Lookup(hashes)
    return _LOOKUPS[key]


def placed(datas: list[bytes], lookup: Lookup) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts, their places, the text of each, and the texts' numbers of words."""
    split = [data.lower().split() for data in datas]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    words = list(chain.from_iterable(split))
    return words, np.fromiter(map(lookup.__getitem__, words), np.int64, len(words)), np.repeat(np.arange(len(split)), lens), lens


def with_ends(at: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Places with each text's end, whose place is 0, behind it."""
    out = np.zeros(len(at) + texts, np.int64)
    out[np.arange(len(at)) + owner] = at
    return out


def numbers(at: np.ndarray, vocabulary: int) -> np.ndarray:
    """Word numbers of the model: places below its vocabulary, moved up by the unknown word."""
    return np.where((at >= 0) & (at < vocabulary - 1), at + 1, UNKNOWN)


def numbers_of(datas: list[bytes], names: dict[bytes, int]) -> np.ndarray:
    """Word numbers of the model over texts, each text's end behind it; names: of all words of the vocabulary, and of the end, which is the empty word."""
    split = [data.lower().split() for data in datas]
    for words in split:
        words.append(b"")
    return np.fromiter(map(names.get, chain.from_iterable(split), repeat(UNKNOWN)), np.int64, sum(map(len, split)))


def round_of() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(ROUNDS))


def start_model(model: Gru, training: DataFrame, n: int, lookup: Lookup, vocabulary: int, train_documents: int) -> dict[bytes, int]:
    """Trains the model on the driver, on a sample by doc_id that has START_WORDS of the n training words, about, at most; gives the
    sample's words with their numbers in the model, as far as they are in the vocabulary, and the end."""
    every = max(1, training.count() // max(1, train_documents), n // START_WORDS)
    sample = training.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(every)) == 0).orderBy("doc_id").limit(2 * train_documents)
    parts, names = [np.zeros(1, np.int64)], {b"": int(numbers(np.zeros(1, np.int64), vocabulary)[0])}
    for r in sample.select(text_bytes().alias("t")).toLocalIterator():
        words = bytes(r["t"]).lower().split()
        parts.append(numbers(np.array([lookup[w] for w in words] + [0]), vocabulary).astype(np.int32))
        names.update((w, k) for w, k in zip(words, parts[-1].tolist(), strict=False) if k != UNKNOWN)
    parts[0] = numbers(parts[0], vocabulary).astype(np.int32)
    model.train(np.concatenate(parts))
    return names


def average_round(model: Gru, docs: DataFrame, hashes: np.ndarray, vocabulary: int, rate: float, lanes: int, known: dict[bytes, int]) -> None:
    """Each task trains the model on its rows of docs, a block of words at a time; the model becomes the mean of theirs, by their words.

    Where known has all words of the vocabulary, it gives the words' numbers; else their hashes do."""
    complete = len(known) == len(hashes)
    sent = docs.sparkSession.sparkContext.broadcast((hashes, model, known if complete else None))
    names = sorted(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shared, known = sent.value
        keep_memory()
        own = copy.deepcopy(shared)  # a worker's next task begins with the shared weights again
        adam, lookup = Adam(own.p), None if known else lookup_of(hashes)
        end = numbers(np.zeros(1, np.int64), vocabulary)
        parts, waiting, words = [end], 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                datas = batch.slice(i, 256).column(0).to_pylist()
                if known:
                    parts.append(numbers_of(datas, known))
                else:
                    _, at, owner, _ = placed(datas, lookup)
                    parts.append(numbers(with_ends(at, owner, len(datas)), vocabulary))
                waiting += len(parts[-1])
                if waiting >= BLOCK:
                    words += own.learn(adam, np.concatenate(parts), rate, lanes)
                    parts, waiting = [end], 0
        words += own.learn(adam, np.concatenate(parts), rate, lanes)
        if words:
            weights = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([weights.tobytes()], pa.binary())], ["words", "weights"])

    rows = materialize(docs.select(text_bytes().alias("t")).mapInArrow(run, "words bigint, weights binary"), "lm-weights")
    total, mean = 0, np.zeros(sum(x.size for x in model.p.values()))
    for r in rows.toLocalIterator():
        mean += r["words"] * np.frombuffer(r["weights"], np.float32).astype(np.float64)
        total += r["words"]
    sent.unpersist()
    at = 0
    for k in names if total else ():
        x = model.p[k]
        model.p[k] = (mean[at : at + x.size] / total).reshape(x.shape).astype(x.dtype)
        at += x.size


def score_documents(docs: DataFrame, vocabulary: int = 1024, table_words: int = 200_000, train_documents: int = 400, hidden: int = 16) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs."""
    spark = docs.sparkSession
    training = docs.where(~held_out())
    counts = materialize(word_counts(training), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = total["n"], total["v"]

    # the least count of a word in the table: the most words that fit
    least, fit = 1, 0
    if v > table_words:
        for r in counts.groupBy("c").count().orderBy(F.desc("c")).toLocalIterator():
            fit += r["count"]
            if fit > table_words:
                least = r["c"] + 1
                break
    head = counts.where((F.col("c") >= least) | (F.col("word") == END))
    rows = head.toPandas()
    rows = rows.iloc[np.lexsort((rows["word"].to_numpy(), -rows["c"].to_numpy(), rows["word"].to_numpy() != END))]
    hashes, c = rows["word"].to_numpy(np.int64), rows["c"].to_numpy(np.int64)  # the end comes first
    if not len(hashes):
        hashes, c = np.array([END]), np.array([0])
    known = c[: vocabulary - 1]
    unknown_mass = float(n + v + 1 - (known + 1).sum())
    model = Gru(np.concatenate([[max(0.0, n - known.sum())], known]), hidden)
    names = start_model(model, training, n, Lookup(hashes), vocabulary, train_documents)
    for k in range(ROUNDS):
        average_round(model, training.where(round_of() == k), hashes[: vocabulary - 1], vocabulary, RATE * 0.5**k, lanes=min(LANES, max(32, n // 100_000)), known=names)

    sent = spark.sparkContext.broadcast((hashes, c, model))
    norm = float(np.log10(n + 1 * (v + 1)))
    log_unknown = float(np.log10(max(1.0, unknown_mass)))
    all_in_table = v <= len(hashes)

    def make():
        hashes, c, model = sent.value
        keep_memory()
        lookup = lookup_of(hashes)
        log_c = np.log10(c + 1.0)  # a word beyond the table has place -1; what stands there is not used

        def f(columns: list[list]) -> list[list]:
            doc_ids, held, datas = columns
            words, at, owner, lens = placed(datas, lookup)
            texts = len(datas)
            inside = at >= 0
            own = np.where(inside, log_c[at], 0.0)
            # words that no training document has: c = 0, all of them where the table is complete
            base = np.bincount(owner, own, texts) + log_c[0] - (lens + 1) * norm
            known_tokens = np.bincount(owner[inside & (c[at] > 0)], minlength=texts) + int(c[0] > 0)
            beyond = at >= vocabulary - 1
            rest = np.bincount(owner[beyond], own[beyond], texts) - np.bincount(owner[beyond | ~inside], minlength=texts) * log_unknown
            rare_words: list = [[] for _ in datas]
            rare_times: list = [[] for _ in datas]
            if not all_in_table and not inside.all():
                out = np.flatnonzero(~inside)
                hashed = np.fromiter((hash_of(words[k]) for k in out.tolist()), np.int64, len(out))
                order = np.lexsort((hashed, owner[out]))
                x, d = hashed[order], owner[out][order]
                first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (d[1:] != d[:-1])]))
                times, x, d = np.diff(np.append(first, len(x))), x[first], d[first]
                for k in np.unique(d).tolist():
                    i, j = np.searchsorted(d, k), np.searchsorted(d, k, "right")
                    rare_words[k], rare_times[k] = x[i:j], times[i:j]
            edges = np.cumsum(lens + 1)
            places = np.split(numbers(with_ends(at, owner, texts), vocabulary), edges[:-1])
            score = model.log_probability(places, 1) / np.log(10) + rest
            ids = [uuid.uuid4().int >> 65 for _ in doc_ids]
            return [doc_ids, held, lens + 1, known_tokens, base, score, ids, rare_words, rare_times]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, row bigint, words array<bigint>, times array<bigint>"
    scored = map_rows(docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("t")), make, ddl, chunk=1024)
    train_tokens = F.lit(int(n)).cast("long").alias("train_tokens")
    if all_in_table:
        return scored.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens, "base_score", "score")
    scored = materialize(scored, "lm-scored")
    rare = scored.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
    rare = rare.select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    more = rare.join(counts.where(F.col("c") < least), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("seen"))
    joined = scored.drop("words", "times").join(more, "row", "left")
    add = F.coalesce("more", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        train_tokens,
        (F.col("base_score") + add).alias("base_score"),
        (F.col("score") + add).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
