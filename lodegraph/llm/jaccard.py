"""N-gram Jaccard join: documents link where their shingle sets are similar enough.

Sets of hashed shingles are judged exactly; nothing that links is lost:

1. Documents of one set are one node: a set's fingerprint.  All later work is on distinct sets.
2. Index lists.  A set's shingles are dealt by their hash into m parts, m being one more than the
   greatest number of shingles by which two linked sets of this size differ; by the pigeonhole principle
   linked sets agree on a whole part, so each part's digest is a list in the index.  Lists are split into
   blocks by set size (a size class and the next), so that a set skips all blocks whose sizes can't link.  A part without
   shingles says nothing; m grows by the number of empty parts that a set may leave out, chosen so that hardly any set
   has more, and a set that has puts its empty parts into the index as well.  A set's lists have positions, the shortest
   first; what stands behind the position that a linked set must have reached (one more than the parts in which it may
   differ) is skipped.
3. Answers from answers.  In each list one set leads; only the pairs (leader, member) are judged, and a linked member
   takes over the leader's component, so that the members of a list of copies are never compared with each other.
   What a member has and its leader hasn't, or the other way round, is its difference d; |x - y| of two members is that of
   their differences, so that all further answers come from these, which are small, and not from the sets.  A shingle that
   stands in one difference alone tells its member from all others: members with u own shingles and r others differ
   by u + u' + |r - r'| at least, and by as many as there are unlike bits in the parities of their differences.  A member with more own shingles than any link allows is done; the others are counted in
   cells of (u, r), and a member stays only if its cell and one with another component are near enough.
   Pairs of members that are left on a common list are judged as sets.
4. Components of the links are found by star contraction.

A pair is judged where its leader's slot is: members travel with their texts, dealt by leader and salt, so that a leader
with very many members is spread over tasks.  Sets are made anew there, from the texts of those documents alone that need them.

Null texts and texts without words have no shingles and link with nothing; a text of fewer words than a shingle is one
shingle.  Repeated rows are copies of each other.  Rows with a null doc_id link as others do; they have the
least doc_id of their component, or null where no member has one.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, table, text_bytes
from .components import components

#: Size classes grow by this factor.
GROWTH = 1.5
#: Up to so many rows a lookup side is broadcast (some 40 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Shingles that one slot of a leader holds at most, about.
SLOT = 100_000


class Words(dict):
    """Hashes of words, of bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, n: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text in bytes (A-Z are lowered here)."""
    split = data.lower().split()
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    if len(h) == 0:
        return h
    if len(h) < n:
        own = np.uint64(len(h))
        for x in h:
            own = mix(np.atleast_1d(own * np.uint64(0x9E3779B97F4A7C15) + x))[0]
        return np.atleast_1d(own)
    own = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        own = own * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(mix(own))


class Plan:
    """Blocks of set sizes, and the parts of each.  Similarity is percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent
        self.lows = [1]  # least size of each class
        while self.lows[-1] < 1 << 40:
            self.lows.append(int(self.lows[-1] * GROWTH) + 1)
        self.known: dict[tuple[int, int], tuple[int, int]] = {}

    def parts(self, low: int, total: int) -> tuple[int, int]:
        """(m, empty parts that a set may leave out) for sets of at least low shingles, two linked ones having at most total together."""
        if (low, total) not in self.known:
            differ = total * (100 - self.percent) // (100 + self.percent)
            best = (math.inf, 0, 0)
            for empty in range(40 if differ else 0):
                m = differ + 1 + empty
                mean = m * math.exp(-low / m)
                term = tail = math.exp(-mean)
                for k in range(1, empty + 1):
                    term *= mean / k
                    tail += term
                best = min(best, (max(1e-7, 1 - tail), m, empty))
            # large sets have more empty parts than these: six deviations above the mean, where that has an end
            empty = 40
            while best[0] > 0.01 and differ and (m := differ + 1 + empty) <= low:
                mean = m * math.exp(-low / m)
                if mean + 6 * math.sqrt(mean) <= empty:
                    best = (0.0, m, empty)
                    break
                empty = math.ceil(mean + 6 * math.sqrt(mean))
            if differ and best[1] <= differ:
                raise AssertionError(f"{best[1]} parts for sets that differ by {differ} shingles")
            self.known[low, total] = best[1:] if differ else (0, 0)
        return self.known[low, total]

    def blocks(self, n: int) -> list[tuple[int, int, int]]:
        """(block, parts, empty ones) for a set of n shingles: its class, and the blocks across a border that it may link over."""
        k = bisect.bisect_right(self.lows, n) - 1
        out = [(2 * k, *self.parts(self.lows[k], 2 * (self.lows[k + 1] - 1)))]
        if 100 * n // self.percent >= self.lows[k + 1]:
            out.append((2 * k + 1, *self.across(k)))
        if k and -(-self.percent * n // 100) < self.lows[k]:
            out.append((2 * k - 1, *self.across(k - 1)))
        return [x for x in out if x[1]]

    def across(self, k: int) -> tuple[int, int]:
        high = self.lows[k + 1] - 1
        return self.parts(-(-self.percent * (high + 1) // 100), high + 100 * high // self.percent)

    def most_apart(self, n: int, block: int) -> int:
        """Most shingles by which a set of n differs from one that it links with in this block."""
        border = self.lows[(block + 1) // 2] - 1 if block % 2 else self.lows[block // 2 + 1] - 1
        partner = 100 * n // self.percent if block % 2 and n <= border else min(border, 100 * n // self.percent)
        return (n + partner) * (100 - self.percent) // (100 + self.percent)

    def keys(self, own: np.ndarray) -> tuple[np.ndarray, list[dict[str, int]]]:
        """The lists of a set (the last byte is the block), and for each block how many they are and how many of the shortest are enough."""
        out, blocks = [], []
        for block, m, empty in self.blocks(len(own)):
            part = (mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)) % np.uint64(m)
            counts = np.bincount(part.astype(np.int64), minlength=m)
            total = np.zeros(m, np.uint64)
            np.add.at(total, part.astype(np.int64), mix(own))
            keys = mix(mix(total + counts.astype(np.uint64)) + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(block * 7919 + 1))
            every = (counts == 0).sum() > empty  # a partner may leave out up to `empty` of the parts that are equal
            keys = keys if every else keys[counts > 0]
            out.append(keys & ~np.uint64(255) | np.uint64(block & 255))
            blocks.append({"block": block & 255, "lists": len(keys), "enough": self.most_apart(len(own), block) + 1 + empty * int(every)})
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64), blocks


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def same_row(one: str, two: str) -> Column:
    """Rows of one doc_id (null too) and text."""
    return F.col(f"{one}.doc_id").eqNullSafe(F.col(f"{two}.doc_id")) & (F.col(f"{one}.h") == F.col(f"{two}.h"))


def index_lists(docs: DataFrame, n: int, plan: Plan) -> DataFrame:
    """doc_id, h (of the text), n_shingles, fp (0: no shingles), keys and blocks (null where this task gave them before for the same set)."""

    def make() -> Callable:
        words, seen = Words(), set()

        def f(columns: list[list]) -> list[list]:
            sizes, fps, keys, blocks = [], [], [], []
            for data in columns[2]:
                own = shingles(data, n, words)
                sizes.append(len(own))
                fp = xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0
                fp = fp - (1 << 64) if fp >> 63 else fp
                fps.append(fp)
                if not len(own) or fp in seen:
                    keys.append(None)
                    blocks.append(None)
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(fp)
                k, b = plan.keys(own)
                keys.append(k)
                blocks.append(b)
            return [columns[0], columns[1], sizes, fps, keys, blocks]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, h bigint, n_shingles bigint, fp bigint, keys array<bigint>, blocks array<struct<block:int,lists:int,enough:int>>"
    return map_rows(docs.select("doc_id", text_hash().alias("h"), text_bytes().alias("t")), make, ddl)


def parity(d: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Whether an odd number of a difference's shingles falls on each of so many bits as the leader's size wants.

    Where two of a leader's members have unlike bits, a shingle tells them apart."""
    words = max(4, -(-6 * 2 * size * (100 - percent) // (100 + percent) // 64))
    bits = np.bincount((d & np.uint64(0xFFFFFFFF)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def judged(docs: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, size_a, size_b, linked, d, bits) of pairs (a, b) of fingerprints, a leading; d: 32 bits of each shingle that one of them has alone; bits: see parity."""
    weight = sets.select(F.col("fp").alias("b"), F.col("n_shingles").alias("w"))
    counted = pairs.join(weight, "b")
    load = counted.groupBy("a").agg(F.ceil(F.sum("w") / F.lit(SLOT)).cast("int").alias("slots"))
    members = counted.join(load, "a").select("a", "b", F.pmod(F.xxhash64("a", "b"), F.col("slots")).cast("int").alias("slot"))
    leaders = load.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    wanted = materialize(members.union(leaders), "jaccard-pairs")
    # one document stands for each set; its text goes to the slots and becomes the set there: it takes half the room of the hashes
    stands = sets.select("one.doc_id", "one.h", F.col("fp").alias("b")).join(wanted, "b")
    small = wanted.count() <= BROADCAST_ROWS
    chosen = docs.select("doc_id", "text", text_hash().alias("h")).alias("x").join((F.broadcast(stands) if small else stands).alias("y"), same_row("x", "y"))
    dealt = chosen.select("a", "slot", "b", text_bytes().alias("t")).repartition("a", "slot").sortWithinPartitions("a", "slot", F.col("a") != F.col("b"), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("linked", pa.bool_()), ("d", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, held, lead = Words(), None, None, np.zeros(0, np.uint64)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                out: list[list] = [[] for _ in schema]
                for a, slot, b, data in zip(*(c.to_pylist() for c in whole.slice(i, 256).columns), strict=True):
                    if last == (a, slot, b):  # rows repeat
                        continue
                    last = (a, slot, b)
                    own = shingles(data, n, words)
                    if a == b:
                        held, lead = (a, slot), own
                        continue
                    if held != (a, slot):
                        raise RuntimeError("a leader's set is missing")
                    d = np.setxor1d(lead, own, assume_unique=True)
                    common = (len(lead) + len(own) - len(d)) // 2
                    linked = 100 * common >= percent * (common + len(d))
                    for c, v in zip(out, (a, b, len(lead), len(own), linked, (d >> np.uint64(32)).astype(np.uint32).view(np.int32), parity(d, len(lead), percent)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "a bigint, b bigint, size_a bigint, size_b bigint, linked boolean, d array<int>, bits array<bigint>")


def shortest(found: DataFrame, needs: DataFrame) -> DataFrame:
    """key, fp: of each set the shortest lists that are enough.

    Linked sets differ in at most `enough` - 1 parts, so they share one of their `enough` shortest lists in a common
    order; lists that a set has alone count as its shortest ones."""
    own = found.withColumn("block", F.col("key").bitwiseAND(F.lit(255)).cast("int"))
    by = Window.partitionBy("fp", "block")
    ranked = own.select("key", "fp", "block", F.count(F.lit(1)).over(by).alias("n"), F.row_number().over(by.orderBy("size", "key")).alias("r"))
    return ranked.join(needs, ["fp", "block"]).where("r + lists - n <= enough").select("key", "fp")


def leading(kept: DataFrame) -> DataFrame:
    """key, a, fp: lists of two sets or more, with their leaders.  The set leads that shares lists with most others (an original does so more than its copies)."""
    dealt = kept.repartition("key")  # one exchange serves both sides
    several = dealt.groupBy("key").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("u <> v").select("key", "n")
    mates = dealt.join(several, "key").select("key", "fp", (-F.sum("n").over(Window.partitionBy("fp"))).alias("o"))
    return mates.select("key", F.min(F.struct("o", "fp")).over(Window.partitionBy("key"))["fp"].alias("a"), "fp")


#: Cells of a leader's members: a link's difference has so many of them.
CELLS = 24


def most(size_x: Column | str, size_y: Column | str, percent: int) -> Column:
    """Shingles by which linked sets of these sizes differ at most."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (size_x, size_y))
    return F.floor((x + y) * (100 - percent) / (100 + percent))


def members(judgements: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """a, b, size, u, r, cu, cr, bits, root of judged members that may link with other members of a: u shingles of the difference from a are b's alone among a's members, r are not."""
    elements = judgements.select("a", "b", F.explode("d").alias("e"))
    own = elements.groupBy("a", "e").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b")).where("n = 1").groupBy("a", "b").agg(F.count(F.lit(1)).alias("u"))
    known = judgements.select("a", "b", F.col("size_a"), F.col("size_b").alias("size"), "n", "bits").join(own, ["a", "b"], "left")
    u = F.coalesce("u", F.lit(0))
    step = F.greatest(F.lit(1), F.floor(2 * F.col("size_a") * (100 - percent) / (100 + percent) / CELLS))
    widest = F.floor(F.col("size") * 100 / percent)
    return (
        known.select("a", "b", "size", "bits", u.alias("u"), (F.col("n") - u).alias("r"), step.alias("step"))
        .where(F.col("u") <= most(F.col("size"), widest, percent))
        .select("a", "b", "size", "bits", "u", "r", F.floor(F.col("u") / F.col("step")).alias("cu"), F.floor(F.col("r") / F.col("step")).alias("cr"), "step")
        .join(roots.select(F.col("fp").alias("b"), "root"), "b", "left")
        .withColumn("root", F.coalesce("root", "b"))
    )


def near_cells(own: DataFrame, percent: int) -> DataFrame:
    """a, cu, cr of cells with a member that may link with a member of another component.

    A leader's cells are bounded in number, whatever its members are: u is below a link's difference, r below both sizes."""
    cells = own.groupBy("a", "cu", "cr", "step").agg(F.max("size").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    gathered = cells.groupBy("a", "step").agg(F.collect_list(F.struct("cu", "cr", "size", "low", "high")).alias("cells"))

    def make() -> Callable:
        def f(columns: list[list]) -> list[list]:
            out: list[list] = [[], [], []]
            for a, step, cells in zip(*columns, strict=True):
                u, r, size, low, high = (np.array([c[k] for c in cells], np.int64) for k in ("cu", "cr", "size", "low", "high"))
                for k in range(len(cells)):
                    gap = np.maximum(0, np.abs(r - r[k]) - 1)
                    near = (u + u[k] + gap) * step * (100 + percent) <= (size + size[k]) * (100 - percent)
                    if (near & ((low != low[k]) | (high != high[k]) | (low != high))).any():
                        for c, v in zip(out, (a, int(u[k]), int(r[k])), strict=True):
                            c.append(v)
            return out

        return f

    return map_rows(gathered.select("a", "step", "cells"), make, "a bigint, cu bigint, cr bigint", chunk=64)


def further_pairs(lists: DataFrame, judgements: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members of one list, of different components, whose differences from the leader allow a link."""
    named = lists.where("a <> fp").join(roots, "fp", "left").select("key", "a", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("u"), F.max("root").alias("v")).where("u <> v").select("key")
    left = materialize(lists.where("a <> fp").join(mixed, "key", "left_semi"), "jaccard-open")
    wanted = left.select("a", F.col("fp").alias("b")).distinct()
    told = judgements.withColumn("n", F.size("d")).join(wanted, ["a", "b"], "left_semi")  # n goes without d
    own = materialize(members(told, roots, percent), "jaccard-members")
    stay = materialize(own.join(near_cells(own, percent), ["a", "cu", "cr"], "left_semi"), "jaccard-near")
    rows = left.join(stay.withColumnRenamed("b", "fp"), ["a", "fp"]).select("key", "fp", "size", "u", "r", "bits", "root")
    x, y = rows.alias("x"), rows.alias("y")
    reach = most("x.size", "y.size", percent)
    unlike = F.aggregate(F.zip_with("x.bits", "y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    near = (F.col("x.u") + F.col("y.u") + F.abs(F.col("x.r") - F.col("y.r")) <= reach) & (unlike <= reach)
    found = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & near)
    return found.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, h, n_shingles, root: documents with one root are a component; root is null where there are no shingles."""
    plan = Plan(percent)
    indexed = materialize(index_lists(docs, n, plan), "jaccard-index")
    sets = indexed.where("n_shingles > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.min("n_shingles").alias("n_shingles"))
    sets = materialize(sets, "jaccard-sets")
    # one exchange serves both the lists and the test for two sets or more: there the least and the greatest fingerprint differ
    keyed = indexed.where("keys is not null").select("fp", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("u"), F.max("fp").alias("v"), F.count(F.lit(1)).alias("size")).where("u <> v").select("key", "size")
    found = materialize(keyed.join(shared, "key").distinct(), "jaccard-shared")
    needs = indexed.where("keys is not null").select("fp", F.inline("blocks")).distinct()
    lists = materialize(leading(materialize(shortest(found, needs), "jaccard-lists")), "jaccard-led")

    found = indexed.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("fp")).alias("fp"))
    pairs = materialize(lists.where("a <> fp").select("a", F.col("fp").alias("b")).distinct(), "jaccard-first")
    if pairs.isEmpty():
        return found.withColumnRenamed("fp", "root")
    first = materialize(judged(docs, sets, pairs, n, percent), "jaccard-judged")
    links = first.where("linked").select("a", "b")
    roots = materialize(components(links), "jaccard-roots").withColumnRenamed("node", "fp")
    done = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = materialize(further_pairs(lists, first, roots, percent).join(done, ["a", "b"], "left_anti"), "jaccard-further")
    if not more.isEmpty():
        links = links.union(materialize(judged(docs, sets, more, n, percent), "jaccard-judged").where("linked").select("a", "b"))
        roots = materialize(components(links), "jaccard-roots").withColumnRenamed("node", "fp")
    return found.join(roots, "fp", "left").select("doc_id", "h", "n_shingles", F.coalesce("root", "fp").alias("root"))


def component_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, h, n_shingles, component_id, and whether the row's document is the one that stays of its component."""
    found = groups(docs, n, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h"))
    least = found.where("root is not null").groupBy("root").agg(first.alias("one"))
    stays = F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("h") == F.col("one.h"))
    return found.join(least, "root", "left").select("doc_id", "h", "n_shingles", F.coalesce("one.doc_id", "doc_id").alias("component_id"), stays.alias("stays"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs without near duplicates: of each component the document of the least doc_id stays (a null one
    only where there is no other; one row, should document and text be repeated); so do documents without shingles.
    Rows that share a doc_id and differ in text are judged each by its own text."""
    rows = materialize(component_rows(docs, n, percent), "jaccard-rows")
    gone = rows.where("not stays").select("doc_id", "h").distinct()
    own = docs.select(F.struct("*").alias("row"), "doc_id", text_hash().alias("h"))
    left = own.alias("x").join((F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone).alias("y"), same_row("x", "y"), "left_anti")
    repeated = rows.where("stays and n_shingles > 0").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    if not repeated.isEmpty():
        again = left.alias("x").join(repeated.alias("y"), same_row("x", "y"), "left_semi").dropDuplicates(["doc_id", "h"])
        left = left.alias("x").join(repeated.alias("y"), same_row("x", "y"), "left_anti").unionByName(again)
    return left.select("row.*")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return component_rows(docs, 4, 85).select("doc_id", "n_shingles", "component_id")
