"""Removal of repeated substrings: bytes under a string of 400 bytes that starts anywhere else as well.

No suffix is sorted: windows are dealt into buckets by fingerprint, and the rows of a bucket are grouped one bucket at a time:

1. Cover sample.  Of the grams of each 400-byte window the one with the least hash (the leftmost of equals) is the
   window's sample position.  It depends on the window's bytes alone, so equal windows have it at the same offset, as a
   difference cover would give by position; about one position in 185 is sampled.
2. Ranks.  A sample position's rank is the fingerprint of its gram together with that of its whole reach (all windows
   that it stands for).  Positions with equal ranks have all windows in common: these long ties need no look at the text.
3. Buckets.  For grams with different reaches, one text stretch a reach (not one a copy) is cut into slots: the windows
   whose offsets lie in one range share a core of 278 bytes, and the core's fingerprint names the bucket.  Only the bytes at both
   sides of the core, at most 122, still tell windows apart; a bucket's entries are compared by these.
4. Windows found twice become byte ranges; a document's ranges are joined, and the rest is kept.

Memory: a task holds one bucket of distinct surroundings of one core, and one document.  Copies are counted before
they are shuffled.

Null and empty texts have no bytes.  Rows with equal doc_id and text count as two texts and get the same result; a
null doc_id is treated as a value.  Texts shorter than the length keep all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, table, text_bytes

LENGTH = 400
GRAM = 32
SLOTS = 3
#: Up to so many ranges are sent to all executors (16 bytes each, and a key for each document); more are joined by shuffle.
BROADCAST_RANGES = 1_000_000
BYTES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
STEP = 0x9E3779B97F4A7C15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram (a power of two of bytes)."""
    h, width, factor = BYTES[data], 1, STEP
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor & (1 << 64) - 1
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def cover(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sample positions, their gram hashes, and the first and last start of the windows that they stand for."""
    h = gram_hashes(data, gram)
    wide = length - gram + 1
    n = len(data) - length + 1
    low = np.uint64(0xFFFFFFFF)  # positions; the same for all sizes, or equal windows of a short and a long text could differ
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(keys) // wide)
    block = np.concatenate([keys, np.full(rows * wide - len(keys), ~np.uint64(0))]).reshape(rows, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    own = at[first]
    return own, h[own], first, last


def samples(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, h, gram, reach, at (position and the window starts before it, packed) of each sample position."""
    wide = np.int64(length - gram + 1)

    def make():
        def f(columns: list[list]) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for d, h, data in zip(*columns, strict=True):
                if len(data) < length:
                    continue
                own, grams, first, last = cover(np.frombuffer(data, np.uint8), length, gram)
                out[0] += [d] * len(own)
                out[1] += [h] * len(own)
                out[2] += grams.view(np.int64).tolist()
                view = memoryview(data)
                out[3] += [signed(xxhash.xxh3_64_intdigest(view[a : b + length], p - a)) for p, a, b in zip(own.tolist(), first.tolist(), last.tolist(), strict=True)]
                out[4] += ((own * wide + (own - first)) * wide + (own - last)).tolist()
            return out

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, make, f"doc_id {kind}, h bigint, gram bigint, reach bigint, at bigint", chunk=64)


def unpacked(at: int, wide: int) -> tuple[int, int, int]:
    at, last = divmod(at, wide)
    p, first = divmod(at, wide)
    return p, p - first, p - last


def stretches(chosen: DataFrame, length: int, gram: int, slots: int) -> DataFrame:
    """Of documents with their reaches of interest: doc_id, h, base, single, bucket, low, high, left, right."""
    wide = length - gram + 1
    width = -(-wide // slots)
    core = length - width + 1

    def make():
        def f(columns: list[list]) -> list[list]:
            out: list[list] = [[] for _ in range(9)]
            for d, h, data, wanted in zip(*columns, strict=True):
                for w in wanted:
                    p, first, last = unpacked(w["at"], wide)
                    for j in range(slots):
                        begin = p - width * j  # of the core; the windows start at begin - a
                        low, high = max(0, begin - last), min(width - 1, begin - first)
                        if low > high:
                            continue
                        name = xxhash.xxh3_64_intdigest(data[begin : begin + core], j)
                        row = (d, h, begin, w["single"], signed(name ^ (w["gram"] & (1 << 64) - 1)), low, high, data[begin - high : begin], data[begin + core : begin + core + width - 1 - low])
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            return out

        return f

    kind = chosen.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, h bigint, base bigint, single boolean, bucket bigint, low int, high int, left binary, right binary"
    return map_rows(chosen, make, ddl, chunk=16)


def same_end(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    z = int.from_bytes(x[len(x) - n :], "big") ^ int.from_bytes(y[len(y) - n :], "big")
    return n if not z else ((z & -z).bit_length() - 1) // 8


def same_begin(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    z = int.from_bytes(x[:n], "little") ^ int.from_bytes(y[:n], "little")
    return n if not z else ((z & -z).bit_length() - 1) // 8


def twice(entries: list[tuple[int, int, bytes, bytes]], width: int) -> list[list[tuple[int, int]]]:
    """For each entry (low, high, left, right) of a bucket the ranges of a (bytes before the core) of windows that another entry has too."""
    out: list[list[tuple[int, int]]] = [[] for _ in entries]
    if len(entries) == 2:
        (l1, h1, a, b), (l2, h2, c, d) = entries
        low, high = max(l1, l2, width - 1 - same_begin(b, d)), min(h1, h2, same_end(a, c))
        return [[(low, high)], [(low, high)]] if low <= high else out
    lows, highs = min(e[0] for e in entries), max(e[1] for e in entries)
    for a in range(lows, highs + 1):
        seen: dict[tuple[bytes, bytes], int] = {}
        pairs: set[int] = set()
        for k, (low, high, left, right) in enumerate(entries):
            if low <= a <= high:
                key = (left[len(left) - a :], right[: width - 1 - a])
                first = seen.setdefault(key, k)
                if first != k:
                    pairs.add(first)
                    pairs.add(k)
        for k in pairs:
            if out[k] and out[k][-1][1] == a - 1:
                out[k][-1] = (out[k][-1][0], a)
            else:
                out[k].append((a, a))
    return out


def compared(rows: DataFrame, length: int, gram: int, slots: int) -> DataFrame:
    """doc_id, h, begin, end of byte ranges of the entries whose reach stands once."""
    width = -(-(length - gram + 1) // slots)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([rows.select("doc_id").limit(0).toArrow().schema.field(0), ("h", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def solve(out: list[list]) -> None:
            if len(held) > 1 and any(r[3] for r in held):
                for r, ranges in zip(held, twice([r[5:9] for r in held], width), strict=True):
                    if r[3]:
                        for low, high in ranges:
                            for c, v in zip(out, (r[0], r[1], r[2] - high, r[2] - low + length), strict=True):
                                c.append(v)

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(0, batch.num_rows, 4096):
                for r in zip(*(c.to_pylist() for c in batch.slice(i, 4096).columns), strict=True):
                    if r[4] != bucket:
                        solve(out)
                        bucket, held = r[4], []
                    held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)
        out = [[], [], [], []]
        solve(out)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, f"doc_id {kind}, h bigint, begin bigint, end bigint")


def repeated_ranges(own: DataFrame, length: int = LENGTH, gram: int = GRAM, slots: int = SLOTS) -> DataFrame:
    """doc_id, h, ranges (begin, end; sorted, joined) of rows doc_id, h, data with any."""
    wide = length - gram + 1
    found = samples(own, length, gram)
    reaches = found.groupBy("gram", "reach").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "h", "at")).alias("one"))
    reaches = materialize(reaches, "substrings-reaches")
    several = reaches.groupBy("gram").agg(F.min("reach").alias("u"), F.max("reach").alias("v")).where("u <> v").select("gram")
    wanted = reaches.join(several, "gram", "left_semi").select("gram", (F.col("times") == 1).alias("single"), "one.doc_id", "one.h", "one.at")
    by_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("gram", "single", "at")).alias("wanted"))
    chosen = own.alias("o").join(by_doc.alias("w"), F.col("o.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("o.h") == F.col("w.h")))
    chosen = chosen.select("o.doc_id", "o.h", "o.data", "w.wanted")
    part = compared(stretches(chosen, length, gram, slots), length, gram, slots)
    ties = found.join(reaches.where("times > 1").select("gram", "reach"), ["gram", "reach"], "left_semi")
    packed, p = F.floor(F.col("at") / wide), F.floor(F.col("at") / (wide * wide))
    whole = ties.select("doc_id", "h", (p - F.pmod(packed, F.lit(wide))).alias("begin"), (p - F.pmod("at", F.lit(wide)) + length).alias("end"))
    both = whole.union(part).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("r"))

    def make():
        def f(columns: list[list]) -> list[list]:
            out = []
            for ranges in columns[2]:
                own: list[int] = []
                for r in ranges:
                    if own and r["begin"] <= own[-1]:
                        own[-1] = max(own[-1], r["end"])
                    else:
                        own += [r["begin"], r["end"]]
                out.append(own)
            return [columns[0], columns[1], out]

        return f

    kind = own.schema["doc_id"].dataType.simpleString()
    return materialize(map_rows(both, make, f"doc_id {kind}, h bigint, ranges array<bigint>"), "substrings-ranges")


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), text_bytes(text).alias("data"))


def kept_bytes(data: bytes, ranges: list[int] | None) -> bytes:
    out, at = [], 0
    for k in range(0, len(ranges or ()), 2):
        out.append(data[at : ranges[k]])
        at = ranges[k + 1]
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, slots: int = SLOTS, bytes_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs; with bytes_too also kept (the bytes that remain)."""
    own = keyed(docs)
    ranges = repeated_ranges(own, length, gram, slots)
    total = ranges.agg(F.sum(F.size("ranges")), F.count(F.lit(1))).first()
    small = (total[0] or 0) // 2 + (total[1] or 0) <= BROADCAST_RANGES
    right = F.broadcast(ranges) if small else ranges
    joined = own.alias("o").join(right.alias("r"), F.col("o.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("o.h") == F.col("r.h")), "left")

    def make():
        def f(columns: list[list]) -> list[list]:
            out: list[list] = [[] for _ in range(4 + bytes_too)]
            for data, cut in zip(columns[1], columns[2], strict=True):
                kept = kept_bytes(data, cut)
                row = [len(data), len(data) - len(kept), len(cut or ()) // 2, hashlib.sha256(kept).hexdigest()] + [kept] * bytes_too
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            return [columns[0], *out]

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * bytes_too
    return map_rows(joined.select("o.doc_id", "o.data", "r.ranges"), make, ddl)


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
