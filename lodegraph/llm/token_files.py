"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits, one level each.  A level holds the chunks of the ids that reach it,
a continuation bitmap telling which go on, and a rank directory (ones before each block of 512 bits), so
that any token is found with one look at each level: nothing else has to be decoded.

Documents are dealt by ranges of doc_id; each task encodes its rows in ascending doc_id order and writes files of
at most file_tokens tokens into the shared folder, under names of its own, so that a task that is run again
leaves the files of the first run unread.  The driver sees one line a file (path and counts), from which
it sums the starts.

Null and empty texts hold just the end id.  A null doc_id comes first and stays null; rows that share a doc_id
stand one after the other, by the hash of their texts (xxhash64), then by text.  An empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table

#: Words of Latin-1 without capitals and apostrophes (these bind some letters behind them), and their pieces: runs of letters
#: and of what are none.  The tokenizer always splits between these.
SIMPLE = re.compile("[!-&(-@\\[-¿×ß-ÿ]+").fullmatch
PIECES = re.compile("[a-zªµºß-öø-ÿ]+|[^a-zªµºß-öø-ÿ]+").findall
LETTERS = re.compile("[a-zªµºß-öø-ÿ]+").fullmatch
#: The letters by which the tokenizer spells bytes: printable ones stand for themselves, the others follow from U+0100 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(sorted({*range(256)}.difference(PRINTED)))}
MAGIC = b"DAC1"
BLOCK = 512
END = 1
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file: header, document ids, their starts, levels."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        high = rest >> np.uint32(8)
        goes_on = high > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = np.add.reduceat(POPCOUNT[bits].astype(np.uint64), np.arange(0, len(bits), BLOCK // 8)) if len(bits) else np.zeros(0, np.uint64)
        ranks = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)])
        levels.append((rest.astype(np.uint8), bits, ranks))
        rest = high[goes_on]
        if not len(rest):
            break
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], np.int64)
    starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(lengths, np.uint64), dtype=np.uint64)])
    out = [MAGIC, struct.pack("<QQI", len(ids), len(docs), len(levels)), nulls.tobytes(), docs.tobytes(), starts.tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """Random access to a file's tokens and documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, self.n_docs, n_levels = struct.unpack_from("<QQI", data, 4)
        at = 24

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.nulls, self.docs, self.starts = take(np.uint8, self.n_docs), take(np.int64, self.n_docs), take(np.uint64, self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((take(np.uint8, sizes[0]), take(np.uint8, sizes[1]), take(np.uint64, sizes[2])))

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        begin = block * (BLOCK // 8)
        n = int(ranks[block]) + int(POPCOUNT[bits[begin : i // 8]].sum())
        return n + (bin(int(bits[i // 8]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * level
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i = self.rank(level, i)
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end (exclusive)."""

        def from_level(level: int, a: int, b: int) -> np.ndarray:
            chunks, bits, _ = self.levels[level]
            out = chunks[a:b].astype(np.uint32)
            on = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if on.any():
                first = self.rank(level, a)
                out[on] |= from_level(level + 1, first, first + int(on.sum())) << np.uint32(8)
            return out

        return from_level(0, start, end) if end > start else np.zeros(0, np.uint32)


class Encoder:
    """ids of texts as bytes of little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins what stands at both sides of it, nor letters with what are none, so a text's
    ids are those of such pieces, one after the other.  Pieces met before come from a cache of bounded size."""

    def __init__(self, path: str, cache_size: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        self.cache_size = cache_size

    def add(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                self.cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def add_letters(self, words: set[str]) -> None:
        """Runs of Latin-1 letters in lower case: normalisation and splitting leave them as they are, so they go to the merges at once."""
        tokenize, cache = self.tokenizer.model.tokenize, self.cache
        for w in words:
            spelled = w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = [t.id for t in tokenize(spelled)]
            cache[w] = struct.pack(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> list[str]:
        """Words between blanks; in lower case where that is plain (Latin-1, and no special token, which is known by its case)."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        return (text if "<|" in text else text.lower()).replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.cache) > self.cache_size:
            self.cache = {"": b""}
        cache = self.cache
        missing = set().union(*split).difference(cache)
        parts = {w: PIECES(w) for w in missing if SIMPLE(w) and "<|" not in w}
        wanted = set().union(*parts.values()).difference(cache)
        letters = {x for x in wanted if LETTERS(x)}
        self.add_letters(letters)
        self.add([*missing.difference(parts), *(wanted - letters)])
        for w, pieces in parts.items():
            if len(pieces) > 1:
                cache[w] = b"".join(map(cache.__getitem__, pieces))
        return [b"".join(map(cache.__getitem__, words)) for words in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder a worker process: its cache serves all tasks that the process runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def store(uri: str) -> tuple:
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_files(docs: DataFrame, folder: str, tokenizer: str, file_tokens: int = 8_000_000) -> list[tuple[str, int, int]]:
    """Encodes docs (doc_id, text) into files in folder; gives (URI, documents, tokens) a file, in doc_id order."""
    end = struct.pack("<I", END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        system, base = store(folder)
        ids: list[bytes] = []
        docs_in: list[int | None] = []
        lengths: list[int] = []
        held = number = 0

        def put() -> pa.RecordBatch:
            nonlocal held, number
            name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex[:8]}.dac"
            with system.open_output_stream(f"{base}/{name}.tmp") as f:
                f.write(pack(np.frombuffer(b"".join(ids), np.uint32), docs_in, lengths))
            system.move(f"{base}/{name}.tmp", f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "uri": [f"{folder}/{name}"], "docs": [len(docs_in)], "tokens": [held]})
            ids.clear()
            docs_in.clear()
            lengths.clear()
            held, number = 0, number + 1
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                doc_ids, texts = (c.to_pylist() for c in batch.slice(i, 512).columns)
                for d, x in zip(doc_ids, encoder.encode(texts), strict=True):
                    x += end
                    n = len(x) // 4
                    if held and held + n > file_tokens:
                        yield put()
                    ids.append(x)
                    docs_in.append(d)
                    lengths.append(n)
                    held += n
        if docs_in:
            yield put()

    system, base = store(folder)
    system.create_dir(base, recursive=True)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    ordered = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    rows = ordered.mapInArrow(run, "part bigint, number bigint, uri string, docs bigint, tokens bigint").collect()
    return [(r["uri"], r["docs"], r["tokens"]) for r in sorted(rows, key=lambda r: (r["part"], r["number"]))]


def read_files(spark: SparkSession, files: Iterable[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files."""
    start, rows = 0, []
    for uri, _, tokens in files:
        rows.append((uri, start))
        start += tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, path = store(uri)
                with system.open_input_file(path) as f:
                    file = TokenFile(f.read())
                out: list[list] = [[], [], [], []]
                ids = memoryview(file.tokens(0, file.n_tokens).astype("<u4").tobytes())
                starts = file.starts.tolist()
                for d, null, a, b in zip(file.docs.tolist(), file.nulls.tolist(), starts[:-1], starts[1:], strict=True):
                    for c, v in zip(out, (None if null else d, first + a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not rows:
        return spark.createDataFrame([], ddl)
    return spark.createDataFrame(rows, "uri string, first bigint").repartition(len(rows), "uri").mapInArrow(run, ddl)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_files(spark, write_files(docs, scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))
