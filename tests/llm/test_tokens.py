"""Token files and pieces: exact round trips, the libraries' own results, brute force."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from lodegraph.llm import pieces, token_files

from .helpers import documents, odd_texts


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 200_000, 37))])
def test_codes_give_every_token_back(ids):
    file = token_files.TokenFile(token_files.pack(np.array(ids, np.uint32), [1], [len(ids)]))
    assert file.tokens(0, len(ids)).tolist() == ids
    rnd = random.Random(1)
    for i in [rnd.randrange(len(ids)) for _ in range(300)] if ids else []:
        assert file.token(i) == ids[i]
        j = rnd.randint(i, len(ids))
        assert file.tokens(i, j).tolist() == ids[i:j]


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = odd_texts() + ["<|endoftext|> Σας ΣΑΣ x\x1fý z w", "Á ́b"]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 9")).union(docs.where("doc_id = 3").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars"))
    files = token_files.write_files(docs, token_files.scratch(spark, "tokens"), path, file_tokens=2000)
    assert len(files) > 3
    rows = token_files.read_files(spark, files).collect()
    by_id = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_id] == [None, *sorted([*range(len(texts)), 9])]
    start = 0
    for r in by_id:
        text = texts[3 if r["doc_id"] is None else r["doc_id"]] or ""
        ids = plain.encode(text, add_special_tokens=False).ids + [1]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), text[:60]
        start += len(ids)


def test_token_files_of_an_empty_table(spark):
    files = token_files.write_files(documents(spark, ["x"]).where("false"), token_files.scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"))
    assert files == [] and token_files.read_files(spark, files).count() == 0


def varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(number: int, data: bytes | int) -> bytes:
    return varint(number << 3) + varint(data) if isinstance(data, int) else varint(number << 3 | 2) + varint(len(data)) + data


def unigram_model(own: pieces.Pieces) -> bytes:
    """The pieces and scores as a unigram model of the library."""
    out = b""
    for i, (t, s) in enumerate(zip(own.texts, own.scores, strict=True)):
        kind = 6 if i in own.byte_ids else 2 if i == 0 else 3 if i in own.special else 1
        out += field(1, field(1, t.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, kind))
    trainer = field(3, 1) + field(4, len(own.texts)) + field(35, 1)
    normalizer = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return out + field(2, trainer) + field(3, normalizer)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.Pieces.read(public_tokenizers.path("piece_bpe_32k.model")))


def test_pieces_agree_with_the_library(codec):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(codec.pieces))
    texts = [t for t in odd_texts() if t and len(t) < 5000] + ["Hello  world\n x é  ", "日本語 テキスト 🙂", "supercalifragilistic" * 9]
    for t, x in zip(texts, codec.encode(texts), strict=True):
        ids = np.frombuffer(x, np.uint32).tolist()
        assert ids == library.encode(t), t[:60]
        assert codec.decode(x) == t


def test_pieces_against_brute_force():
    texts = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "a", "b", "ab", "▁a", "abb", "ba"]
    own = pieces.Pieces(texts, [0.0] * 257 + [-2.0, -1.5, -1.7, -2.2, -2.0, -3.1, -2.9], list(range(1, 257)), frozenset(range(257)))
    small = pieces.Codec(own)
    known = {t: i for i, t in enumerate(texts) if i > 256}

    def best(s: str):
        if not s:
            return 0.0, []
        found = None
        for n in range(1, min(4, len(s)) + 1):
            score, ids = best(s[n:])
            if s[:n] in known:
                got = (score + own.scores[known[s[:n]]], [known[s[:n]], *ids])
            elif n == 1:
                got = (score + small.unknown, [1 + b for b in s[0].encode()] + ids)
            else:
                continue
            if found is None or got[0] > found[0]:
                found = got
        return found

    rnd = random.Random(2)
    for _ in range(200):
        s = "".join(rnd.choice("abbaé c") for _ in range(rnd.randint(1, 10)))
        ids = np.frombuffer(small.encode([s])[0], np.uint32).tolist()
        marked = "▁" + s.replace(" ", "▁")
        price = sum(own.scores[i] if i > 256 else 0 for i in ids) + small.unknown * sum(c in "éc" for c in s)
        assert price == pytest.approx(best(marked)[0]) and small.decode(small.encode([s])[0]) == s


def test_long_and_short_stretches_agree(codec):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("▁aethrnonésß日") for _ in range(rnd.randint(1, pieces.TOGETHER))) for _ in range(500)]
    assert codec.solve_all(words) == [codec.solve(w) for w in words]


def test_piece_rows(spark):
    texts = odd_texts() + ["a ▁ b"]
    rows = pieces.encode_documents(documents(spark, texts), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"], ids=True).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] for r in rows)
    assert all(len(r["piece_ids"]) == r["n_pieces"] and zlib.crc32(struct.pack(f"<{r['n_pieces']}I", *r["piece_ids"])) == r["ids_crc32"] for r in rows)
    assert [r["n_pieces"] for r in rows if not texts[r["doc_id"]]] == [0, 0]
