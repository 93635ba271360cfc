"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The piece table is given (a model file).  Where its scores are merge ranks, log scores are made of
the ranks by Zipf's law.  A text becomes a marker (U+2581) and itself with blanks as markers; no piece holds a marker
behind another character, and none holds a line feed, so the best path of a text is that of its
stretches, one after the other: marker runs with what follows them, and line feeds.  Stretches met before come from
a cache of bounded size; new ones of usual length are solved together, a step for all of them at a time.
A character without a piece of its own costs the least score less 10 and is written as its bytes.
Of equally good paths the one whose last pieces start earliest counts.

Decoding joins pieces, turns markers into blanks, drops the first one and reads bytes as UTF-8.  It gives the text
back, save that a U+2581 of the text comes back as a blank.  Null and empty texts have no pieces.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

MARK = "▁"
STRETCH = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
UNKNOWN_PENALTY = 10.0
#: Longer stretches are solved one by one.
TOGETHER = 40


class Pieces(NamedTuple):
    texts: list[str]
    scores: list[float]
    byte_ids: list[int]  # ids of the 256 byte pieces
    special: frozenset[int]  # ids that no text gives: unknown, controls, bytes

    @staticmethod
    def read(path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        texts = [m.id_to_piece(i) for i in range(n)]
        bytes_ = {texts[i]: i for i in range(n) if m.is_byte(i)}
        special = frozenset(i for i in range(n) if m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        scores = [m.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if i not in special and scores[i] > -1e8]
        if all(scores[i] == round(scores[i]) for i in plain):  # merge ranks
            for i in plain:
                scores[i] = float(np.float32(-np.log(2.7 - scores[i])))
            for i in range(n):
                scores[i] = max(scores[i], -1e6)
        return Pieces(texts, scores, [bytes_[f"<0x{b:02X}>"] for b in range(256)], special)


class Trie:
    """A double array: from state s by code c to base[s] + c, if check there is s.  value: the piece that ends there, or -1."""

    def __init__(self, words: dict[str, int]):
        letters = sorted({c for w in words for c in w})
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for w, v in words.items():
            s = 0
            for c in w:
                c = self.code[c]
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    values.append(-1)
                s = children[s][c]
            values[s] = v
        size = 2 * len(children) + len(letters) + 2
        base, check, value = [0] * size, [-1] * size, [-1] * size
        following = list(range(size + 1))  # of each cell the next free one, itself if it is free

        def free(cell: int) -> int:
            while cell >= len(following) - 1:
                following.extend(range(len(following), 2 * len(following)))
            seen = []
            while following[cell] != cell:
                seen.append(cell)
                cell = following[cell]
            for x in seen:
                following[x] = cell
            return cell

        following[0] = 1
        place = {0: 0}
        value[0] = values[0]
        hint = 0
        for s in self._levels(children):
            own = sorted(children[s])
            if not own:
                continue
            low, tries = own[0], 0
            cell = free(max(low, 1) if len(own) == 1 else max(hint + low, 1))
            while any(free(cell - low + c) != cell - low + c for c in own[1:]):
                cell, tries = free(cell + 1), tries + 1
            if tries > 50:  # it is full below: nodes with several children are not tried there again
                hint = cell - low
            b = cell - low
            while b + own[-1] >= len(base):
                base, check, value = base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value)
            at = place[s]
            base[at] = b
            for c in own:
                t = children[s][c]
                following[b + c] = b + c + 1
                check[b + c] = at
                value[b + c] = values[t]
                place[t] = b + c
        base, check, value = (np.array(x, np.int64) for x in (base, check, value))
        room = len(letters) + 2
        self.base, self.check, self.value = (np.concatenate([x, np.full(room, fill, np.int64)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
        self.longest = max(map(len, words), default=0)

    @staticmethod
    def _levels(children: list[dict[int, int]]) -> list[int]:
        out = [0]
        for s in out:
            out.extend(children[s].values())
        return out


class Codec:
    def __init__(self, pieces: Pieces, cache_size: int = 300_000):
        self.pieces = pieces
        words = {t: i for i, t in enumerate(pieces.texts) if i not in pieces.special}
        if any(MARK in t.lstrip(MARK) or "\n" in t for t in words):
            raise ValueError("a piece holds a marker behind another character, or a line feed")
        self.trie = Trie(words)
        self.scores = np.array(pieces.scores, np.float64)
        self.unknown = float(min((pieces.scores[i] for i in words.values()), default=0.0)) - UNKNOWN_PENALTY
        self.cache_size = cache_size
        self.reset()

    def reset(self) -> None:
        self.cache: dict[str, bytes] = {}
        self.lists = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "cache": {}, "lists": None}

    def spell(self, text: str, path: list[tuple[int, int]]) -> bytes:
        """ids of a path of (end, piece), as bytes; piece -1 becomes its characters' bytes."""
        ids, at = [], 0
        for end, p in path:
            if p < 0:
                ids += [self.pieces.byte_ids[b] for b in text[at:end].encode("utf-8", "surrogatepass")]
            else:
                ids.append(p)
            at = end
        return np.array(ids, np.uint32).tobytes()

    def solve(self, text: str) -> bytes:
        """One stretch of any length."""
        if self.lists is None:
            self.lists = (self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist())
        base, check, value, scores = self.lists
        codes = [self.trie.code.get(c, 0) for c in text]
        n = len(codes)
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for s in range(n):
            here, state, k, single = best[s], 0, s, False
            while k < n and codes[k]:
                t = base[state] + codes[k]
                if check[t] != state:
                    break
                state, k = t, k + 1
                v = value[t]
                if v >= 0:
                    single = single or k == s + 1
                    if here + scores[v] > best[k]:
                        best[k], back[k], piece[k] = here + scores[v], s, v
            if not single and here + self.unknown > best[s + 1]:
                best[s + 1], back[s + 1], piece[s + 1] = here + self.unknown, s, -1
        path, at = [], n
        while at:
            path.append((at, piece[at]))
            at = back[at]
        return self.spell(text, path[::-1])

    def solve_all(self, texts: list[str]) -> list[bytes]:
        """Stretches of at most TOGETHER characters, all at once."""
        n, length = len(texts), max(map(len, texts))
        codes = np.zeros((length, n), np.int64)
        lens = np.array([len(t) for t in texts])
        code = self.trie.code
        for k, t in enumerate(texts):
            codes[: len(t), k] = [code.get(c, 0) for c in t]
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        back = np.zeros((length + 1, n), np.int16)
        piece = np.full((length + 1, n), -1, np.int32)
        for s in range(length):
            rows = np.flatnonzero(lens > s)
            state = np.zeros(len(rows), np.int64)
            lonely = np.ones(n, bool)
            active = rows
            for k in range(s, min(length, s + self.trie.longest)):
                c = codes[k, active]
                t = base[state] + c
                good = (c > 0) & (check[t] == state)
                active, state = active[good], t[good]
                if not len(active):
                    break
                v = value[state]
                ends = v >= 0
                own, v = active[ends], v[ends]
                if k == s:
                    lonely[own] = False
                score = best[s, own] + scores[v]
                better = score > best[k + 1, own]
                own = own[better]
                best[k + 1, own], back[k + 1, own], piece[k + 1, own] = score[better], s, v[better]
            own = rows[lonely[rows]]
            better = best[s, own] + self.unknown > best[s + 1, own]
            own = own[better]
            best[s + 1, own], back[s + 1, own], piece[s + 1, own] = best[s, own] + self.unknown, s, -1
        back_by, piece_by = back.T.tolist(), piece.T.tolist()
        out = []
        for k, t in enumerate(texts):
            path, at = [], len(t)
            while at:
                path.append((at, piece_by[k][at]))
                at = back_by[k][at]
            out.append(self.spell(t, path[::-1]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text, as bytes of unsigned 32-bit integers."""
        split = [STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > self.cache_size:
            self.cache = {}
        cache = self.cache
        missing = {w for words in split for w in words if w not in cache}
        short = sorted((w for w in missing if len(w) <= TOGETHER), key=len)
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            cache.update(zip(part, self.solve_all(part), strict=True))
        for w in missing:
            if len(w) > TOGETHER:
                cache[w] = self.solve(w)
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in missing:
            if len(w) > 4 * TOGETHER:
                del cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        if not hasattr(self, "spelled"):
            own = [t.replace(MARK, " ").encode() for t in self.pieces.texts]
            for b, i in enumerate(self.pieces.byte_ids):
                own[i] = bytes([b])
            self.spelled = own
        text = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, np.uint32).tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model: str, keep: list[str], ids: bool = False) -> DataFrame:
    """The columns keep of docs with n_pieces, n_fallback (byte pieces), ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers), decoded_chars, round_trip (decoding gives the text back); with ids also piece_ids."""
    sent = docs.sparkSession.sparkContext.broadcast(Codec(Pieces.read(model)))
    own = ("n_pieces", "n_fallback", "ids_crc32", "decoded_chars", "round_trip", "piece_ids")
    keep = [c for c in keep if c not in own]
    width = len(keep)

    def make():
        codec = sent.value
        is_byte = np.zeros(len(codec.pieces.texts), bool)
        is_byte[codec.pieces.byte_ids] = True

        def f(columns: list[list]) -> list[list]:
            out: list[list] = [[] for _ in range(5 + ids)]
            for text, x in zip(columns[width], codec.encode(columns[width]), strict=True):
                array = np.frombuffer(x, np.uint32)
                back = codec.decode(x)
                row = [len(array), int(is_byte[array].sum()), zlib.crc32(x), len(back), back == text.replace(MARK, " ")]
                for c, v in zip(out, row + [array.astype(np.int32)] * ids, strict=True):
                    c.append(v)
            return [*columns[:width], *out]

        return f

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    ddl = ", ".join([*kinds, "n_pieces bigint, n_fallback bigint, ids_crc32 bigint, decoded_chars bigint, round_trip boolean"] + ["piece_ids array<int>"] * ids)
    return map_rows(docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")), make, ddl)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
