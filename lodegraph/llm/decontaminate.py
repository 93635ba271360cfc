"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds all word sequences of all items.  A document's words stream through it; state and
length give, at each word, the longest sequence that ends there and stands in some item.  Where the
length reaches a window (n words, or a whole shorter item), the window's words are hit, and the automaton's
states tell which items have that window.

Items come to the driver in blocks of at most block_words words; each block's automaton is broadcast,
so that what is broadcast has a bound whatever the benchmark's size.  Documents are never shuffled.

Null or empty texts have no words.  Items without words or with a null id count for nothing.  Repeated
documents give repeated rows; an empty benchmark hits nothing.  In find_hits, columns of the input with the
names of results give way to the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, map_rows, materialize, renamed, table, text_bytes

WINDOW = 8
BLOCK_WORDS = 400_000


def words_of(data: bytes) -> list[bytes]:
    return data.translate(ALNUM).split()


class Automaton:
    """A generalised suffix automaton over the words of items."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.ids: list[str] = []
        texts: list[list[int]] = []
        for item, words in items:
            if not words:
                continue
            self.ids.append(item)
            texts.append([self.vocab.setdefault(w, len(self.vocab)) for w in words])
            last = 0
            for w in texts[-1]:
                last = self._extend(last, w)
        self._owners(texts)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.len[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def _state(self, nxt: dict[int, int], length: int, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _owners(self, texts: list[list[int]]) -> None:
        """at[state]: (window length, items) of the windows that are suffixes of the state's strings, longest first."""
        owner: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        for k, words in enumerate(texts):
            whole, state, have = len(words) < self.window, 0, 0
            for w in words:
                state, have = self.next[state][w], have + 1
                while self.len[self.link[state]] >= self.window and have > self.window:
                    state = self.link[state]
                have = min(have, self.len[state])
                if have >= self.window:
                    owner.setdefault(state, set()).add(k)
            if whole:
                short.setdefault(state, set()).add(k)
        self.at: list[tuple[tuple[int, tuple[int, ...]], ...]] = []
        lengths = {s: len(texts[min(ks)]) for s, ks in short.items()}
        order = sorted(range(len(self.next)), key=self.len.__getitem__)
        at: list[tuple] = [()] * len(order)
        for s in order:
            above = at[self.link[s]] if s else ()
            own = []
            if self.len[s] >= self.window > self.len[self.link[s]] and s:
                own.append((self.window, tuple(sorted(owner.get(s, ())))))
            if s in short:
                own.append((lengths[s], tuple(sorted(short[s]))))
            at[s] = tuple(own) + above
        self.at = at
        self.least = min([self.window, *(n for x in at for n, _ in x)])

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Maximal runs of hit words (start, end), the items with windows there, and the longest match."""
        nxt, link, length, at, least = self.next, self.link, self.len, self.at, self.least
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        state = have = longest = 0
        get = self.vocab.get
        for i, w in enumerate(map(get, words)):
            to = nxt[state].get(w)
            if to is None:
                if w is None:
                    state = have = 0
                    continue
                while to is None and state:
                    state = link[state]
                    to = nxt[state].get(w)
                if to is None:
                    have = 0
                    continue
                have = length[state]
            state = to
            have += 1
            if have >= least:
                longest = max(longest, have)
                for n, owners in at[state]:
                    if n <= have and owners:
                        items.update(owners)
                        start = i + 1 - n
                        while runs and runs[-1][1] >= start:
                            start = min(start, runs.pop()[0])
                        runs.append((start, i + 1))
        return runs, items, longest


def merged(runs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(items: DataFrame, block_words: int, window: int) -> Iterator[Automaton]:
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t"))
    for r in rows.orderBy("i").toLocalIterator():
        words = words_of(bytes(r["t"]))
        if part and size + len(words) > block_words:
            yield Automaton(part, window)
            part, size = [], 0
        part.append((r["i"], words))
        size += len(words)
    yield Automaton(part, window)


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None, max_span: int = 0) -> DataFrame:
    """The columns keep of docs (all, if none are named) with n_words, hit_starts, hit_ends (maximal runs of hit
    words) and hit_items (sorted strings); with max_span also clean_text, without the runs of that many words."""
    own = ("n_words", "hit_starts", "hit_ends", "hit_items", "clean_text")
    rest = [c for c in (docs.columns if keep is None else keep) if c not in own]
    types = {f.name: f.dataType.simpleString() for f in docs.select(*rest).schema}
    none = F.array()
    df = docs.select(*rest, text_bytes().alias("_data"), none.cast("array<int>").alias("_s"), none.cast("array<int>").alias("_e"), none.cast("array<string>").alias("_i"))
    blocks = blocks_of(items, block_words, window)
    automaton: Automaton | None = next(blocks)
    while automaton is not None:
        following = next(blocks, None)
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def make(sent=sent, width=len(rest), last=following is None):
            a = sent.value

            def f(columns: list[list]) -> list[list]:
                data, s, e, i = columns[width : width + 4]
                n, clean = [], []
                for r, x in enumerate(data):
                    words = words_of(x)
                    n.append(len(words))
                    runs, found, _ = a.match(words)
                    if runs:
                        runs = merged([*zip(s[r], e[r], strict=True), *runs])
                        s[r], e[r] = [x for x, _ in runs], [x for _, x in runs]
                        i[r] = sorted({*i[r], *(a.ids[k] for k in found)})
                    if last and max_span:
                        clean.append(cut(x, [(b, c) for b, c in zip(s[r], e[r], strict=True) if c - b >= max_span]).decode())
                if not last:
                    return [*columns[:width], data, s, e, i]
                return [*columns[:width], s, e, i, n, *([clean] if max_span else [])]

            return f

        ddl = [f"`{k}` {v}" for k, v in types.items()] + ["_data binary"] * (following is not None) + ["_s array<int>", "_e array<int>", "_i array<string>"]
        if following is None:
            ddl += ["n_words bigint"] + ["clean_text string"] * bool(max_span)
        df = map_rows(df, make, ", ".join(ddl))
        if following is not None:
            df = materialize(df, "decontaminate")
        automaton = following
    return df.withColumnsRenamed({"_s": "hit_starts", "_e": "hit_ends", "_i": "hit_items"})


def n_hit() -> Column:
    return F.aggregate(F.zip_with("hit_ends", "hit_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda a, x: a + x)


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the given runs (start, end); what stands between removed words goes too."""
    if not spans:
        return data
    plain = data.translate(ALNUM)
    bounds = [m.span() for m in re.finditer(rb"[^ ]+", plain)]
    out, keep_from = [], 0
    for a, b in sorted(spans):
        out.append(data[keep_from : bounds[a][0]])
        keep_from = bounds[b - 1][1]
    return b"".join([*out, data[keep_from:]])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = 8, max_coverage: float = 0.5) -> DataFrame:
    """docs (with text, n_chars) without hit runs of max_span words or more, and without whole items of fewer words than a window; without
    documents of which hit runs cover more than max_coverage of the words, and without those of which removal leaves no word.
    All others stay as they are, and so do all columns, whatever they are called."""
    own, back = renamed(docs)
    # a run shorter than a window is a whole item
    found = find_hits(own, items, window, keep=[c for c in own.columns if c != "text"], max_span=max_span if max_span > window else 1)
    left = found.where((F.size("hit_ends") == 0) | ((n_hit() <= max_coverage * F.col("n_words")) & (n_hit() < F.col("n_words"))))
    return back(left.withColumn("text", F.col("clean_text")), measured=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]).select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_items") >= 2).alias("contaminated"),
    )
