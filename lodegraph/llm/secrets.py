"""Secret scans with one deterministic automaton of all rules.

The rules' regexes, each up to the point where a match is certain, are compiled into one byte
automaton (subset construction, minimisation, transition array) that scans a text once and tells which
rules have a match in it.  Only for those rules, the rule's own anchored automaton then finds the spans:
leftmost, longest, without overlap within a rule, and after that the rule's least length decides.

Null and empty texts have no spans.  Offsets are code points, the end exclusive.  Rows repeat as the
input's do.  In scan, columns of the input with the names of results give way to them.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .automata import Dfa, parse
from .common import map_rows, renamed, table, text_bytes


class Rule(NamedTuple):
    name: str
    pattern: bytes  # the whole match
    value: bytes  # what stands before the part that is measured
    least: int  # bytes that the measured part has at least
    certain: bytes  # every match that is long enough begins with this; short, so that counters of rules do not multiply
    fold: bool = False


# The three base kinds and common credential formats.
KEY = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", KEY + rb"[A-Za-z0-9+/_.=-]+", KEY, 12, KEY + rb"[A-Za-z0-9+/_.=-]{4}", True),
    Rule("access", rb"AKIA[A-Z0-9]+", b"", 18, rb"AKIA[A-Z0-9]{2}"),
    Rule("hex", rb"[0-9a-f]+", b"", 16, rb"[0-9a-f]{16}"),
    Rule("private_key", rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", b"", 1, rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]+", b"", 40, rb"gh[pousr]_[A-Za-z0-9]"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", b"", 15, rb"xox[abprs]-"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", b"", 40, rb"eyJ[A-Za-z0-9]"),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", b"", 39, rb"AIza"),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Dfa([parse(r.certain, r.fold) for r in rules], search=True)
        self.own = [Dfa([parse(r.pattern, r.fold)], search=False) for r in rules]
        self.before = [Dfa([parse(r.value, r.fold)], search=False) if r.value else None for r in rules]
        self.dead = [d.dead() for d in self.own]

    def bytes_of(self, k: int, data: bytes) -> list[tuple[int, int]]:
        dfa, dead, before, least = self.own[k], self.dead[k], self.before[k], self.rules[k].least
        begins = [dfa.table[dfa.start + b] != dead for b in range(256)]
        out, at, n = [], 0, len(data)
        while at < n:
            if begins[data[at]] and (end := dfa.longest(data, at, dead)) > at:
                measured = before.longest(data, at, before.dead()) if before else at
                if end - measured >= least:
                    out.append((at, end))
                at = end
            else:
                at += 1
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, sorted."""
        mask = self.all.hits(data)
        if not mask:
            return []
        found = [(a, k, b) for k in range(len(self.rules)) if mask >> k & 1 for a, b in self.bytes_of(k, data)]
        if data.isascii():
            return sorted(found)
        place, chars, last = {}, 0, 0
        for x in sorted({x for a, _, b in found for x in (a, b)}):
            chars += len(data[last:x].decode("utf-8", "replace"))
            place[x], last = chars, x
        return sorted((place[a], k, place[b]) for a, k, b in found)


def written(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].name}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, keep: list[str], rules: tuple[Rule, ...] = RULES, redact: bool = False) -> DataFrame:
    """The columns keep of docs with n_assign, n_access, n_hex, base_sha256 and spans; with redact also clean_text,
    in which each stretch that spans cover stands as [SECRET]."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Scanner(rules))
    keep = [c for c in keep if c not in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text")]
    width = len(keep)

    def make():
        scanner = sent.value
        base = [k for k, r in enumerate(rules) if r.name in BASE]

        def f(columns: list[list]) -> list[list]:
            counts: list[list[int]] = [[], [], []]
            digest, written_out, clean = [], [], []
            for data in columns[width]:
                spans = scanner.spans(data)
                for c, k in zip(counts, base, strict=True):
                    c.append(sum(x[1] == k for x in spans))
                digest.append(hashlib.sha256(written([x for x in spans if x[1] in base], rules).encode()).hexdigest())
                written_out.append(written(spans, rules))
                if redact:
                    clean.append(without(data.decode(), spans) if spans else data.decode())
            return [*columns[:width], *counts, digest, written_out, *([clean] if redact else [])]

        return f

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    ddl = f"{kinds}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string" + ", clean_text string" * redact
    return map_rows(docs.select(*keep, text_bytes().alias("_data")), make, ddl)


def without(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for a, _, b in spans:
        if a >= last:
            out += [text[last:a], "[SECRET]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in the text (and n_chars) replaced by [SECRET]; no row goes, and all columns stay, whatever they are called."""
    from pyspark.sql import functions as F

    own, back = renamed(docs)
    df = scan(own, [c for c in own.columns if c != "text"], rules, redact=True)
    return back(df.withColumn("text", F.col("clean_text")), measured=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
