"""Operators that look at one row at a time, against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from lodegraph.llm import decontaminate, html, licenses, quality, secrets
from lodegraph.llm.automata import Dfa, parse

from .helpers import SF, documents, odd_texts

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def texts_of(spark):
    return odd_texts() + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_quality_figures(spark):
    texts = texts_of(spark)
    rows = {r["doc_id"]: r for r in quality.apply_rules(documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        t = t or ""
        words = SPACED.findall(t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if SPACED.search(x)]
        want = (len(words), sum(map(len, words)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered))
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t[:80]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (r["rejected_by"] is None) and not (failed and r["kept"])


def test_quality_long_texts_take_the_wide_key(spark, monkeypatch):
    monkeypatch.setattr(quality, "PACKED", 16)
    t = "a b c d a b c e " * 5
    assert quality.figures(documents(spark, [t])).first()["n_repeat_words"] == 40


def test_quality_order_puts_cheap_rejections_first(spark):
    texts = ["word ### " * 60] * 40 + ["plain words of many kinds"] * 10
    assert quality.order_rules(quality.figures(documents(spark, texts)))[0] == "symbols"


def test_quality_order_is_not_led_by_noise_of_the_clock(spark, monkeypatch):
    """Three rounds each of a rule without work, of symbols, and of letters, whose least time is the smaller one here."""
    took = iter([0.010] * 3 + [0.013] * 3 + [0.0101] * 3)
    now = [0.0, 0]

    def clock():
        now[1] += 1
        now[0] += next(took) if now[1] % 2 == 0 else 0
        return now[0]

    monkeypatch.setattr(quality.time, "perf_counter", clock)
    texts = ["word ### " * 60] * 40 + ["plain words of many kinds"] * 10
    assert quality.order_rules(quality.figures(documents(spark, texts)))[0] == "symbols"


def test_quality_keeps_labelled_good(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.apply_rules(docs).join(labels.where("quality = 1"), "doc_id")
    assert got.where("not kept and not base_failed").count() == 0


def brute_hits(words, items):
    hit, found = set(), set()
    for item, own in items:
        n = min(8, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [400_000, 30])
def test_decontaminate(spark, block_words):
    rnd = random.Random(3)
    vocab = ["ab", "cd", "ef"]
    items = [(k, " ".join(rnd.choice(vocab) for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 7, 8, 9, 12, 20, 8, 3])]
    items += [(50, None), (51, "The quick, brown fox"), (52, "THE quick brown fox")]
    texts = [" ".join(rnd.choice([*vocab, "zz"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + odd_texts() + ["see the-QUICK brown  fox!"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.find_hits(documents(spark, texts), bench, block_words=block_words, keep=["doc_id"]).withColumn("n_hit", decontaminate.n_hit()).collect()}
    own = [(k, PLAIN.findall(low(t))) for k, t in items if t]
    for k, t in enumerate(texts):
        words = PLAIN.findall(low(t))
        assert (rows[k]["n_hit"], rows[k]["hit_items"]) == brute_hits(words, own), (t or "")[:80]
        assert rows[k]["n_words"] == len(words)


def test_decontaminate_removes_spans(spark):
    item = "one two three four five six seven eight nine"
    texts = [f"Before, {item.upper()} after words stand here and here and here", item, "clean text", None]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(documents(spark, texts), bench).collect()}
    assert set(got) == {0, 2, 3}
    assert got[0]["text"] == "Before,  after words stand here and here and here" and got[0]["n_chars"] == len(got[0]["text"])
    assert got[2]["text"] == "clean text"
    short = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    cut = decontaminate.decontaminate(documents(spark, ["x y Alpha, beta z w v"]), short).first()
    assert cut["text"] == "x y  z w v"
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_hits(documents(spark, texts), none, keep=["doc_id"]).where("size(hit_items) > 0").count() == 0


def test_query_columns(spark):
    got = decontaminate.op2_decontaminate(spark, SF).where("n_items = 0").first()
    assert got["items_sha256"] == hashlib.sha256(b"").hexdigest() and not got["contaminated"]


def brute_secrets(text):
    kinds = (
        (r"((?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 12, re.I | re.A),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, 0),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 16, 0),
    )
    return sorted((m.start(), k, m.end()) for k, (p, ok, flags) in enumerate(kinds) for m in re.finditer(p, text, flags) if ok(m))


def test_secrets(spark):
    rnd = random.Random(1)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCDEF", "0123456789abcdef", "deadbeef", "x", "é", "==", ".", "-", "zzzzzzzzzz", "ghp_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)] + texts_of(spark)
    rows = secrets.scan(documents(spark, texts), ["doc_id"]).collect()
    names = [r.name for r in secrets.RULES]
    for r in rows:
        want = brute_secrets(texts[r["doc_id"]] or "")
        got = [(int(a), names.index(k), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert [x for x in got if x[1] < 3] == want, texts[r["doc_id"]]
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[1] == k for x in want) for k in range(3)]


def test_redaction_takes_only_the_secret(spark):
    texts = ['say token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and more', "clean", None]
    got = {r["doc_id"]: r for r in secrets.redact_secrets(documents(spark, texts)).collect()}
    assert got[0]["text"] == 'say [SECRET]" and more' and got[0]["n_chars"] == len(got[0]["text"])
    assert got[1]["text"] == "clean"


def test_automaton_agrees_with_re():
    rnd = random.Random(5)
    for p in (rb"ab?c*", rb"(a|bc)+d", rb"[a-c]{2,3}d", rb"a[^b]c", rb"x(ab){2}"):
        dfa, r = Dfa([parse(p)], search=True), re.compile(p)
        for _ in range(500):
            data = bytes(rnd.choice(b"abcdx") for _ in range(rnd.randint(0, 9)))
            assert bool(dfa.hits(data)) == bool(r.search(data)), (p, data)


def test_licenses(spark):
    extra = [
        "Released under the MIT License.", "mit  LICENSE mit-license Mit. License", "Licensed under the Apache License, Version 2.0.", "apache licenses",
        "GNU General Public License, general public license", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    texts = extra + texts_of(spark)
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for k, t in enumerate(texts):
        words = PLAIN.findall(low(t))
        starts = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
        r = rows[k]
        assert (r["n_words"], r["n_base"]) == (len(words), len(starts))
        assert (r["first_word"], r["last_word"]) == ((starts[0][0], starts[-1][0]) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in starts})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert [rows[k]["labels"] for k in (0, 2, 5, 6, 7)] == ["MIT,mit", "Apache-2.0,apache", "GPL,gpl", "CC-BY", ""]


def test_license_template_markup():
    t = licenses.Template("x", "alpha <<optional>> beta <<any c|d>> <<end>> <<fill 1-3>> omega")
    at = lambda s: t.at(s.encode().split(), 0)
    assert [at(s) for s in ("alpha beta c q omega", "alpha q omega", "alpha q r s omega x", "alpha omega", "alpha q r s t omega", "alpha beta q omega")] == [5, 3, 5, -1, -1, 4]


def test_license_full_text():
    words = licenses.TEMPLATES["MIT"][1].replace("<<optional>> (including the next paragraph) <<end>>", "").replace("<<fill 1-20>>", "THE AUTHORS OR COPYRIGHT HOLDERS")
    own = licenses.compiled()
    assert [x[0] for x in licenses.scan_words(words.encode(), own)[3]] == ["MIT"]
    assert licenses.scan_words(words.replace("sublicense", "relicense").encode(), own)[3] == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now please.</div><article><h1>Head &amp; line</h1><p>First  <b>bold</b>
text.<p>Second&nbsp;text.<aside>Side words here</aside><p>Third.</p><section id="comments"><p>I disagree strongly</p></section></article><footer>&copy; foot</footer></body></html>"""


def test_html_example():
    weights = html.Weights.fit(*html.counts(PAGE))
    assert html.extract(PAGE, weights) == "Head & line\nFirst bold text.\nSecond text.\nThird."
    div = PAGE.replace("<article>", '<div class="post">').replace("</article>", "</div>")
    assert html.extract(div, weights).endswith("First bold text.\nSecond text.\nThird.")
    for broken in ("", "<", "<p", "<a href='x>y", "<p>a <b>c", "a < b > c", "<script>x", "</p></p>", "<!-- x", "plain words"):
        html.extract(broken, weights)
    assert html.extract("plain words &lt;here", weights) == "plain words <here"


def test_html_pages(spark):
    rows = html.op1_html(spark, SF).collect()
    own = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(own)
    from html import unescape

    for r in rows:
        body = own[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert r["text"] == "\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"])


def test_html_custom_elements_and_unclosed_ones():
    weights = html.Weights.fit(*html.counts(PAGE))
    for inside in ("<svg-icon></svg-icon>", "<script-box></script-box>", "<button>go</button>", "<svg><path d='x'/></svg>"):
        page = PAGE.replace("<p>Third.", f"{inside}<p>Third, of so many words that they outweigh the tags before them, and then some more.")
        assert html.extract(page, weights).endswith("Second text.\nThird, of so many words that they outweigh the tags before them, and then some more."), inside
    swallowed = PAGE.replace("<aside>Side words here</aside>", "<section><button>go</section><p>Words and words and words and more words of an article that goes on.</p>")
    assert html.extract(swallowed, weights).endswith("goes on.\nThird.")
    assert html.extract("<article>" + "<p>many words here</p>" * 30_000 + "</article>", weights).count("\n") == 29_999


def test_license_phrases_of_a_long_text():
    n, starts, labels, _ = licenses.scan_words(b"mit license, " * 100_000, [])
    assert (n, len(starts), starts[-1], labels) == (200_000, 100_000, 199_998, {"mit"})


def test_clashing_columns_stay(spark):
    more = ["_words", "n_words", "_data", "_s", "_e", "_i", "clean_text", "spans", "kept", "c0", "row", "hit_items", "h"]
    text = " ".join(f"word{k}" for k in range(80)) + " token = '04dbebab91ab85687d33eeaaf9ac699e1188f962'"
    docs = documents(spark, [text, None]).selectExpr("*", *(f"'{x}' AS `{x}`" for x in more))
    items = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(10, 20)))], "item_id long, text string")
    for df in (quality.keep_good(docs), decontaminate.decontaminate(docs, items), secrets.redact_secrets(docs)):
        assert df.columns == docs.columns
        r = next(r for r in df.collect() if r["doc_id"] == 0)
        assert [r[x] for x in more] == more and r["n_chars"] == len(r["text"])


def test_html_null_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (2, None, "<p>word word</p>")], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in html.extract_pages(pages).collect()) == [(1, ""), (2, ""), (2, "word word")]
    empty = documents(spark, ["x"]).where("false")
    assert secrets.scan(empty, ["doc_id"]).count() == licenses.scan_licenses(empty).count() == quality.apply_rules(empty).count() == 0
