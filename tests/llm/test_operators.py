"""The training-data operators against brute force, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import os
import random
import re
import string
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cardinal.llm import ann, bpe, chat, components, html_text, licenses, mixing, ngram_join, quality, secrets, suffix_array, suffix_dedup
from cardinal.llm.staging import heavy_keys

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, h bigint, key bigint, rep bigint, n bigint, weight int, `__text` string, ids string, u int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def made_up_texts() -> list[str | None]:
    rng = random.Random(11)
    syllables = ["ba", "no", "ti", "re", "su", "él", "ko", "漢", "mi", "Ta"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(40))
    out: list[str | None] = [None, "", " \n\t ", "one", "One two", "one two", "a b c d", "A B C D"]
    base = [[word() for _ in range(rng.choice([8, 30, 60, 120, 300]))] for _ in range(25)]
    for words in base:
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            near = list(words)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = word()
            out.append(rng.choice([" ", "\n", "  "]).join(near))
    for _ in range(6):
        out.append(" ".join(word() for _ in range(20)) + "\n" + passage + ". " + " ".join(word() for _ in range(20)))
    out += [out[10], out[10], passage, " ".join(word() for _ in range(30_000)), "x" * 200_000, "ab" * 3000, "é" * 49, "#" * 60]
    return out


TEXTS = made_up_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), -1, -2, -3, -4, -5, -6, "clash", "clash", 9) for i, t in enumerate(TEXTS)]
    rows.append((None, TEXTS[12], None, None, 0, -1, -2, -3, -4, -5, -6, "clash", "clash", 9))
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect() if r["doc_id"] is not None}


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


# BPE


def test_bpe_equals_the_library(docs, empty):
    t = Tokenizer.from_file(PATH)
    got = by_id(bpe.digests(docs, PATH), "n_tokens", "ids_sha256", "decoded_sha256", "round_trip")
    for i, text in enumerate(TEXTS):
        if len(text or "") > 100_000:
            continue  # the library is slow on one long word; test_bpe_long_word covers it
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode()), True), i
    assert bpe.digests(docs, PATH).count() == len(TEXTS) + 1
    assert bpe.digests(empty, PATH).count() == 0
    back = bpe.decode(bpe.encode(docs.where("doc_id < 12"), PATH), PATH)
    assert by_id(back, "text") == {i: (t or "",) for i, t in enumerate(TEXTS[:12])}


def test_bpe_random_strings():
    t, c, rng = Tokenizer.from_file(PATH), bpe.BytePairCodec(PATH), random.Random(3)
    pieces = [*" \n\t\x1c\x85　\xa0'aàéß1²Ⅷ!?😀漢\r​́", "<|endoftext|>", "'s", "'ll", " the", "  "]
    for _ in range(2000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 40)))
        ids = t.encode(text, add_special_tokens=False).ids
        assert c.encode(text) == ids and c.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_long_word():
    c = bpe.BytePairCodec(PATH)
    assert c.decode(c.encode("ab" * 20_000)) == "ab" * 20_000


# suffix arrays


def test_suffix_array():
    rng = np.random.default_rng(4)
    for _ in range(300):
        x = rng.integers(0, rng.integers(1, 5), rng.integers(1, 80))
        own = x.tolist()
        assert suffix_array.suffix_array(x).tolist() == sorted(range(len(own)), key=lambda i: own[i:])
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    order = suffix_array.suffix_array(raw.astype(np.int64))
    for most in (3, 8, 11, 50):
        found = suffix_array.common_prefixes(raw, order, most)
        assert found[order[0]] == 0
        for a, b in zip(order[:-1], order[1:], strict=True):
            assert found[b] == min(most, len(os.path.commonprefix([raw[a:].tobytes(), raw[b:].tobytes()])))


def removal(rows: list[tuple[int, bytes]], length: int) -> dict[int, tuple]:
    first: dict[bytes, int] = {}
    for i, b in rows:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(i, first.get(b[p : p + length], i))
    out = {}
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup_equals_brute_force(docs, hot):
    expected = removal([(i, (t or "").encode()) for i, t in enumerate(TEXTS)], 50)
    found = suffix_dedup.find_repeats(docs, hot_documents=hot)
    got = {r["id"]: suffix_dedup.removed_runs(len(r["text"].encode()), r["starts"], r["bits"], bool(r["copy"]), 50) for r in found.collect() if r["id"] is not None}
    assert {i: (sum(b - a for a, b in runs), len(runs)) for i, runs in got.items()} == {i: e[1:3] for i, e in expected.items()}


def test_suffix_dedup_digests(docs, empty):
    expected = removal([(i, (t or "").encode()) for i, t in enumerate(TEXTS)], 50)
    out = suffix_dedup.digests(docs)
    assert by_id(out, "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert out.where("doc_id is null and n_removed = 0").count() == 1
    assert suffix_dedup.digests(empty).count() == 0


# near duplicates


def shingles(text: str | None, words: int) -> frozenset:
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def grouped(texts, words, percent):
    sets = [shingles(t, words) for t in texts]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(s), top(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(docs, empty, words, percent):
    out = ngram_join.near_duplicates(docs, words=words, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == grouped(TEXTS, words, percent)
    assert [r["component_id"] for r in out if r["doc_id"] is None] == [None]
    if words == 5:
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in grouped(TEXTS, 5, 80).items() if i == c} | {None}
        assert ngram_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_all_links_equal_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "LINK_BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", 16 * block)
    sets = [shingles(t, 5) for t in TEXTS]
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if (common := len(sets[i] & sets[j])) and 100 * common >= 80 * len(sets[i] | sets[j])]
    least = {s: sets.index(s) for s in sets}
    pairs = {tuple(sorted((least[sets[i]], least[sets[j]]))) for i, j in linked if sets[i] != sets[j]}
    got = ngram_join.links(docs).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs
    ends = collections.Counter(x for pair in linked for x in pair)
    counts = by_id(ngram_join.link_counts(docs), "n_shingles", "n_links")
    assert counts == {i: (len(s), ends[i]) for i, s in enumerate(sets)}


def test_linked_sets_agree_in_a_block():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.choice([rng.integers(1, 400), rng.integers(400, 5000)]))
        percent = int(rng.choice([80, 85]))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = a[int(rng.integers(0, max(1, (100 - percent) * n // 100) + 1)) :]
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        keys = [set(ngram_join.signatures(np.zeros(len(s), np.int64), s, np.array([len(s)]), percent)[1].tolist()) for s in (a, b)]
        assert keys[0] & keys[1]
        x, y = (ngram_join.sketches(np.zeros(len(s), np.int64), s, 1) for s in (a, b))
        apart = ngram_join.sketch_distances(x, y)[0]
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 540)]
    parent = {x: x for e in links for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: top(x) for e in links for x in e if any(p != q for p, q in links if x in (p, q))}


# nearest neighbours


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype("f4").astype(float)
    x[600:640] = x[3]
    x[50] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    bad = [(1000, None, 1), (1100, [0.0] * 16, 1), (1200, [1.0] * 15 + [None], 1), (1300, [1.0] * 15 + [float("nan")], 1), (1400, [1.0] * 15 + [float("inf")], 1), (None, [1.0] * 16, 1), (1500, [], 1)]
    df = spark.createDataFrame(rows + bad + rows[:5], "vec_id bigint, embedding array<float>, vector int")
    got = collections.defaultdict(list)
    for r in ann.search(df, lambda i: F.col(i) % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    recall = []
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        own = got.pop(q)
        assert [r for _, _, r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r[1], r[0]))
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s, _ in own)
        recall.append(len({v for v, _, _ in own} & set(order)) / 10)
    assert not got and np.mean(recall) >= 0.9
    assert recall[6] == 1  # a query among 40 copies finds the smallest ids
    assert ann.search(df.where("vec_id < 0"), lambda i: F.col(i) % 100 == 0).count() == 0
    few = ann.search(df.where("vec_id < 4"), lambda i: F.col(i) % 100 == 0)
    assert few.count() <= 3


def test_ann_splits_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=16) + rng.normal(size=(400, 16)) / 50).astype("f4").astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    whole = sorted(map(tuple, ann.search(df, lambda i: F.col(i) % 20 == 0, probe_count=4).collect()))
    monkeypatch.setattr(ann, "HOT_ROWS", 30)
    monkeypatch.setattr(ann, "UNIT_KEYS", 64)
    assert sorted(map(tuple, ann.search(df, lambda i: F.col(i) % 20 == 0, probe_count=4).collect())) == whole
    monkeypatch.setattr(ann, "heavy_keys", lambda *a: heavy_keys(*a[:2], 30))
    assert sorted(map(tuple, ann.search(df, lambda i: F.col(i) % 20 == 0, probe_count=4).collect())) == whole


@pytest.mark.parametrize("n", [3, 20, 1000])
def test_ann_in_64_dimensions(spark, monkeypatch, n):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    x = np.random.default_rng(n).normal(size=(n, 64)).astype("f4").astype(float)
    x[-n // 2 :] = x[-1] + x[-n // 2 :] / 1000  # a tight cone
    x[0] = -x[-1]  # a query that points away from it
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype("f4").astype(float))] + [(10_000, [1.0] * 8)], "vec_id bigint, embedding array<float>")
    got, x = collections.defaultdict(list), x.astype("f4").astype(float)
    for r in ann.search(df, lambda i: F.col(i) % max(1, n // 10) == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    recall = []
    for q in range(0, n, max(1, n // 10)):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(n), d)) if i != q][:10]
        own = got.pop(q)
        assert len(own) == len(order) and all(s == pytest.approx(d[v], abs=1e-12) for v, s in own)
        recall.append(len({v for v, _ in own} & set(order)) / len(order))
    assert not got and np.mean(recall) >= 0.9


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose((ann.hadamard(x) ** 2).sum(1), (x**2).sum(1)) and np.allclose(ann.hadamard(ann.hadamard(x)), x)


# html


def test_html():
    page = (
        '<html><head><title>No</title><style>p{}</style></head><body><header class="top"><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies on this site to make it work better for all of you, always.</p></div><!-- <p>hidden</p> --><script>var t="</p>";</script>'
        "<article><header><h1>Title &amp;amp; more</h1></header><p>First   <b>bold</b>\n text&nbsp;here<p>Second <a href=x>link</a>.<p>Short"
        '<div class="comments"><p>I read this and liked it very much indeed, thank you all.</p></div><form><p>Your name and address</p></form></article>'
        '<aside><p>Side</p></aside><p class="advert">Buy this now, it is the best thing that you can buy.</p><footer>&copy; us</footer></body>'
    )
    assert html_text.main_text(page) == "Title &amp; more\nFirst bold text here\nSecond link.\nShort"
    assert html_text.main_text("") == "" and html_text.main_text("<p><!-- open") == "" and html_text.main_text("<script>x") == ""
    assert html_text.main_text('<body class="has-sidebar"><div class="with-sidebar"><article><p>In<p hidden>Out</article></div><aside><article><p>Teaser</article></aside>') == "In"
    long = " ".join(["word"] * 60)
    assert html_text.main_text(f"<body><div><p>{long}</p><p>{long}</p></div><div><a href=x>one two</a> <a href=y>three</a></div>") == f"{long}\n{long}"


@pytest.mark.parametrize(
    "before",
    [
        "<form><input list=l><datalist id=l><option value=a><option value=b></datalist></form>", '<svg class="icon" />', "<svg/>", "<button-bar>Go</button-bar>", "<select-box></select-box>", "<title-bar></title-bar>",
        "<select><option>One<option>Two</select>", "<form><select><optgroup><option>One</form>", '<iframe src="x" />', '<script src="x"/>', "<ul><li><button>Go</li></ul>", "<object data=x><param name=y>", "<svg><path d=x><circle>", "<button>One<button>Two</button>", "<option>One",
    ],
)
def test_html_after_unclosed_elements(before):
    article = "<article><p>First text <svg><title>No</title><g><text>No</text></g></svg>here<p>Second <button><div>No</div></button>one</article>"
    assert html_text.main_text(f"<body><header>{before}</header>{article}<footer>us</footer></body>") == "First text here\nSecond one"
    assert html_text.main_text(f"<body>{before}{article}<footer>us</footer></body>") == "First text here\nSecond one"


@pytest.mark.parametrize("head", ["<html><head><title>x</title>", "<head><meta charset=utf8><link rel=x>", "<html><head><style>p {}</style><script>1</script>\n", "<title>x</title>"])
def test_html_without_the_end_of_the_head(head):
    words = "These are the words of the article, which has no end tag for its head and no body tag at all."
    assert html_text.main_text(f"{head}<p>{words}</p>") == words
    assert html_text.main_text(f"{head}{words}") == words
    assert html_text.main_text(f'{head}<p data-id="nav" data-class="menu">{words}</p>') == words


def test_html_hides_what_lies_in_closed_elements():
    for hidden in ("<select><option>a<option>b</select>", "<svg viewBox='0 0 1 1'><foreignObject><div><p>a</p></div></foreignObject></svg>", "<math><mi>x</mi><mtext><b>y</b></mtext></math>", "<button type=button><div>a</div><p>b</p></button>", "<canvas>old</canvas>", "<script src=/a/>x</script>", "<object><object>a</object>b</object>"):
        assert html_text.main_text(f"<article><p>One {hidden}two</article>") == "One two", hidden


def test_html_tree_is_learned():
    x, y = html_text.labelled()
    assert all(html_text.classify(html_text.tree(), tuple(r)) == v for r, v in zip(x, y, strict=True))
    held = np.arange(len(y)) % 4 == 0
    node = html_text.train(x[~held], y[~held])
    assert np.mean([html_text.classify(node, tuple(r)) == v for r, v in zip(x[held], y[held], strict=True)]) >= 0.8


def test_html_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "w", "<article><p>Hi", "x"), (3, "v", "<article><p>" + "é " * 50_000, "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert {(r["page_id"], r["url"], r["n_chars"]) for r in out} == {(1, "u", 0), (2, None, 0), (None, "w", 2), (3, "v", 99_999)}


def test_html_on_the_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r, p in zip(html_text.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        import html

        article = re.search("<article>(.*?)</article>", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


# quality


def quality_of(text: str | None):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    count, rep = collections.Counter(zip(w, w[1:], w[2:], strict=False)), [0] * len(w)
    for i in range(len(w) - 2):
        if count[w[i], w[i + 1], w[i + 2]] > 1:
            rep[i : i + 3] = [1] * 3
    base = len(w) < 50 or 2 * sum(rep) > len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(rep), base


def test_quality(docs, empty, spark):
    out = quality.score(docs)
    got = by_id(out, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: quality_of(t) for i, t in enumerate(TEXTS)}
    assert out.where("base_failed and kept").count() == 0
    assert quality.score(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns
    kept = {r["doc_id"] for r in out.where("kept").collect()}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == kept


def test_quality_order_changes_nothing(docs):
    backwards = quality.score(docs, rules=quality.RULES[::-1])
    assert by_id(backwards, "kept") == by_id(quality.score(docs), "kept")


def test_quality_rules_reject_junk():
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    junk = {"symbols": " ".join(w + "##" for w in words), "capitals": " ".join(w.upper() for w in words), "letterless_words": " ".join(str(i) for i in range(80)), "clean": " ".join(words)}
    for name, text in junk.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        m = quality.measure(raw, np.array([0, len(raw)]))
        assert quality.cascade(m, list(quality.RULES), lambda _, t=text: t.encode()).tolist() == [name == "clean"]


# mixing


def plain_shares(weight: dict, target: dict | None) -> dict:
    total = sum(weight.values())
    if target is None:
        raised = {v: (w / total) ** mixing.TEMPERATURE for v, w in weight.items()}
    else:
        named = {v: target[v] for v in weight if v in target}
        others = {v: w for v, w in weight.items() if v not in named}
        left = max(0.0, 1 - sum(named.values())) if others else 0.0
        raised = named | {v: left * w / sum(others.values()) for v, w in others.items()}
    total = sum(raised.values())
    return {v: x / total for v, x in raised.items()}


def plain_fit(cells: dict, targets: dict, token_share: float) -> dict:
    """The same fit, value by value: bisection for the amounts, then bounded scaling."""
    p = dict.fromkeys(cells, token_share)
    goals = []
    for k, d in enumerate(mixing.DIMENSIONS):
        has: dict = {}
        for cell, w in cells.items():
            has[cell[k]] = has.get(cell[k], 0) + w
        share, low, high = plain_shares(has, targets.get(d)), 0.0, 1e9 * sum(has.values())
        for _ in range(300):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(has[v], c * share[v]) for v in has) < token_share * sum(has.values()) else (low, c)
        goals.append({v: min(has[v], high * share[v]) for v in has})
    for _ in range(mixing.ROUNDS):
        for k, goal in enumerate(goals):
            for v, aim in goal.items():
                own = [c for c in cells if c[k] == v]
                full, part = sum(cells[c] for c in own if p[c] >= mixing.FULL), sum(cells[c] * p[c] for c in own if p[c] < mixing.FULL)
                for c in own:
                    if aim < full + part:
                        p[c] *= aim / (full + part)
                    elif p[c] < mixing.FULL and part:
                        p[c] = min(1.0, p[c] * (aim - full) / part)
    return p


MIXES = [{}, {"source": {"a": 0.5, "b": 0.3, None: 0.1, "c": 0.1}}, {"source": {"a": 0.2, "zz": 0.5}}, {"source": {"zz": 1.0}}, {"source": {"a": 0.5, "b": 0.9}, "lang": {"en": 0.5, None: 0.5}}, {"topic": {"t0": 1.0}}]


@pytest.mark.parametrize("targets", MIXES)
@pytest.mark.parametrize("driver_cells", [0, 1000])
def test_mixing_equals_a_plain_fit(spark, targets, driver_cells, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 3)
    rng = random.Random(5)
    rows = [(i, "x" * (4 * rng.randint(1, 30)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["t0", "t1"])) for i in range(300)]
    cells: dict = {}
    for _, text, lang, source, topic in rows:
        cells[source, lang, topic] = cells.get((source, lang, topic), 0) + len(text) // 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, topic string")
    share = 0.3 if "topic" in targets else mixing.TOKEN_SHARE
    want = plain_fit(cells, targets, share)
    found = mixing.cell_factors(df, targets, driver_cells=driver_cells, token_share=share)
    got = {(r["source"], r["lang"], r["topic"]): r["factor"] for r in found.collect()}
    assert got == pytest.approx(want, abs=1e-6)
    reached = {(r["dimension"], r["value"]): r["share"] for r in mixing.reached(found).collect()}
    total = sum(cells[c] * want[c] for c in cells)
    assert reached["source", "a"] == pytest.approx(sum(cells[c] * want[c] for c in cells if c[0] == "a") / total, abs=1e-5)


def test_raking_meets_the_targets():
    rng = np.random.default_rng(1)
    w = rng.random(60) + 0.1
    codes = [np.arange(60) % 4, np.arange(60) // 4 % 5, np.arange(60) // 20]
    for share in (0.3, 0.8):
        aims = [mixing.amounts(np.bincount(c, w), np.full(c.max() + 1, 1 / (c.max() + 1)), share * w.sum()) for c in codes]
        p = mixing.rake(w, codes, aims, share)
        assert p.min() >= 0 and p.max() <= 1
        for c, aim in zip(codes, aims, strict=True):
            assert aim.sum() == pytest.approx(share * w.sum())
            assert np.allclose(np.bincount(c, w * p), aim, atol=1e-3 * w.sum())


def test_mixing_on_a_hot_source(spark):
    """Sources of 0.9 and 0.1: flattened shares of 0.823 and 0.177 need more of the small one than there is, which is kept whole."""
    rows = [(i, "x" * 400, "en", "ab"[i % 10 == 0]) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["source"]: r["factor"] for r in mixing.cell_factors(df).collect()}
    assert got["b"] == 1 and got["a"] == pytest.approx(0.7 / 0.9)


def test_mixing(docs, empty, spark):
    out = mixing.probabilities(docs).cache()
    assert out.count() == len(TEXTS) + 1 and out.where("probability is null or probability < 0 or probability > 1").count() == 0
    share = out.agg(F.sum(F.col("weight") * F.col("probability")) / F.sum("weight")).first()[0]
    assert share == pytest.approx(mixing.TOKEN_SHARE, abs=0.02)
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(r["doc_id"]) for r in out.where("drawn").collect())
    assert mixing.probabilities(empty).count() == 0 and mixing.draw(empty).count() == 0
    clash = docs.selectExpr("*", "1 as __mix_source", "2 as u", "3 as probability", "4 as topic_", "5 as f_lang", "'r' as row").drop("u")
    again = mixing.draw(clash)
    assert again.columns == clash.columns and {r["probability"] for r in again.collect()} == {3}


def test_mixing_draws_by_hash(docs):
    """The draw, held against the hash of another library and plain character counts."""
    chances = {(r["source"], r["lang"], r["topic"]): r["factor"] for r in mixing.cell_factors(docs).collect()}
    for r in mixing.probabilities(docs).collect():
        text = (TEXTS[r["doc_id"]] if r["doc_id"] is not None else TEXTS[12]) or ""
        key = str(r["doc_id"]) if r["doc_id"] is not None else text
        u = (xxhash.xxh64_intdigest(b"mix", seed=xxhash.xxh64_intdigest(key.encode(), seed=42)) % (1 << 40)) / (1 << 40)
        count = lambda chars: sum(text.count(c) for c in chars)  # noqa: B023, E731
        topic = (
            "table" if count("|") * 40 > len(text) else "shout" if count(string.ascii_uppercase) > count(string.ascii_lowercase)
            else "marked" if count("#*$%&<>") * 40 > len(text) else "note" if len(text) < 400 else "essay" if len(text) > 6000 else "prose"
        )
        assert r["topic"] == topic and r["weight"] == max(1, -(-len(text.encode()) // 4))
        assert r["probability"] == chances[r["source"], r["lang"], topic] and r["drawn"] == (u < r["probability"])


# secrets


def test_secret_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", ' = "', ": ", "'", '"', "abc123", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", " ", "é", "=", "/", "K", "ſecret"]
    plain = {
        "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        expected = [(k, *m.span()) for k, (p, ok) in plain.items() for m in p.finditer(text) if ok(m)]
        expected.sort(key=lambda x: (x[1], secrets.BASE_KINDS.index(x[0])))
        assert secrets.base_spans(text) == expected
        assert [x for x in secrets.scan_text(text) if x[0] in secrets.BASE_KINDS] == expected


def test_secrets_in_layers():
    inner = 'api_key = "abcdefgh12345"'
    coded = base64.b64encode(inner.encode()).decode()
    for hidden in (quote(inner), quote(quote(inner)), coded, quote(coded), base64.b64encode(gzip.compress(inner.encode())).decode(), base64.b64encode(coded.encode()).decode(), "".join(f"\\u{ord(c):04x}" for c in inner), "\\u0074oken=abcdef99"):
        text = f"é before {hidden} after"
        spans = secrets.scan_text(text)
        assert any(k == "deep_assign" and text[a:b] in hidden and b - a > 15 for k, a, b in spans), hidden
        clean = secrets.redact(text)
        assert clean.startswith("é before ") and clean.endswith(" after") and secrets.scan_text(clean) == [], hidden
    assert secrets.scan_text("a clean text with 100% of nothing & no token at all") == []
    assert secrets.redact('x token = "abcdef0123" y') == 'x [SECRET]" y'


def test_secrets_in_short_wrapped_and_binary_runs():
    code = lambda raw: base64.b64encode(raw).decode()
    rng = random.Random(3)
    noise = bytes(rng.randrange(256) for _ in range(300))
    long = code(gzip.compress(noise.hex().encode() + b"\0" * 400 + b" password=hunter2"))
    wrapped = "\r\n".join(long[i : i + 76] for i in range(0, len(long), 76))
    for hidden in (code(b"password=hunter2"), code(b"token=abcdef"), code(b"token=abcdefg").rstrip("="), code(noise + b" password=hunter2 " + noise), long, wrapped, "path/" + code(b"password=hunter2"), "\n".join(re.findall(".{1,8}", code(b"password=hunter2")))):
        text = f"é before {hidden} after"
        assert any(k == "deep_assign" and a >= text.index(hidden) and b <= text.index(hidden) + len(hidden) for k, a, b in secrets.scan_text(text)), hidden
        assert "[SECRET]" in secrets.redact(text) and hidden not in secrets.redact(text) and secrets.scan_text(secrets.redact(text)) == []
    assert secrets.scan_text("a line of long words, internationalisation\nundernourishment and counterrevolutionary") == []


def test_secrets_partly_coded_in_any_layer():
    code = lambda s: base64.b64encode(s.encode()).decode()
    partly = ("pass\\u0077ord=hunter22", 'pass%77ord="hunter22', "tok&#101;n = abc%64ef", "api%5Cu005fkey: abcdef12", "%2561pi_key=abcdef12", code("this is the database password") + ": hunter22")
    for secret in partly:
        for hidden in (secret, code(secret), quote(secret), code(code(secret)), quote(code("x " + secret)), "".join(f"\\u{ord(c):04x}" for c in secret), base64.b64encode(gzip.compress(secret.encode())).decode()):
            text = f"é before {hidden} after password = no and {code('nothing to be seen here')}"
            assert any(k == "deep_assign" and text[a:b] in hidden for k, a, b in secrets.scan_text(text)), (secret, hidden)
            clean = secrets.redact(text)
            assert secrets.scan_text(clean) == [] and clean.startswith("é before ") and clean.endswith(text[text.index(" after") :]), (secret, hidden)


def naive_scan(text: str) -> set[tuple[str, int, int]]:
    """All deep spans, with the origin of each character carried along by itself."""
    found, seen = set(), set()
    base = {(k, *m) for k, *m in secrets.base_spans(text)}

    def follow(chars: str, origin: list[tuple[int, int, bool]]) -> None:
        if not chars or (chars, origin[0][0], origin[-1][1]) in seen:
            return
        seen.add((chars, origin[0][0], origin[-1][1]))
        for kind, a, b in secrets.base_spans(chars):
            span, decoded = (origin[a][0], origin[b - 1][1]), any(x[2] for x in origin[a:b])
            if decoded or not any(low <= span[0] and span[1] <= high for _, low, high in base | found):
                found.add((f"deep_{kind}", *span))
        search(chars, origin)

    def replaced(chars, origin, runs):
        out, places, at = "", [], 0
        for low, high, plain, where in runs:
            out, places = out + chars[at:low] + plain, places + origin[at:low] + where
            at = high
        return out + chars[at:], places + origin[at:]

    def unpack(run: str, low: int, origin):
        at = [i for i, c in enumerate(run) if c in string.ascii_letters + string.digits + "+/-_"]
        code = "".join(run[i] for i in at).replace("-", "+").replace("_", "/")
        for skip in range(min(4, len(code) - 15)):
            part, raw, where = code[skip:], b"", []
            for k in range(0, len(part) - (len(part) % 4 == 1), 4):
                own = base64.b64decode(part[k : k + 4].ljust(4, "="))
                last = at[skip + k + 3] + 1 if skip + k + 4 < len(at) else len(run)
                raw, where = raw + own, where + [(origin[low + at[skip + k]][0], origin[low + last - 1][1], True)] * len(own)
            yield raw, where

    def as_text(raw: bytes, where):
        try:
            plain = raw.decode()
        except UnicodeDecodeError:
            return raw.decode("latin-1"), where
        out, at = [], 0
        for c in plain:
            size = len(c.encode())
            out.append((where[at][0], where[at + size - 1][1], True))
            at += size
        return plain, out

    def search(chars, origin):
        codes, runs = [], []
        for m in re.finditer(r"\\u([0-9A-Fa-f]{4})|&#([0-9]{1,7});|(%[0-9A-Fa-f]{2})", chars):
            plain = chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else chr(int(m[3][1:], 16))
            codes.append((*m.span(), plain, [(origin[m.start()][0], origin[m.end() - 1][1], True)]))
        if codes:
            follow(*replaced(chars, origin, codes))
        coded = list(secrets._BASE64.finditer(chars))
        for m in coded:
            raw, where = next(unpack(m[0], m.start(), origin), (b"", []))
            if raw.isascii() and raw and raw.decode().isprintable():
                runs.append((*m.span(), raw.decode(), where))
        if runs:
            follow(*replaced(chars, origin, runs))
        for m in coded:
            for raw, where in unpack(m[0], m.start(), origin):
                follow(*as_text(raw, where))
                if b"\x1f\x8b\x08" in raw:
                    whole = [(origin[m.start()][0], origin[m.end() - 1][1], True)]
                    plain = gzip.decompress(raw[raw.index(b"\x1f\x8b\x08") :]).decode()
                    follow(plain, whole * len(plain))

    search(text, [(i, i + 1, False) for i in range(len(text))])
    return found


def test_secret_layers_equal_naive_decoding():
    rng = random.Random(12)
    pack = lambda b: base64.b64encode(b).decode()
    coders = [
        lambda s: "".join(rng.choice([c, f"%{ord(c):02X}"]) for c in s), lambda s: "".join(rng.choice([c, f"\\u{ord(c):04x}"]) for c in s), lambda s: "".join(rng.choice([c, c, f"&#{ord(c)};"]) for c in s),
        lambda s: pack(s.encode()), lambda s: pack(s.encode()).rstrip("="), lambda s: pack(gzip.compress(s.encode())), lambda s: pack(gzip.compress(s[:9].encode()) + gzip.compress(s[9:].encode())),
    ]
    secret = ["password=hunter22", 'api_key: "abcdef12', "AKIA" + "A1B2C3D4" * 3, "0123456789abcdef" * 2, "nothing here"]
    deep = 0
    for _ in range(250):
        hidden = rng.choice(["", "some words ", "x="]) + rng.choice(secret) + rng.choice(["", " and more words", ","])
        for _ in range(rng.randint(1, 3)):
            hidden = rng.choice(coders)(hidden)
        text = f"before {hidden} after {rng.choice(secret)} end"
        spans = {x for x in secrets.scan_text(text) if x[0].startswith("deep")}
        assert spans == naive_scan(text), text
        deep += bool(spans)
    assert deep > 100


def test_secrets_in_long_streams(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 200)
    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}é" for _ in range(n)).encode()
    for at in (0, 700, 1500, 4000):
        inner = gzip.compress(noise(at) + b" password=hunter22 " + noise(900))
        for raw in (inner, gzip.compress(noise(600)) + inner, gzip.compress(noise(at) + inner + noise(700)), inner[:-40]):
            text = f"a {base64.b64encode(raw).decode()} b"
            assert any(k == "deep_assign" for k, *_ in secrets.scan_text(text)), at
    half = noise(500) + b" password=hunter22"
    assert "deep_assign" in [k for k, *_ in secrets.scan_text(base64.b64encode(gzip.compress(half[:-9]) + gzip.compress(half[-9:])).decode())]


def test_secret_rows(docs, empty, spark):
    out = secrets.scan(docs)
    assert out.count() == len(TEXTS) + 1 and secrets.scan(empty).count() == 0
    got = by_id(out, "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert got[0] == (0, 0, 0, sha(b""), "")
    clean = secrets.redact_documents(docs)
    assert clean.columns == docs.columns and clean.where("doc_id = 0 and text is null").count() == 1


# chat


def test_chat_round_trip():
    rng = random.Random(6)
    parts = ["<|turn|>", "<|end|>\n", "<|", "|>", "\\", "\\l|", "\n", "<", "é", "text ", "assistant"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "", "a\nb", "<|turn|>"]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_events(spark):
    log = [
        (1, 0, "message", None, "user", "hi"), (1, 1, "message", None, "assistant", "Hel"), (1, 2, "delta", 1, None, "lo"), (1, 3, "delta", None, None, "!"), (1, 4, "regenerate", None, "assistant", "Hey"),
        (1, 5, "delta", None, None, "."), (1, 6, "edit", 0, None, "hello"), (2, 0, "delta", 9, "user", "lost"), (2, 1, "message", None, "user", "x"), (2, 2, "delete", 1, None, None), (None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(log, "c bigint, seq bigint, event string, target bigint, role string, text string")
    out = chat.format_conversations(df, "c", "seq", "role", "text", "event", "target").collect()
    assert {r["c"]: chat.parse(r["formatted"]) for r in out} == {1: [("user", "hello"), ("assistant", "Hey.")], 2: [("user", "lost")], None: [("", "")]}


def test_chat_digests(spark, data):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (1, None, "system", "s"), (2, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha(b"system\ns\nuser\n\nassistant\nb\nassistant\nb\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (2, sha(b"bb")) and got[2]["loss_chars"] == 0
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


# licenses


def test_license_places_equal_brute_force():
    rng = random.Random(7)
    parts = ["gnu", "GNU", "general", "public", "license", "License", "apache", "cc", "by", "mit", "é", "x1", "-", ".", "\n", "_"]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 20)))
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            own = [i for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
            places += own
            labels |= {label} if own else set()
        got = licenses.scan_text(text)
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert got["base_labels"] == ",".join(sorted(labels)) and labels <= set(got["labels"].split(",")) | {""}
        assert 0 <= got["score"] <= 1


def test_license_expressions():
    assert licenses.postfix("MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND Apache-2.0)") == ["mit", "gpl-2.0-only", "classpath-exception-2.0", "with", "apache-2.0", "and", "or"]
    assert licenses.evaluate("MIT OR GPL-3.0")[1] == licenses.FREEDOM["mit"] and licenses.evaluate("MIT AND GPL-3.0")[1] == licenses.FREEDOM["gpl"]
    assert licenses.evaluate("GPL-2.0 WITH Classpath-exception-2.0")[1] > licenses.FREEDOM["gpl"]
    assert licenses.evaluate("OR MIT") == ({"mit"}, None) and licenses.evaluate("(MIT") == ({"mit"}, None) and licenses.evaluate("") == (set(), None)
    got = licenses.scan_text("// SPDX-License-Identifier: (MIT OR GPL-2.0-only) */ code")
    assert got["labels"] == "gpl,mit" and got["score"] == licenses.FREEDOM["mit"] and got["n_base"] == 0


def test_license_identifiers():
    known = {"mit": "mit", "mit-0": "mit", "gplv2": "gpl", "gpl-2.0-or-later": "gpl", "agpl-3.0": "agpl", "bsd-3-clause": "bsd", "0bsd": "bsd", "cc-by-nc-sa-4.0": "cc-by-nc", "cc-by-4.0": "cc-by",
             "cc0-1.0": "cc0", "unlicense": "public-domain", "python-2.0": "psf", "busl-1.1": "busl", "bsl-1.0": "bsl", "zlib": "zlib", "apache-2.0+": "apache"}
    assert {x: licenses.family(x) for x in known} == known
    assert [licenses.family(x) for x in ("mitre", "gplx", "iscx-1", "", "licenseref-own", "bsdl")] == [None] * 6
    assert licenses.evaluate("LicenseRef-Own") == ({"other"}, None) and licenses.evaluate("MITRE OR MIT") == ({"other", "mit"}, 0.9)
    assert licenses.evaluate("GPL-2.0 WITH Classpath-exception-2.0")[0] == {"gpl"} and licenses.evaluate("MIT see the Apache file")[0] == {"mit"}


def test_license_rows(docs, empty):
    assert licenses.scan(docs).count() == len(TEXTS) + 1 and licenses.scan(empty).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(90)]
    texts = []
    for k in range(260):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 8])):
            own[rng.randrange(90)] = f"v{k}x{rng.randrange(100)}"
        texts.append(" ".join(own))
    for k in range(40):  # a chain: each links with the one before, the ends don't
        texts.append(" ".join(f"c{i}" for i in range(2 * k, 2 * k + 60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(6)
    out = ngram_join.near_duplicates(df, words=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == grouped(texts, 4, 85)
    assert len({r["component_id"] for r in out if r["doc_id"] >= 260}) == 1
