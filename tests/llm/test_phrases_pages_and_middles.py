"""Collocations, main texts of pages and fill-in-middle documents against brute force and their equivalents in SQL."""

import glob
import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tamis.llm import collocations, fim, page_density
from tamis.llm.queries import oracles, registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_collocations", "op13_fill_in_middle"])
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = registry()[name](spark, SMALL), con.sql(oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert rows == sorted(repr(tuple(r)) for r in want.fetchall())


def brute_phrases(rows, least, longest, percent, most):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(small)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + size])) for size in range(1, longest + 1) for i in range(len(w) - size + 1))
    found = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang, p] = (score, a, f[lang, p[:k]], f[lang, p[k:]])
    inside = set()
    for (lang, p), (_, a, *_) in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= percent * f[lang, p[i : i + size]]:
                    inside.add((lang, p[i : i + size]))
    out, place = [], Counter()
    for (lang, p), (score, a, left, right) in sorted(found.items(), key=lambda x: (-x[1][0], -x[1][1], " ".join(x[0][1]).encode())):
        if (lang, p) not in inside and place[lang] < most:
            place[lang] += 1
            out.append((lang, place[lang], " ".join(p), a, left, right, n[lang], score))
    return sorted(out)


def phrases_of(spark, rows, least=3, most=2000, **more):
    docs = spark.createDataFrame([(lang, text, 1, "p", 2) for lang, text in rows], "lang string, text string, size int, phrase string, n int")
    return sorted(tuple(r) for r in collocations.collocations(docs.repartition(4), least=least, most=most, **more).collect())


def test_collocations_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["a", "b", "New", "new", "york", "é", "ß", "É", "x-y", "\xa0", "日本", "q\x00q"]
    joints = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " \t "]
    rows = [(lang, "".join(w + joints[j] for w, j in zip(rng.choice(vocabulary, 40), rng.integers(0, len(joints), 40)))) for lang in ("en", None, "und", "de", "") for _ in range(12)]
    rows += [("en", None), ("en", ""), (None, None), ("en", " . ,"), ("de", "new york city hall " * 30), ("de", "new york city hall " * 30), ("fr", "only once here")]
    want = brute_phrases(rows, 3, 4, 80, 2000)
    assert len(want) > 200 and phrases_of(spark, rows) == want
    assert phrases_of(spark, rows, most=5) == brute_phrases(rows, 3, 4, 80, 5)
    assert phrases_of(spark, rows, least=2, longest=3, percent=50) == brute_phrases(rows, 2, 3, 50, 2000)
    assert phrases_of(spark, []) == [] and phrases_of(spark, [("en", None)]) == []


def test_phrases_over_blocks_and_full_filters(monkeypatch):
    """Blocks change nothing, and where the filter holds every pair more rows come, with the same counts."""
    rng = np.random.default_rng(5)
    text = "".join(w + j for w, j in zip(rng.choice(["aa", "b", "c" * 50], 3000), rng.choice([" ", "  ", ", ", "\n"], 3000))).encode()
    full = np.full(1 << (collocations.FILTER_BITS - 3), 255, np.uint8)

    def counted(size):
        monkeypatch.setattr(collocations, "BLOCK", size)
        found = Counter()
        for block in collocations.blocks(text):
            for rows in collocations.phrase_rows("en", block, [full, full], 4):
                for r in rows.to_pylist():
                    found[r["size"], r["phrase"]] += r["n"]
        return found

    whole = counted(1 << 20)
    assert whole == counted(64) == counted(1) and whole[0, ""] == 3000
    want = Counter()
    for piece in re.split("[,\n]", text.decode()):
        w = piece.split()
        want.update((s, " ".join(w[i : i + s])) for s in range(1, 5) for i in range(len(w) - s + 1))
    del whole[0, ""]
    assert whole == want


def test_products_beyond_64_bits(spark):
    big = 4 * 10**18
    rows = [("en", 1, "a", big), ("en", 1, "b", big), ("en", 2, "a b", big - 1), ("en", 2, "b a", 5), ("en", 3, "a b a", big - 2), ("en", 1, "c", 9)]
    got = {r.phrase: (r.score, r.k) for r in collocations.scored(spark.createDataFrame(rows, "lang string, size int, phrase string, n long")).collect()}
    cut = lambda a, *parts: min((2_000_000 * a // (x + y), k) for k, (x, y) in enumerate(parts, 1))
    assert got == {"a b": cut(big - 1, (big, big)), "b a": cut(5, (big, big)), "a b a": cut(big - 2, (big, 5), (big - 1, big))}


ODD = ["", None, "a", "ab", "1", "é", "aé", "éa", "<P>", "<P", ">x<S>", "a<M", ">b", "<", "P>", "x<M>y", "日本 ab cd", "\n\n", "ab" * 9, "word " * 30_000, "\U0001f600x\U0001f600"] * 12


def brute_middle(key, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles_against_brute_force(spark):
    rows = [*enumerate(ODD), (None, "a b c"), (3, "x y"), (3, "x y")]
    docs = spark.createDataFrame([(k, t, 1, "f", "o") for k, t in rows], "doc_id long, text string, n int, form string, output string").coalesce(2)
    got = sorted(map(repr, (tuple(r) for r in fim.transform(docs).collect())))
    assert got == sorted(repr(brute_middle(*r)) for r in rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter((k, *brute_middle(k, t)[1:5], sha(brute_middle(k, t)[5]), sha(t)) for k, t in rows)
    assert Counter(tuple(r) for r in fim.digest(docs).collect()) == want
    assert fim.digest(docs.limit(0)).count() == 0 and {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}


def test_blocks_of_rows_change_nothing(monkeypatch):
    h = [pa.array(np.random.default_rng(i).integers(0, 1 << 32, len(ODD))) for i in range(4)]
    want = fim.transformed(pa.array(ODD), *h)
    monkeypatch.setattr(fim, "BLOCK", 7)
    assert fim.transformed(pa.array(["zz", *ODD]).slice(1), *h).equals(want)


LONG = "Lorem ipsum dolor sit amet consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "


def expected(*parts):
    return "\n".join(p.strip() for p in parts)


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<nav><a href=1>x</a></nav>", ""), ("just text &amp; &lt;b&gt; &eacute;&#33;", "just text & <b> é!"),
    (f'<title>t</title><body><div class="top"><a href=/>Home</a> <a href=/x>About us</a> <a href=/y>Contact</a></div><div><div class="sidebar"><p>{LONG}</div>'
     f'<div class="t"><h1>A  title</h1><p>{LONG}\n<p>{LONG} <a href=x>link</a></div></div><div id="comments"><p>{LONG * 5}<p>{LONG * 5}</div><div class="cookie-bar">{LONG}</div>'
     "<footer>c 2020</footer>", expected("A title", LONG, LONG + "link")),
    (f'<body><header><h1>Site</h1></header><div class="post"><h1>T</h1><section><h2>Intro</h2><p>{LONG}<p>{LONG}<p>{LONG}</section><section><p>{LONG}second</section></div>',
     expected("T", "Intro", LONG, LONG, LONG, LONG + "second")),
    (f'<article><header><h1>H</h1></header><p title="a > b">{LONG}<script>"</article>"</script><!-- <p>no</p> --><form>{LONG}</form><p>tail<br>end</article><article class="comment"><p>{LONG * 9}</article>',
     expected("H", LONG, "tail end")),
    (f"<p>{LONG}<p>{LONG}<ul><li>one<li>two &middot; 2</ul><p>s", expected(LONG, LONG, "one", "two · 2", "s")),
    (f'<main class="page has-sidebar"><div><p>{LONG}<p>{LONG}</div><aside>{LONG}</aside><div hidden>{LONG}</div><div style="display: none">{LONG}</div></main><p>{LONG}', expected(LONG, LONG)),
    ("<div <p>x</div></p></b> y < z <a", "x\ny < z"),
])
def test_main_texts(html, want):
    assert page_density.main_text(html) == want


def test_articles_of_a_whole_table(spark):
    """The tables' pages name their articles, so a plain reader of that element knows what to expect."""
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    for r in registry()["op12_text_density"](spark, "/root/testdata/sf0.01").collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))) for b in re.split("</?(?:p|h1|h2|ul|li)>", inner))
        assert r.text == "\n".join(" ".join(b.split()) for b in blocks if b.strip()) and r.n_chars == len(r.text)


def test_density_without_semantic_names():
    """The same pages with plain divs for their elements: nearly all of the article, nearly nothing else."""
    import pyarrow.dataset as ds

    hits = wanted = found = 0
    for r in ds.dataset(f"{SMALL}/pages.parquet").to_table().to_pylist():
        plain = re.sub(r'<(/?)(?:nav|article|footer)\b[^>]*>|<div class="ad">', lambda m: f"<{m[1] or ''}div>", r["html"])
        want, got = Counter(page_density.main_text(r["html"]).split()), Counter(page_density.main_text(plain).split())
        hits, wanted, found = hits + (want & got).total(), wanted + want.total(), found + got.total()
    assert hits / wanted > 0.97 and hits / found > 0.85


def test_hostile_pages_take_linear_time_and_odd_rows_pass(spark):
    import time

    for evil in ("<a" * 200_000, "<" * 300_000, "<p>" * 100_000, "<div>" * 50_000 + "x", "<!--" * 100_000, '<b x="' * 50_000, "<script>" * 50_000, "<b>" * 20_000 + "</i>" * 20_000):
        began = time.time()
        page_density.main_text(evil)
        assert time.time() - began < 10, evil[:8]
    rows = [(1, "u", "<p>x", "t", 1), (1, "u", "<p>x", "t", 1), (None, None, None, None, None), (2, "", f"<p>{LONG * 3000}", "t", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in page_density.main_texts(pages).collect()]
    assert got == [(1, "u", "x", 1)] * 2 + [(None, None, "", 0), (2, "", (LONG * 3000).strip(), len((LONG * 3000).strip()))]
    assert page_density.main_texts(pages.limit(0)).count() == 0
