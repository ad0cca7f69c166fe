"""Whitening, main text of pages, and spelling variants against brute force and their defined cases."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_DIR
from sightings.llm import html_blocks, html_text, labelled_pages, spelling, whitening
from sightings.llm.registry import QUERIES

# 11 whitening


def _brute_whitening(vectors):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    centred = np.array([[(n * v - s) / n for v, s in zip(row, sums)] for row in x])
    return n, deviation, centred, centred.T @ centred / n


def _check_whitening(rows, vectors, most=8):
    """Rows by id against numpy's eigenvectors of the brute-force covariance."""
    n, deviation, centred, covariance = _brute_whitening(list(vectors.values()))
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    many = min(most, int((values > values[0] * 1e-9).sum()))
    assert Counter((r.vec_id, r.component) for r in rows) == Counter((i, k) for i in vectors for k in range(1, many + 1))
    place = {i: k for k, i in enumerate(vectors)}
    got = np.zeros((len(vectors), many))
    for r in rows:
        assert r.n == n and r.deviation == deviation[place[r.vec_id]] and r.identity_error < 1e-8
        assert abs(r.explained - values[r.component - 1] / covariance.trace()) < 1e-8
        got[place[r.vec_id], r.component - 1] = r.whitened
    wanted = centred @ axes[:, :many] / np.sqrt(values[:many])
    for k in range(many):
        sign = np.sign((got[:, k] * wanted[:, k]).sum())
        assert np.allclose(got[:, k], sign * wanted[:, k], atol=1e-6)


def test_whitening_of_the_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    _check_whitening(QUERIES["op11_whitening"](spark, SF_DIR).collect(), {r.vec_id: r.embedding for r in table})


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, deviation int, vector string, place int")


def test_whitening_cases(spark):
    rng = random.Random(3)
    own = {i: [rng.gauss(0, 1), rng.gauss(5, 2), 0.0, rng.gauss(0, 1e-2)] for i in range(40)}
    for i in own:
        own[i][2] = own[i][0] + own[i][1] if i % 2 else own[i][0] - own[i][1]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, math.nan, 0.0, 0.0]), (104, [math.inf, 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    rows = [(i, v, 1, "x", 2) for i, v in [*own.items(), *odd]]
    _check_whitening(whitening.whiten(_vectors(spark, rows)).collect(), own)
    assert whitening.whiten(_vectors(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(_vectors(spark, rows[:1])).count() == 0  # one vector spans nothing
    flat = [(i, [1.0, float(i % 3), 2.0 * (i % 3), 0.5], None, None, None) for i in range(9)]
    got = whitening.whiten(_vectors(spark, flat)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-9 and got[0].identity_error < 1e-9
    repeated = whitening.whiten(_vectors(spark, [(None, v, 0, "", 0) for v in own.values()] * 2)).collect()
    assert len(repeated) == 4 * 80 and all(r.vec_id is None and r.n == 80 for r in repeated)
    large = [(i, [1e300 * (i % 2), float(i), 0.0, 1.0], 0, "", 0) for i in range(10)]
    assert {r.deviation for r in whitening.whiten(_vectors(spark, large)).collect()} == {None}


def test_factor_and_rotations():
    rng = np.random.default_rng(5)
    for size, rank in ((1, 1), (2, 2), (7, 3), (30, 30), (33, 20)):
        base = rng.normal(size=(size, rank)) * 10.0 ** rng.uniform(-3, 3, rank)
        matrix = base @ base.T
        factor = whitening.pivoted_cholesky(matrix)
        assert factor.shape[1] <= size and np.allclose(factor @ factor.T, matrix, atol=1e-9 * matrix.max())
        assert rank == size or factor.shape[1] < size
        values, axes = whitening.jacobi(factor)
        wanted = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
        assert np.allclose(values, wanted, rtol=1e-9, atol=1e-9 * wanted[0])
        assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-12) and np.allclose(matrix @ axes, axes * values, atol=1e-9 * wanted[0])
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


# 12 main text


def _marked_text(html):
    """What the table's own pages hold between the article's tags."""
    found = re.search(r"<article>(.*)</article>", html, re.S)
    parts = re.split(r"</?(?:h\d|p)>", found[1]) if found else []
    parts = [" ".join(unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return " ".join(x for x in parts if x)


def test_main_text_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = QUERIES["op12_main_text"](spark, SF_DIR).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        assert r.text == _marked_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_main_text_of_other_layouts():
    """Labelled pages that the field was not trained on."""
    field = html_text.train(labelled_pages.labelled_pages())
    blocks = wrong = 0
    for page in labelled_pages.labelled_pages(300, seed=77):
        own = list(html_blocks.leaf_blocks(page))
        tags = field.best([field.emission(b) for b in own])
        blocks += len(own)
        wrong += sum(t != (b.label or 0) for t, b in zip(tags, own))
    assert wrong < 0.015 * blocks
    page = """<html><head><title>T</title></head><body class="home"><header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
    <div class="cookie-notice">We use cookies. <button>OK</button></div><main><article><h1>One &amp; two</h1><p>First <b>bold</b>&nbsp;text
    here.<p>Second &lt;p&gt; text.<div class="advertisement">Buy now!</div><ul><li>item one<li>item two</ul></article></main>
    <aside class=sidebar><h3>Related</h3><p>Other story.</p></aside><section id="comments"><p>I like this.</p></section><form><label>Mail</label><input></form><footer>&copy; Site"""
    assert field.main_text(page) == "One & two First bold text here. Second <p> text. item one item two"


def _enumerated(emissions, follow):
    """Best tags, marginals and log partition by listing all sequences."""
    scores = {}
    for bits in range(1 << len(emissions)):
        tags = [bits >> k & 1 for k in range(len(emissions))]
        scores[tuple(tags)] = sum(e for e, t in zip(emissions, tags) if t) + sum(follow[a][b] for a, b in zip(tags, tags[1:]))
    total = math.log(sum(map(math.exp, scores.values())))
    chance = [sum(math.exp(s - total) for tags, s in scores.items() if tags[k]) for k in range(len(emissions))]
    return max(scores, key=scores.get), chance, total, scores


def test_field_equals_enumeration():
    rng = random.Random(4)
    chains = [[rng.uniform(-3, 3) for _ in range(k)] for k in (1, 2, 5, 7)]
    follow = [[0.7, -0.4], [-1.1, 0.9]]
    span = max(map(len, chains))
    inside = np.array([[k < len(c) for k in range(span)] for c in chains])
    emission = np.array([[*c, *[0.0] * (span - len(c))] for c in chains])
    chance, pairs, total = html_text.marginals(emission, inside, np.array(follow))
    field, wanted_total, wanted_pairs = html_text.BlockField({}, follow), 0.0, np.zeros((2, 2))
    for k, chain in enumerate(chains):
        best, marginal, partition, scores = _enumerated(chain, follow)
        assert tuple(field.best(chain)) == best and np.allclose(chance[k, : len(chain)], marginal)
        wanted_total += partition
        for tags, s in scores.items():
            for a, b in zip(tags, tags[1:]):
                wanted_pairs[a, b] += math.exp(s - partition)
    assert np.allclose(total, wanted_total) and np.allclose(pairs, wanted_pairs) and field.best([]) == []


def test_leaf_blocks_of_torn_pages():
    texts = lambda html: [b.text for b in html_blocks.leaf_blocks(html)]
    assert texts("") == [] and texts(" \n ") == [] and texts("a < b &amp; c") == ["a < b & c"]
    assert texts("<p>one<p>two<b>three</p>four") == ["one", "twothree", "four"]
    assert texts("<!-- <p>no --><p title='a>b'>yes<script>var t='</p>';</SCRIPT >more</p><style>p{}") == ["yesmore"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul></ul>d<br>e</div>f") == ["a", "b", "c", "d e", "f"]
    assert texts('<p>x<a href="unclosed>y</p>z') == ["xy", "z"]
    assert texts("<p>" * 3000 + "x") == ["x"] and texts("<div>" * 20000 + "x" + "</b></p>" * 1000) == ["x"]
    assert texts("<table><tr><td>1<td>2<tr><th>3</table>") == ["1", "2", "3"]
    assert texts("<" * 50000) == ["<" * 50000] and texts("<a b='" * 20001) == []


def test_main_text_cases(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<html></html>"), (3, "v", "<article><p>kept</p></article>" + "<p>x</p>" * 20000)]
    pages = spark.createDataFrame([(*r, "own", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = sorted(html_text.extract(pages).collect(), key=str)
    assert [r.text for r in got if r.page_id != 3] == [""] * 4 and [r.n_chars for r in got if r.page_id != 3] == [0] * 4
    assert len(got) == 5 and html_text.extract(pages.limit(0)).count() == 0
    assert html_text.train([]).main_text("<p>a</p>") == ""


# 13 spelling variants


def _brute_variants(rows):
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    shapes = {}
    for word in n:
        for k in range(len(word)):
            shapes.setdefault(word[:k] + word[k + 1 :], set()).add(word)
    near = {w: set() for w in n}
    for word in n:
        forms = {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}
        for other in {x for f in forms for x in shapes.get(f, set())} | {f for f in forms if f in n}:
            if other != word and _one_edit(word, other):
                near[word].add(other)
                near[other].add(word)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[word] = best if best and n[best] >= 5 * n[word] else None
    out = []
    for word in n:
        root = word
        while form[root]:
            root = form[root]
        out.append((word, form[word], root, n[word], len(near[word]), n[form[word]] if form[word] else None))
    return sorted(out, key=str)


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _variants(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    return sorted((tuple(r) for r in spelling.variants(docs, **more).collect()), key=str)


def test_variants_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling_variants"](spark, SF_DIR)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    wanted = _brute_variants(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted and sum(r[4] > 0 for r in wanted) > 50


def test_variants_of_crowded_buckets(spark):
    """Words over few letters, so that buckets overflow and are dealt out again; chains of forms of several steps."""
    rng = random.Random(6)
    words = {"".join(rng.choices("abcÀÿ", k=rng.randint(6, 8))) for _ in range(500)} | {"x" * k for k in (6, 7, 8, 400, 401)}
    text = [w for w in words for _ in range(rng.choice([3, 5, 30, 200]))] + ["stepone"] * 700 + ["stepzone"] * 130 + ["stepzones"] * 18 + ["STEPZONES"] * 2
    rng.shuffle(text)
    rows = [(i if i % 7 else None, " ".join(text[k : k + 50])) for i, k in enumerate(range(0, len(text), 50))]
    wanted = _brute_variants(rows)
    assert any(r[0] == "stepzones" and r[2] == "stepone" for r in wanted)
    for most in (3, 2000):
        assert _variants(spark, rows, most=most) == wanted


def test_near_blocks_equal_pairs():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(4, 7))) for _ in range(300)})
    one, other = words[:170], words[170:]
    assert sorted(zip(*(x.tolist() for x in spelling.near(one, other)))) == [(i, j) for i, a in enumerate(one) for j, b in enumerate(other) if _one_edit(a, b)]
    assert sorted(zip(*(x.tolist() for x in spelling.near(one)))) == [(i, j) for i, a in enumerate(one) for j, b in enumerate(one) if i < j and _one_edit(a, b)]


def test_variants_cases(spark):
    assert _variants(spark, []) == [] and _variants(spark, [(None, None), (1, ""), (2, "short x1y2z3")]) == []
    rows = [(None, "repeat " * 5), (3, "Repeat!" * 2), (3, "Repeat!" * 2), (4, "A" * 30000 + " ")] + [(5, None)] * 3
    assert _variants(spark, rows) == _brute_variants(rows) == [("repeat", None, "repeat", 9, 0, None)]


def test_plan_of_new_operators(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = spelling.runs(docs).groupBy("word").agg(F.count("*"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
