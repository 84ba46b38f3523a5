"""Whitening, HTML extraction and the Merkle manifest against plain versions."""

import hashlib
import html
import math
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from samples import SF_SMALL

from redline.llm import html_extract, merkle, queries, whitening
from redline.llm.html_blocks import KEEP, OPEN, blocks

# ----------------------------------------------------------------- whitening


@pytest.mark.parametrize("kind", ["plain", "graded", "flat", "equal", "ties", "rank one", "zero"])
def test_solver_agrees_with_a_dense_one(kind):
    rng = np.random.default_rng(len(kind))
    for n, d in ((50, 12), (12, 30), (7, 7), (40, 1), (1, 5)):
        a = rng.normal(size=(n, d))
        if kind == "graded":
            a *= 10.0 ** rng.uniform(-6, 6, size=d)
        elif kind == "flat":
            a[:, d // 2 :] = 0
        elif kind == "equal":
            a = np.eye(n, d)
        elif kind == "ties":
            a = rng.integers(-2, 3, size=(n, d)).astype(float)
        elif kind == "rank one":
            a = np.outer(rng.normal(size=n), rng.normal(size=d))
        elif kind == "zero":
            a = np.zeros((n, d))
        r = np.linalg.qr(a, mode="r")
        r = np.vstack([r, np.zeros((d - len(r), d))])
        s = np.linalg.svd(a, compute_uv=False) ** 2
        s = np.concatenate([s, np.zeros(d - len(s))])
        diagonal, superdiagonal, v = whitening.bidiagonal(r)
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13
        scale = max(s[0], 1e-300)
        assert np.abs(whitening.squared_singular_values(diagonal, superdiagonal) - s).max() <= 1e-13 * scale
        values, directions = whitening.whitening_directions(r)
        assert len(values) == sum(x > (8 * d * whitening.EPS) ** 2 * scale for x in s[:4])
        assert np.abs(directions.T @ directions - np.eye(len(values))).max(initial=0) < 1e-12
        assert np.abs(a.T @ (a @ directions) - directions * values).max(initial=0) <= 1e-12 * scale


def test_dqds_keeps_relative_accuracy_of_small_values():
    """A bidiagonal matrix with known tiny values: squares over 24 orders."""
    diagonal = 10.0 ** -np.arange(0, 13)
    values = whitening.squared_singular_values(diagonal, np.full(12, 1e-40))
    assert np.allclose(values, diagonal**2, rtol=1e-13, atol=0)


VECTORS = "vec_id long, embedding array<float>, label int"


def plain_whitening(rows):
    """Exact integers, then a dense eigendecomposition."""
    ok = [(i, v) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in ok]
    fit = sorted({x for _, x in xs})
    lengths = defaultdict(int)
    for x in fit:
        lengths[len(x)] += 1
    d = max(lengths, key=lambda k: (lengths[k], k))
    xs, fit = [x for x in xs if len(x[1]) == d], [x for x in fit if len(x) == d]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(x, sums)] for x in fit])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, sums, e[::-1], q[:, ::-1]


def check_whitening(got, rows):
    xs, n, sums, e, q = plain_whitening(rows)
    k = sum(x > 1e-12 * e[0] for x in e[:4])
    assert len(got) == k * len(xs)
    assert {r.n for r in got} == {n}
    want = sorted((str(i), sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in xs)
    for j in range(1, k + 1):
        mine = [r for r in got if r.component == j]
        assert sorted((str(r.vec_id), r.deviation) for r in mine) == want
        assert abs(mine[0].explained / (e[j - 1] / e.sum()) - 1) < 1e-9 and mine[0].identity_error < 1e-9
        w = sorted(abs(np.dot(np.array(x) - np.array(sums) / n, q[:, j - 1]) / math.sqrt(e[j - 1])) for _, x in xs)
        assert np.allclose(sorted(abs(r.whitened) for r in mine), w, atol=1e-7)


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    check_whitening(queries.op11_whitening(spark, SF_SMALL).collect(), rows)


def test_whitening_edges(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TREE", 2)  # several levels of merging
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.1] + [0, 0, 9, 0, -50, 0]], 1) for i in range(300)]
    rows += [(7, rows[7][1], 1)] * 50 + [(None, rows[9][1], None), (301, None, 1), (302, [], 1), (303, [1.0] * 5 + [None], 1)]
    rows += [(304, [1.0] * 5 + [float("nan")], 1), (305, [float("-inf")] + [1.0] * 5, 1), (306, [1.0, 2.0], 1), (307, [-0.0] * 6, 1), (308, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS x", "2 AS n", "3 AS component").repartition(9)
    got = whitening.whiten(df).collect()
    check_whitening(got, rows)
    assert sum(r.vec_id == 7 for r in got) == 4 * 51 and sum(r.vec_id is None for r in got) == 4


def test_whitening_without_spread(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(same.limit(0)).count() == 0
    line = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [3.0, 4.0], 0)], VECTORS)
    assert [(r.component, r.n) for r in whitening.whiten(line).collect()] == [(1, 2), (1, 2)]


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert whitening._deviations(x, 1 << 20, [0, 0]) == [None, 25 << 40]
    assert whitening._deviations(np.array([[1 << 28, 1]]), 1, [0, 0]) == [(1 << 56) + 1]


# -------------------------------------------------------------------- pages


def test_blocks_follow_the_markup():
    page = """<!DOCTYPE html><html class="has-menu"><head><title>T</title></head><body class="comments-open"><div id="cookie-notice">We use cookies</div>
    <header><a href=/>Site</a></header><form action=x><main><div class=breadcrumb>a / b</div><article class="post"><header class="entry-header">
    <h1>Title &amp; more</h1></header><p>One<br>two &nbsp; three<script>if(a<b){x="</p>"}</script> four <span class="ad">BUY</span>five<p>unclosed <b>bold
    <ul><li>x<li>y</ul><a href=1>Read more</a><div class="share-buttons"><p>Tweet</p></div><div hidden>h</div><div style="display: none">i</div>
    <section id="comments"><article class="comment"><p>nice</p></article></section><footer>foot</footer></article><aside><p>rel</p></aside></main></form>
    <footer>c</footer>"""
    assert blocks(page) == [("Title & more", KEEP), ("One two three four five", KEEP), ("unclosed bold", KEEP), ("x", KEEP), ("y", KEEP), ("Read more", OPEN)]


def test_blocks_of_broken_pages():
    assert blocks(None) == blocks("") == blocks("<!-- unclosed <p>x") == blocks("<script>x") == []
    assert blocks("a < b and <3 &amp &am &#x41;") == [("a < b and <3 & &am A", OPEN)]
    assert blocks("<p title='a>b'>q</p>&lt;p&gt;</div></b></nav><nav><p>m") == [("q", OPEN), ("<p>", OPEN)]
    assert blocks("<nav><a>m</a><article><p>t</article>") == [("t", KEEP)]  # the menu is never closed
    assert blocks("<aside><article><p>related</article></aside><p>text") == [("text", OPEN)]
    assert blocks("<TABLE><TR><TD>a<TD>b</TABLE><PRE>c\n d</PRE>") == [("a", OPEN), ("b", OPEN), ("c d", OPEN)]


def test_blocks_take_linear_time():
    for page in ("<div>" * 100_000 + "x", '<p a="' * 50_000, "<span class=ad>" * 30_000 + "</b>" * 30_000, "<div>" * 30_000 + "</p>" * 30_000, "<!--x" * 50_000 + "<title" * 50_000):
        blocks(page)


def test_common_lines_are_a_longest_common_subsequence():
    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = np.random.default_rng(3)
    for _ in range(1500):
        a, b = (rng.integers(0, 5, rng.integers(0, 16)).tolist() for _ in range(2))
        got = html_extract.common_lines(a, b)
        left = iter(b)
        assert got == sorted(set(got)) and len(got) == length(a, b) and all(a[i] in left for i in got)


def test_main_text_of_the_table(spark):
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        text = "\n".join(x for x in parts if x)
        want[r.page_id] = (r.url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_html_extract(spark, SF_SMALL).collect()} == want


def plain_pages(menu, article):
    return "".join(f"<div>{x}</div>" for x in menu) + "".join(f"<p>{x}</p>" for x in article) + "<div>All rights reserved</div>"


PAGES = "page_id long, url string, html string"


@pytest.fixture
def site():
    """A host whose pages say nothing of their parts, and what is to be found."""
    rows, want = [], {}
    for i in range(40):
        own = [f"Page {i} line {j} says something of its own, number {i * j}." for j in range(3)]
        rows.append((i, f"http://a.test/{'news' if i % 2 else 'sport'}/{i:03}", plain_pages(["Home", "News", "Sport"], own)))
        want[i] = "\n".join(own)
    return rows, want


def test_differencing_where_markup_is_silent(spark, site):
    rows, want = site
    copies = [(100 + i, rows[0][1] + f"?copy={i}", rows[0][2]) for i in range(30)]  # no page is a copy's neighbour but copies
    alone = [(200, "http://b.test/x", plain_pages(["Home"], ["Only here."])), (201, None, "<p>no host</p>"), (202, "::", None), (None, "http://a.test/", ""), (203, "http://[", "<p>t")]
    df = spark.createDataFrame(rows + copies + alone, PAGES).selectExpr("*", "'t' AS text", "1 AS lines", "2 AS digest")
    for block, parts in ((512, 3), (5, 11)):
        got = {r.page_id: r for r in html_extract.extract_main_text(df.repartition(parts), block).collect()}
        assert len(got) == 75
        assert {i: got[i].text for i in want} == want
        assert {got[r[0]].text for r in copies} == {want[0]}
        assert got[200].text == "Home\nOnly here.\nAll rights reserved" and got[201].text == "no host" and got[202].text == got[None].text == "" and got[203].text == "t"
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_differencing_passes_over_copies():
    a, b = ("h", "/a", [1, 2, 3], [9, 50, 50], bytes([OPEN] * 3)), ("h", "/c", [1, 7, 8], [9, 50, 50], bytes([OPEN] * 3))
    copy = ("h", "/ab", [1, 2, 3, 4], [9, 50, 50, 9], bytes([OPEN] * 4))
    assert html_extract.nearest_shared([a, copy], 0) == []
    assert html_extract.nearest_shared([a, copy, b], 0) == [0]
    kept = ("h", "/a", [1, 2, 3], [9, 50, 50], bytes([KEEP] * 3))
    assert html_extract.nearest_shared([kept, b], 0) == []  # the markup keeps the line


def test_pages_empty_table(spark):
    assert html_extract.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


# ----------------------------------------------------------------- manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows
    (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            at = i // 16 * 16
            yield "".join(level[at:i]), "".join(level[i + 1 : at + 16])
            i //= 16

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = levels([trees[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, (_, _, own, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            steps = [*path(trees[k], i), *path(top, j)]
            folded = own
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                folded = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            for left, right in steps:
                folded = digest(left + folded + right)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_manifest_of_the_table_and_its_sql(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(*[c.split()[0] for c in DOCS.split(", ")]).collect()
    got = queries.op13_merkle(spark, SF_SMALL).collect()
    want = plain_manifest([tuple(r) for r in rows])
    same(got, want)
    assert {r.verified for r in got} == {True, False}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    columns = ", ".join(got[0].__fields__)
    same(con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op13_merkle']})").fetchall(), want)


def test_manifest_edges(spark, monkeypatch):
    """Nulls, lone leaves, runs of one, a source with most rows, repeated rows,
    more sources than a run, blocks of few leaves."""
    monkeypatch.setattr(merkle, "BLOCK", 32)
    rows = [(i, "hot", "en", i % 7, f"Text {i} ÄÖ" * (i % 3)) for i in range(600)]
    rows += [(i, f"s{i}", None, None, None) for i in range(20)] + [(i, None, "en", 1, "null Source") for i in range(17)]
    rows += [(5, "hot", "en", 5, "Again")] * 3 + [(None, "hot", None, None, "No Id"), (None, None, None, None, None), (-3, "", "", 0, ""), (16, "é", "x", 1, "LONG " * 20_000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS run", "2 AS leaf", "3 AS part", "4 AS tree", "5 AS m", "6 AS first").repartition(7)
    same(merkle.document_manifest(df).collect(), plain_manifest(rows))


def test_manifest_small_tables(spark):
    for rows in ([], [(1, "a", "en", 1, "X")], [(1, "a", "en", 1, "X"), (2, "b", "en", 1, "Y")], [(i, "a", "en", 1, "X") for i in range(17)]):
        df = spark.createDataFrame(rows, DOCS)
        same(merkle.document_manifest(df).collect(), plain_manifest(rows) if rows else [])
