"""HTML text, vector search, registered queries and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import ann, htmltext, queries
from larder.llm.graph import components
from larder.llm.shared import documents

SMALL = "/root/testdata/sf0.001"
BODY = "<p>It rained, and it rained, and then the sun came out over the long green valley, as it does.</p>" * 4
PAGES = {
    f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1>{BODY}</article><aside>side</aside><footer>foot</footer></body>": "A & B " + " ".join(["It rained, and it rained, and then the sun came out over the long green valley, as it does."] * 4),
    f"<div id=menu><ul><li><a>x</a></ul></div><div class='post-content'>{BODY}<div class='ad'>Buy!</div><form><p>name, please, now</p></form></div><div class='comments'><p>First, second, third, a comment that is long, indeed.</p></div>": " ".join(["It rained, and it rained, and then the sun came out over the long green valley, as it does."] * 4),
    "<article><p>One<br>two  \n three<p>four <b>fi</b>ve<script>var t='</p>';</script></article>": "One two three four five",
    "<p>unclosed <i>tag": "unclosed tag",
    "": "",
    "<nav><a>only</a></nav>": "",
}


def test_main_text():
    for page, want in PAGES.items():
        assert htmltext.main_text(page) == want
    assert htmltext.main_text(None) == ""


def test_marks_inside_tags():
    # a quote opens a value only after "="
    assert htmltext.main_text(f"<article><p data-x=it's>First, one, two.</p>{BODY}</article>").startswith("First, one, two. It rained")
    assert htmltext.main_text(f"<article><p title=\"a>b\" id='c>d' =x>First, one.</p>{BODY}</article>").startswith("First, one. It rained")
    assert htmltext.main_text(f"<article><p class=\"x>First, one.</p>{BODY}</article>").endswith("as it does.")
    # marks inside a script do not reach beyond it
    assert htmltext.main_text(f"<article><script>if (a<b && c='x) {{ '<!-- ' }}</script><p>After, it, came.</p>{BODY}</article>").startswith("After, it, came. It rained")
    # letters whose lower case is longer do not shift what follows a script
    assert htmltext.main_text(f"<article><p>İİİİİİ, one, two.</p><SCRIPT>var a = '<p>no</p>';</Script><p>After, it, came.</p>{BODY}</article>").startswith("İİİİİİ, one, two. After, it, came. It rained")


def test_names_with_words_of_other_parts():
    page = f"<div><article>{BODY}<p class='share-price'>The share price rose by two, to nine, in the early hours of the day.</p><p class='alert-system note'>Sirens, forty of them, make up the alert system of the old town.</p><div class='share-buttons'><a href='#'>Share</a> <a href='#'>Send</a></div><div class='cookie-banner'>We use cookies, as all do, and you may accept.</div></article></div>"
    text = htmltext.main_text(page)
    assert "rose by two" in text and "Sirens, forty" in text and "Share" not in text and "cookies" not in text


def test_time_is_linear_in_malformed_pages():
    import time

    def took(page):
        begun = time.perf_counter()
        htmltext.main_text(page)
        return time.perf_counter() - begun

    pages = {
        "inline": lambda n: "<i>x" * n + "</b>" * n, "quotes": lambda n: "<p a=\"" * n + "x", "cut": lambda n: "<a " * n, "lists": lambda n: "<div><li>x" * n,
        "paragraphs": lambda n: "<b>" * n + "<p>x" * n, "svg": lambda n: "<svg>x" * n, "doubted": lambda n: "<div class=ad><article>x, y" * n, "comments": lambda n: "<!-- " * n, "less": lambda n: "<" * n,
    }
    for name, make in pages.items():
        took(make(2000))
        small, large = took(make(4000)), took(make(32_000))
        assert large < 0.2 or large < 20 * small, (name, small, large)  # eight times the page
    assert took("<p title=it's>word, and " * 200_000) < 20  # 5 MB


def test_parser_agrees_with_a_plain_one_on_pages(spark):
    # html.parser finds tags on its own; the given pages hold the article in one element
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.skip, self.out = False, 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.skip += tag in ("script", "style")
            if tag in htmltext.BLOCK:
                self.out.append("")
            elif tag == "br":
                self.out[-1] += " "

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            self.skip -= tag in ("script", "style")
            if tag in htmltext.BLOCK:
                self.out.append("")

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.out[-1] += data

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op9_html_text(spark, SMALL).collect()}
    for r in rows:
        plain = Plain()
        plain.feed(r.html)
        assert got[r.page_id] == " ".join(x for x in (" ".join(b.split()) for b in plain.out) if x)


def test_pages_table(spark):
    rows = [(i, "u", p, 1) for i, p in enumerate(PAGES)] + [(None, None, None, 1), (0, "u", next(iter(PAGES)), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmltext.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert htmltext.extract_pages(pages.where("false")).count() == 0


def test_search_is_exact_on_few_and_good_on_many(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:350] = x[50]  # half of the rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [None] * 8), (None, [1.0] * 8), (980, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        score = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        g = g.sort_values("rank")
        assert len(g) == 20 and list(g["rank"]) == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, score[g.vec_id], atol=1e-12)
        hits, total = hits + len(set(order) & set(g.vec_id)), total + 20
    assert set(got.query_id) == set(range(0, 600, 20)) and hits / total >= 0.9
    whole = ann.nearest(df, F.col("vec_id") % 20 == 0, exact=True, block=100, query_block=7).toPandas()
    for q, g in whole.groupby("query_id"):
        score = (x.astype(np.float64) * x[q].astype(np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        assert np.allclose(sorted(g.score, reverse=True), score[order], atol=1e-12) and len(set(order) & set(g.vec_id)) >= 19  # sums may differ in their last bits
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).toPandas()
    assert list(few["rank"]) == [1, 2, 3, 4]
    assert ann.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 3"), F.col("vec_id") == 3).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (9, 3), *[(100 + i, 101 + i) for i in range(40)]]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    found = queries.QUERIES[name](spark, SMALL)
    columns = ", ".join(found.columns)
    want = sorted(con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=str)
    got = sorted(map(tuple, found.collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert [x for x in g if not isinstance(x, float)] == [x for x in w if not isinstance(x, float)]
        assert [x for x in g if isinstance(x, float)] == pytest.approx([x for x in w if isinstance(x, float)])


def test_pipeline_stages(spark):
    docs = documents(spark, SMALL).where("n_chars < 4000")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "pii", "mixing", "packing"]
    from larder.llm.shared import written

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SMALL), name)
        seen[name] = docs.count()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            assert 0 < seen[name] < before.count()
        if name == "pii":
            assert seen[name] == seen["near_dedup"] and docs.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9]+\.")).count() == 0
    tokens = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert tokens.where("n > 2048").count() == 0
