"""Near copies under a shared passage, columns of any name through the pipeline, formulas and headlines of pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import htmltext, langid, mixing, neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = "rows n size source_size target taken __rest __copy copy row held comp node key bucket spans budget words".split()


def boilerplate(pairs, seed=1):
    """Documents of which any two are 0.70 alike by a passage of 300 words; each but few is 0.756 alike to one other."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(304)]
    docs = []
    for i in range(pairs):
        shared = [f"s{i}_{j}" for j in range(14)]
        for k in (0, 1):
            docs.append(" ".join(passage + shared + [f"o{i}_{k}_{rng.randrange(10**6)}" for _ in range(50)]))
    return docs


def links_of(docs):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (d.split() for d in docs)]
    near = [100 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(docs), 2)]
    far = 100 * len(sets[0] & sets[2]) / len(sets[0] | sets[2])
    return min(near), far


def test_no_link_is_lost_under_a_shared_passage(spark):
    docs = boilerplate(600)
    near, far = links_of(docs)
    assert near >= 75 and far < 75 and near - far < 6
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows).collect()}
    assert got == {i: i - i % 2 for i in range(len(docs))}


def test_stages_keep_columns_of_any_name(spark):
    words = ["the house is", "la maison est", "das haus ist", "la casa es"]
    rows = [(i, " ".join(f"{words[i % 4]} {'abcd'[i % 4]}{j % 17} w{i}x{j}" for j in range(40)), ["en", "fr", "de", "es"][i % 4], "ab"[i % 2], 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id")) for c in NAMES})
    assert set(langid.learn_dictionaries(docs)) == {"en", "fr", "de", "es"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.select("doc_id", *NAMES).collect()
        assert found and all(r[c] == f"{c}-{r.doc_id}" for r in found for c in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 40


def test_no_rows_through_all_stages(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_mixed_documents_with_maps_and_no_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y")], "doc_id long, text string, source string")
    assert mixing.mix_documents(docs).columns == docs.columns
    mapped = docs.withColumn("size", F.create_map(F.lit("k"), F.col("doc_id")))
    assert {r["size"]["k"] == r.doc_id for r in mixing.mix_documents(mapped).collect()} == {True}


PARAGRAPH = "<p>" + "A long sentence of the article, with commas, and words that go on and on for a while. " * 4 + "</p>"


@pytest.mark.parametrize("page, held, gone", [
    (f"<body><div class=article><p>The area is <math><mi>x</mi><mo>+</mo><mn>2</mn></math> units, as stated.</p>{PARAGRAPH}</div></body>", ["The area is x+2 units, as stated."], []),
    (f"<body><div class=article><p>So <math><mi>y</mi><annotation>\\tex</annotation></math> it is, by all means.</p>{PARAGRAPH}</div></body>", ["So y it is"], ["tex"]),
    (f"<body><h1>The headline</h1><div class=article>{PARAGRAPH * 3}</div></body>", ["The headline A long"], []),
    (f"<body><h1>The site</h1><div class=article><h1>The headline</h1>{PARAGRAPH * 3}</div><h2>More to read</h2></body>", ["The headline A long"], ["The site", "More to read"]),
    (f"<body><h1><a href=/>Home</a></h1><div class=article>{PARAGRAPH * 3}</div></body>", ["A long"], ["Home"]),
    (f"<body><div class=article><p>Press <button>Go</button> now, and wait for it to end.</p>{PARAGRAPH}<p class=notice>Some notice, to all readers of this.</p></div></body>", ["Press now, and"], ["Go now", "notice"]),
])
def test_formulas_and_headlines(page, held, gone):
    text = htmltext.main_text(page)
    assert all(h in text for h in held) and not any(g in text for g in gone)
