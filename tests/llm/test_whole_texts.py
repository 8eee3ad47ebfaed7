"""Whole texts and articles: wrappers with names of other parts, languages of long texts."""

from __future__ import annotations

import pytest

from larder.llm import htmltext, langid


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "content-sidebar-wrap", "page with-footer", "layout sidebar"])
def test_wrappers_named_for_other_parts_keep_the_article(name):
    body = "<p>It rained, and it rained, and then the sun came out over the long green valley, as it does.</p>" * 4
    talk = "<div class='comments'>" + "<p>First, second, third, a comment that is long, indeed.</p>" * 30 + "</div>"
    box = "<div class='sidebar'><p>Some box, of words.</p></div><div class='related'><article><p>A teaser.</p></article></div>"
    for inside in (body, f"<article>{body}</article>", f"<div class='hentry'>{body}{talk}</div>{box}"):
        for after in ("", "<p>Outside, too.</p>", talk, box):
            text = htmltext.main_text(f"<body><div class='{name}'>{inside}</div>{after}</body>")
            assert text.count("It rained,") == 4 and not any(x in text for x in ("comment", "box", "teaser"))
    assert htmltext.main_text(f"<div class='sidebar'>{body}</div>").count("It rained,") == 4
    assert htmltext.main_text("<div id=menu><ul><li><a>x</a></ul></div>") == ""


def test_languages_of_long_texts_teach(spark):
    rows = [(i, "the quick brown fox and the lazy dog " * 600, "en") for i in range(20)] + [(100 + i, "der schnelle braune Fuchs und der faule Hund", "de") for i in range(20)]
    rows += [(200 + i, None, "fr") for i in range(9000)] + [(9999, "le renard brun et le chien paresseux", "fr")]
    learned = langid.learn_dictionaries(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"de", "en", "fr"} and all(learned.values())
    found = langid.identify_languages(spark.createDataFrame([(1, "the lazy dog and the brown fox")], "doc_id long, text string"), learned)
    assert found.first().lang_pred == "en"
