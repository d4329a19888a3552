"""Furniture by name in several languages, topics inside articles, titles in headers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from duskline.llm import htmltext

STORY = "<p>The first part, which is long enough, says what happened in the town on that day.</p><p>The second, no shorter, says why, and who was there.</p>"
TEXT = "The first part, which is long enough, says what happened in the town on that day.\nThe second, no shorter, says why, and who was there."


def text_of(spark, *pages):
    df = spark.createDataFrame([(i, f"https://h{i}.example/a", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in htmltext.extract(df).orderBy("page_id").collect()]


@pytest.mark.parametrize("name", ["werbung", "Anzeigen-Block", "kommentare", "publicité", "commentaires", "publicidad", "comentarios", "pubblicità", "reacties", "ads"])
def test_names_in_several_languages(spark, name):
    page = f"<html><body><div class='{name}'><p>Buy this, buy that, and then, at once, buy the rest of it as well.</p></div><div id='main'>{STORY}</div></body></html>"
    assert text_of(spark, page) == [TEXT]


def test_topics_inside_articles(spark):
    page = "<html><body><div class='promotion'><p>Buy, now.</p></div><article>{}<div class='promotion'><p>He got a promotion, at last.</p></div><div class='werbung'><p>Kauf, jetzt.</p></div></article></body></html>"
    assert text_of(spark, page.format(STORY)) == [TEXT + "\nHe got a promotion, at last."]


def test_headers_of_content_parts(spark):
    page = "<html><body><header><h1>The site, its name</h1></header><div class='main'><header>{}</header>" + STORY + "</div></body></html>"
    got = text_of(spark, page.format("<h1>The title</h1>"), page.format("<h1><a href='/'>The site</a></h1>"), page.format("<p>Tag line</p>"), page.format(""))
    assert got == ["The title\n" + TEXT, TEXT, TEXT, TEXT]


def test_wrappers_named_as_content_keep_page_headers_out(spark):
    page = f"<html><body><div id='content'><header><nav><a href='/'>Home</a></nav><div class='logo'>Logo</div></header><article><header><h1>Title</h1></header>{STORY}</article></div></body></html>"
    assert text_of(spark, page) == ["Title\n" + TEXT]


def test_long_page_with_many_headers(spark):
    page = "<html><body>" + "<div class='post'><header><h1>T</h1></header><p>Some words, and more of them, here.</p></div>" * 300 + "</body></html>"
    df = spark.createDataFrame([(1, None, page)], "page_id long, url string, html string").withColumn("_host", F.lit(1))
    assert htmltext.extract(df).first().text.count("Some words") >= 1
