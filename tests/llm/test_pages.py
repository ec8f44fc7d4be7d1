"""Comments and notices whose names tell little, hidden elements, layouts; word by word on the given pages."""

import html
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from sitegrid.llm import extract

ARTICLE = "<h1>Title here</h1><p>First paragraph of the story, with several words in it.</p>{}<p>Second one follows.</p>"


@pytest.fixture(scope="module")
def model():
    return extract.fit()


@pytest.mark.parametrize("name", ["replies", "discussion", "responses", "feedback", "reviews", "thread", "comments", "zzz", "readers-say", "talkback"])
@pytest.mark.parametrize("heading", ["", "<h2>Replies</h2>", "<h3>3 Comments</h3>"])
def test_reader_comments_after_the_article_go(model, name, heading):
    t = model.extract(f"<html><body><nav><a href='/'>Home</a></nav><article>{ARTICLE.format('')}</article><section class='{name}'>{heading}<div class='c'><p>I think this is a very good text, thank you.</p></div><div class='c'><p>Me too, well done.</p></div></section><footer>f</footer></body></html>")
    assert t.endswith("Second one follows.") and "thank you" not in t


@pytest.mark.parametrize("name", ["announcement", "top-bar", "gdpr", "paywall", "legal", "bio", "author-box", "pager", "notice", "alert"])
def test_notices_in_the_article_go(model, name):
    t = model.extract(f"<html><body><article>{ARTICLE.format(f'<div class={chr(34)}{name}{chr(34)}><p>This page is closed today, see you next week.</p></div>')}</article></body></html>")
    assert "closed" not in t and "First" in t and "Second" in t


@pytest.mark.parametrize("name", ["chapter", "part-two", "box", "lead", "zzz", "wide"])
def test_boxes_of_the_article_stay(model, name):
    t = model.extract(f"<html><body><article>{ARTICLE.format(f'<div class={name}><h2>More on that</h2><p>This belongs to the story, as one can see, at some length.</p></div>')}</article></body></html>")
    assert "This belongs" in t and "More on that" in t


@pytest.mark.parametrize("how", ["hidden", "style='display:none'", 'style="color:red; Display : None;"', "style='visibility: hidden'"])
def test_hidden_elements_have_no_text(model, how):
    t = model.extract(f"<html><body><article>{ARTICLE.format(f'<div {how}>unseen <b>words</b></div>')}</article></body></html>")
    assert "unseen" not in t and "words" not in t.replace("several words", "") and "Second" in t


def test_tables_of_layout_and_of_content(model):
    assert model.extract("<html><body><table><tr><td><a href='/'>Home</a> <a href='/n'>News</a></td></tr><tr><td><h1>T</h1><p>Words of the page in a cell, quite a few of them.</p></td></tr></table></body></html>") == "T\n\nWords of the page in a cell, quite a few of them."
    assert model.extract("<html><body><article><h1>T</h1><p>Words of the page.</p><table><tr><td>cell</td><td>two</td></tr></table></article></body></html>") == "T\n\nWords of the page.\n\ncell\n\ntwo"


def test_given_pages_word_by_word(model):
    """Precision and recall of words against the article element."""
    hit = more = less = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        m = re.search(r"<article>(.*?)</article>", page or "", re.S)
        if m:
            want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style).*?</\1>|<!--.*?-->", " ", m[1], flags=re.S))).split())
            got = Counter(model.extract(page).split())
            hit, more, less = hit + (want & got).total(), more + (got - want).total(), less + (want - got).total()
    assert hit > 10_000 and hit / (hit + more) > 0.999 and hit / (hit + less) > 0.999
