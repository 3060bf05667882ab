"""Secrets and main text: hostile inputs end soon, articles are kept, entropy finds what the base patterns miss."""

import random
import time

import pytest

from sievelake.llm import html_blocks, secrets

BODY = "The house of the miller was on the hill and it was seen from all of the town, which is why they had not been there for long."


@pytest.mark.parametrize("text", ["-" * 1_000_000 + "1", "=" * 1_000_000 + "9", "a-" * 400_000 + "1", "A_" * 400_000 + "b", "token" + " " * 1_000_000, 'password="abcdefgh" ' * 30_000])
def test_secrets_end_soon(text):
    began = time.time()
    secrets.find_secrets(text)
    assert time.time() - began < 10


@pytest.mark.parametrize("html", ['<a "' * 250_000, '<a b="' * 200_000, "<!" * 400_000, "</" * 300_000, "<span>" * 50_000 + "</i>" * 50_000, "<i><div>" + "<span>" * 50_000 + "</i>" * 50_000, "<svg/>" * 100_000, "<p>ab" * 50_000])
def test_pages_end_soon(html):
    began = time.time()
    html_blocks.main_text(html)
    assert time.time() - began < 10


@pytest.mark.parametrize("page", ['<article class="overflow-hidden"><p>{}</p></article>', '<p title="a hidden gem">{}</p>', '<div class="message-body"><p>{}</p></div>', "<p title='x>y'>{}</p>"])
def test_articles_are_kept(page):
    assert html_blocks.main_text(page.format(BODY)) == BODY


def test_language_without_stop_words_is_kept():
    text = " ".join(f"slovo{i}" for i in range(40))
    assert html_blocks.main_text(f"<div><p>{text}</p></div>") == text


@pytest.mark.parametrize("page", ['<div class="sidebar-left"><p>{}</p></div>', "<p hidden>{}</p>", '<p style="display: none">{}</p>', '<div class="site-nav">{}</div>', '<div id=comments><p>{}</p></div>'])
def test_boilerplate_goes(page):
    assert html_blocks.main_text(f"<p>{BODY}</p>" + page.format(BODY)) == BODY


def test_pages_as_dataframe(spark):
    schema = "page_id bigint, url string, html string, text string, `n.chars` int"
    rows = [(1, "u", None, "x", 0), (2, None, "", "x", 0), (3, "u", f"<p>{BODY}&amp;</p>", "x", 0), (3, "u", f"<p>{BODY}&amp;</p>", "x", 0), (None, None, "<p>é\n\U0001f600 b</p>", None, None)]
    got = sorted(html_blocks.extract_main_text(spark.createDataFrame(rows, schema)).collect(), key=repr)
    want = [(1, "u", "", 0), (2, None, "", 0), (3, "u", BODY + "&", len(BODY) + 1), (3, "u", BODY + "&", len(BODY) + 1), (None, None, "é \U0001f600 b", 5)]
    assert [tuple(r) for r in got] == want
    assert html_blocks.extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_secrets_as_dataframe(spark):
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    base64_key, hex_key = "".join(rng.choice(letters) for _ in range(44)), "9f3a1c7be2045d6881fa"
    schema = "doc_id bigint, text string, spans string, kind int"
    rows = [(1, None, "x", 0), (2, "", "x", 0), (3, f"é {base64_key} end", "x", 0), (3, f"é {base64_key} end", "x", 0), (4, f"\U0001f600 {hex_key}", "x", 0), (None, 'secret = "longenough"', None, None)]
    got = {(r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in secrets.scan_secrets(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, ()), (2, ()), (3, (("entropy", 2, 46),)), (4, (("entropy", 2, 22),)), (None, (("assign", 0, 20),))}
    assert secrets.scan_secrets(spark.createDataFrame([], schema)).collect() == []
