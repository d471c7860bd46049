"""Markup that is left open, odd comments, and very many stray or unknown tags."""

import time

import pytest

from orbita.llm import html_blocks

ARTICLE = "<article><p>One text, with some words in it.</p><p>Another one; and more.</p></article>"
TEXTS = ["One text, with some words in it.", "Another one; and more."]


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


@pytest.mark.parametrize("tag", ["svg", "noscript", "iframe", "object", "canvas", "template"])
def test_hidden_elements_that_are_left_open(tag):
    closed = f"<{tag} class='x'><g>hidden</g></{tag}>"
    for page in (
        f"<body><{tag}>{ARTICLE}</body>", f"<body><{tag} a=1>{ARTICLE}", f"<{tag}><body>{ARTICLE}{closed}</body>" if tag != "template" else f"<{tag}>{ARTICLE}",
        f"<body><div><{tag}></div>{ARTICLE}</body>", f"<body>{closed}{ARTICLE}{closed}</body>", f"<body><{tag}/>{ARTICLE}</body>", f"<body>{ARTICLE}<{tag}></body>", f"<body></{tag}>{ARTICLE}",
    ):
        if page.startswith(f"<{tag}>") and tag in ("object", "canvas"):
            continue  # closed at its own end tag, with all in it
        assert texts(page) == TEXTS, page
    assert texts(f"<p>a</p><{tag}><p>kept</p>") == ["a", "kept"]


def test_nested_hidden_elements_and_ends():
    assert texts("<p>a</p><template><p>x</p><template><p>y</p></template><p>z</p></template><p>b</p>") == ["a", "b"]
    assert texts("<div><object><object></object>x</object>b</div>") == ["b"]
    assert texts("<body><svg><path/><text>x</text><p>a</p></body>") == ["a"] and texts("<body><svg><title>x</title></svg><p>a</p>") == ["a"]
    assert texts("<body><noscript><p>first</p><p>a</p><noscript>x</noscript><p>b</p></body>") == ["first", "a", "b"]


def test_comments():
    for c in ("<!-->", "<!--->", "<!-- x --!>", "<!-- <p>no</p> -->", "<!---->"):
        assert texts(f"<body>{c}{ARTICLE}</body>") == TEXTS, c
    assert texts("<p>a</p><!-- open <p>b</p>") == ["a"]


@pytest.mark.parametrize("many", ["</x>", "<x>", "</p>", "<li>", "<svg>", "<noscript>", "<object>", "<template><b>", "<ul><li>", "<!-->", "<p><x>", "<dt><q>"])
def test_very_many_odd_tags_take_linear_time(many):
    for page in (many * 40_000 + "<p>last</p>", f"<ul>{'<x>' * 20_000}{many * 20_000}<p>last</p></noscript></object></svg></template>"):
        began = time.process_time()
        html_blocks.blocks(page)
        assert time.process_time() - began < 2


def test_odd_pages_through_the_query(spark):
    pages = [f"<html><body><nav><ul><li>Home page</li></ul></nav>{odd}<article>" + "".join(f"<p>Paragraph {i} of a longer text, which goes on and on for page {k}.</p>" for i in range(6)) + "</article><footer><p>Imprint</p></footer></body></html>" for k, odd in enumerate(("", "<svg>", "<noscript>", "<iframe src=x>", "<object>", "<!-->", "<!-- x --!>", "</x>" * 9))]
    got = {r["page_id"]: r["text"] for r in html_blocks.extracted(spark.createDataFrame(list(enumerate([None] * 8, 100)) + [], "page_id long, url string").selectExpr("page_id", "url", "cast(null as string) html").unionByName(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string"))).collect()}
    for k in range(len(pages)):
        assert got[k] == "\n".join(f"Paragraph {i} of a longer text, which goes on and on for page {k}." for i in range(6)), k
    assert got[100] == ""
