"""Layout wrappers whose class, id or role has a word of what is not the article."""

import pytest

from weft.llm.htmltext import main_text

BODY = "<div class='post'><p>" + "the article goes on " * 10 + "</p></div><div class='comments'><p>nice</p></div>"
TEXT = ("the article goes on " * 10).strip()


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "class='no-sidebar'", "class='with-comments'", "class='header-fixed'", "id='page-header-wrap'", "class='x header-fixed has-widgets'"])
def test_layout_classes_keep_the_article(wrapper):
    assert main_text(f"<html><body><div {wrapper}>{BODY}</div></body></html>", None) == TEXT


@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrapper_of_article_and_main(tag):
    page = f"<body><div class='menu'><{tag}><p>short article</p></{tag}></div><div class='sidebar'><p>{'side text ' * 40}</p></div></body>"
    assert main_text(page, None) == "short article"


def test_chrome_stays_chrome():
    talk = "<div class='comments'><article class='comment-body'><p>" + "loud talk " * 60 + "</p></article></div>"
    assert main_text(f"<body><div class='post'><p>{TEXT}</p></div>{talk}<div class='cookie-notice'><p>cookies</p></div></body>", None) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='legal'><p>Statute text of the law</p></div>", "Statute text of the law"),
        ("<article><p>one</p><section class='related-work'><p>two</p></section></article>", "one\ntwo"),
        ("<article><p>one</p><div class='related-links'><a href='x'>other page</a></div></article>", "one"),
        ("<article><p>one</p><div class='notice'><p>this was changed</p></div></article>", "one"),
        ("<p>bare paragraphs " + "of some length " * 8 + "</p><div><p>small</p></div>", "bare paragraphs " + ("of some length " * 8).strip() + "\nsmall"),
    ],
)
def test_weak_words(page, text):
    assert main_text(page) == text


def test_pages_of_a_host_vote_on_marked_parts(spark):
    """A section that differs from page to page belongs to the article, one that is the same everywhere does not."""
    body = "<article><p>{}</p><section class='notice'><p>{}</p></section></article>"
    words = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(5)]
    pages = [(i, "https://varied.example/", body.format(words[i], f"part {i} of the story")) for i in range(5)]
    pages += [(10 + i, "https://alike.example/", body.format(words[i], "we changed our terms")) for i in range(5)]
    pages += [(20, "https://single.example/", body.format(words[0], "we changed our terms"))]
    from weft.llm import htmltext

    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {i: f"{words[i]}\npart {i} of the story" for i in range(5)} | {10 + i: words[i] for i in range(5)} | {20: words[0]}
    assert {r.page_id: r.text for r in htmltext.op6(df).collect()} == want


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 64_000 + "deep",
        "<b>" * 64_000 + "deep",
        "<p><td>" + "<ul>" * 64_000 + "<ul>" * 64_000 + "deep",
        '<a "' * 64_000,
        '<a ="' * 64_000 + ">" + "x",
        "<div><p>x</p>" + "<span>s</span></div></p></td>" * 64_000,
        "<script>" + "</script" * 64_000,
        "<article>" + "<p class='notice'>n</p>" * 100_000 + "</article>",
        "<main>" * 30_000 + "text",
    ],
)
def test_time_grows_with_the_page(page):
    import time

    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 8


def test_pages_of_the_test_data(spark):
    """Every page of the test data is an article in one known frame: its text is that of the article element."""
    import html
    import re

    from weft.llm import htmltext

    def article(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        inner = re.sub(r"<script.*?</script>|<style.*?</style>|<form.*?</form>|<aside.*?</aside>|<!--.*?-->", "", inner, flags=re.S)
        parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|table|tr|td|th|blockquote|pre|section|figure|figcaption)\b[^>]*>", inner)
        texts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br ?/?>", " ", x)))).strip() for x in parts)
        return "\n".join(t for t in texts if t)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect() if r.html and "<article>" in r.html}
    got = {r.page_id: r.text for r in htmltext.op6(pages).collect()}
    wrong = [i for i in want if want[i] != got[i]]
    assert len(want) > 200 and not wrong, (len(wrong), want[wrong[0]][:300], got[wrong[0]][:300])
