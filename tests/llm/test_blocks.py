"""Cutting pages into blocks, against the standard library's parser; odd raw elements."""

import random
from html.parser import HTMLParser

from gridgrove.llm import html


class Plain(HTMLParser):
    """All text outside scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_blocks_have_all_text():
    rng = random.Random(3)
    raw = ("<script>var İ = '<p>no</p>';</script>", "<SCRIPT type=x>a</scriptx> b</SCRIPT >", "<style media='a>b'>p{}</STYLE\n>", "<Style>ſ</style>", "<!-- <p>c --x> -->", "<!DOCTYPE html>")
    inline = ("<b class='x y'>", "</b>", '<a href="q?a=1&amp;b=2">', "</a>", "<br>", "<img alt='>'>", "<span id=s>")
    block = ("<p>", "</p>", "<DIV class='w-full px-4 py-2 mt-4 sidebar related'>", "</div>", "<li>", "<ul>", "</ul>", "<h1>", "</H1>", "<table><tr><td>")
    for _ in range(400):
        parts = rng.choices(raw + inline + block + ("İİİ", "word ", "x &amp; y ", "&#233;t&eacute; ", "ſ", "K", "\n\t", "3 < 4 "), k=rng.randint(1, 60))
        if rng.random() < 0.2:
            parts.append(rng.choice(("<script>never ended İ", "<style>p")))
        page = "".join(parts)
        parser = Plain()
        parser.feed(page)
        parser.close()
        want = "".join("".join(parser.out).split())
        assert "".join("".join(b.text for b in html.blocks(page)).split()) == want, page


def test_raw_elements_after_letters_that_grow():
    page = "İ" * 40 + "<script>x</script><p>first</p><TEXTAREA>in</textarea><p>second</p>"
    assert [b.text for b in html.blocks(page)] == ["İ" * 40, "first", "in", "second"]


def test_all_hints_are_read():
    (only,) = html.blocks("<div class='w-full px-4 py-2 mt-4 mx-1 sidebar related'>x</div>")
    assert {"sidebar", "related"} <= set(only.hints)


def test_sampled_words(spark):
    rows = [(k, "<p>" + " ".join(f"w{k}x{j}" for j in range(50)) + "</p>") for k in range(30)] + [(1, "<p>again</p>"), (None, "<p>nobody</p>"), (40, None), (41, "")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    found = html.sample_words(pages, "html", "page_id", 10, 100)
    assert len(found) == 100 and len({w.split("x")[0] for w in found} - {"again"}) <= 10 and "nobody" not in found
    assert found == html.sample_words(pages.repartition(3), "html", "page_id", 10, 100)
    assert html.sample_words(pages.limit(0), "html", "page_id") == []


def test_op5_query(spark, tmp_path):
    page = "<html><body><nav><ul><li><a href=a>Home</a></ul></nav><article><h1>Title here</h1><p>" + "Some words of prose. " * 2000 + "</p></article><footer>&copy; x</footer>"
    rows = [(k, "u", f"<article><p>w{k} some words of it</p></article>") for k in range(20)] + [(50, "u", page), (51, None, None), (None, "u", ""), (50, "u", page)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = html.op5_html(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = got.collect()
    assert len(got) == 24 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (51, None)] == ["", ""]
    assert all(r.text.count("Some words of prose.") == 2000 and "Home" not in r.text for r in got if r.page_id == 50)
