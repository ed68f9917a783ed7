"""What is kept and left out inside articles."""

import pytest

from eraframe.llm import html_text


def text_of(inside):
    return html_text.main_text(html_text.tree(f"<body><nav>Menu</nav><article><h1>Head</h1>{inside}<p>End</p></article></body>"), frozenset())


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ("<section class='social history'><p>Of the people</p></section>", True), ("<p class='share'>Share of votes rose</p>", True), ("<div class='widget'><p>A widget is a thing</p></div>", True),
        ("<div id='related-work'>Earlier studies</div>", True), ("<p class='notice period'>Two weeks</p>", True), ("<header class='entry-header'>Sub</header>", True),
        ("<div class='share'><a href='x'>Tweet</a> <a href='y'>Post</a></div>", False), ("<div class='comments'><p>Nice read</p></div>", False), ("<div class='ad'>Buy now</div>", False),
        ("<section id='comments' class='comments-area'><p>First!</p></section>", False), ("<div role='complementary'><p>Aside</p></div>", False), ("<form><p>Your name</p></form>", False),
        ("<div class='social'></div>", False), ("<aside>Aside</aside>", False), ("<p hidden>Hidden</p>", False),
    ],
)
def test_marks_inside_articles(inside, kept):
    plain = html_text.SPACE.sub(" ", html_text.re.sub("<[^>]*>", " ", inside)).strip()
    assert text_of(inside) == ("\n".join(["Head", plain, "End"]) if kept and plain else "Head\nEnd")


def test_marked_template_inside_articles(spark):
    page = "<body><article><h1>T {0}</h1><p>Words {0}</p><div class='notice'><p>We use your data</p></div><div class='share'><p>Share {0} of it</p></div></article></body>"
    df = spark.createDataFrame([(i, f"https://a.example/{i}", page.format(i)) for i in range(30)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(df).collect()} == {i: f"T {i}\nWords {i}\nShare {i} of it" for i in range(30)}


def test_deep_and_long_pages():
    deep = "<div class='share'>" * 10_000 + "x" + "</div>" * 10_000
    assert text_of(deep) == "Head\nx\nEnd"
