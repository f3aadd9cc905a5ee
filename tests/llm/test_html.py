import pytest

from weftline.llm import html

ARTICLE = "<p>One sentence, and one more. It goes on for a while, as articles do.</p><p>A second paragraph follows; it is long enough, too.</p>"
TEXT = "One sentence, and one more. It goes on for a while, as articles do. A second paragraph follows; it is long enough, too."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b", "a b"),
        (f"<body><nav><a href=x>Menu, one.</a></nav><article><h1>Title</h1>{ARTICLE}</article><footer>&copy; x</footer></body>", "Title " + TEXT),
        (f"<body><div class='nav'><a>x</a></div><div id=main><h2>Head</h2>{ARTICLE}</div><div class='ad'>Buy this now, it is good. Really, do.</div></body>", "Head " + TEXT),
        (f"<article>{ARTICLE}<div id=comments><p>First! A comment, long enough to be a text, really long.</p></div></article>", TEXT),
        (f"<article>{ARTICLE}<form><p>Your name, please.</p><input></form><aside>Side, note.</aside></article>", TEXT),
        (f"<script>var t='</p><p>no, text.</p>';</script><style>p{{}}</style><article>{ARTICLE}</article><!-- <p>gone, too</p> -->", TEXT),
        ("<article><p><b>Bold start<br>next line,<p>new  block\n here.</p></article>", "Bold start next line, new block here."),
        ("<article><p>Tom &amp; &quot;Jerry&quot; &#233;&#xe9; &lt;b&gt;</p></article>", 'Tom & "Jerry" éé <b>'),
        ("<article><ul><li>one, two<li>three, four</ul></article>", "one, two three, four"),
        ("<article><p title='a > b'>In <i>one</i><a href='x'>word</a>.</p></article>", "In oneword."),
        ("<article><p>cut off, in the mid", "cut off, in the mid"),
        ("<article><div><p>deep, text.</p></article><p>after, all of it. And more, and more, and more.</p>", "deep, text."),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def paragraphs(name, n):
    return "".join(f"<p>{name} paragraph {i} says something, and then it says some more of it, as texts do.</p>" for i in range(n))


def wanted(name, n):
    return " ".join(f"{name} paragraph {i} says something, and then it says some more of it, as texts do." for i in range(n))


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div id=content><section>{paragraphs('First', 6)}</section><section>{paragraphs('Second', 4)}</section></div></body>",
        f"<body><div><div>{paragraphs('First', 6)}</div></div><div><div><div>{paragraphs('Second', 4)}</div></div></div></body>",
        f"<table><tr><td>{paragraphs('First', 6)}</td></tr><tr><td>{paragraphs('Second', 4)}</td></tr></table>",
        f"<body><div>{paragraphs('First', 6)}</div><div><article><p>A card, short.</p></article></div><div>{paragraphs('Second', 4)}</div></body>",
    ],
)
def test_sections_without_an_article_all_count(page):
    got = html.main_text(page)
    assert wanted("First", 6) in got and wanted("Second", 4) in got


def test_most_of_a_page_in_one_article_is_alone():
    page = f"<body><article>{paragraphs('First', 6)}</article><div>{paragraphs('Other', 2)}</div></body>"
    assert html.main_text(page) == wanted("First", 6)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content has-sidebar'>{ARTICLE}</div></body>",
        f"<body><main class=no-sidebar>{ARTICLE}</main></body>",
        f"<body><article class='post has-comments'>{ARTICLE}</article></body>",
        f"<body><main class=menu>{ARTICLE}</main></body>",
        f"<body><div id=page-with-nav>{ARTICLE}<div class=sidebar-left><p>Short, beside.</p></div></div></body>",
        f"<body><div class=widget>{ARTICLE}</div><p class=post-share>Share it.</p></body>",
        f"<body><div>{ARTICLE}</div><div class='x top-ad'>Buy, now.</div><div id=comment-12>I say, no.</div></body>",
        f"<body><p>One sentence, and one more. It goes on for a while, <span class=ad>buy</span>as articles do.</p><p>A second paragraph follows; it is long enough, too.</p></body>",
    ],
)
def test_words_in_names_of_the_text_hide_nothing(page):
    assert html.main_text(page) == TEXT


def test_words_in_names_of_sections():
    page = f"<body><div>{paragraphs('First', 6)}</div><section class=related-work>{paragraphs('Second', 4)}</section><div class=related-posts>{paragraphs('Third', 2)}</div></body>"
    assert html.main_text(page) == wanted("First", 6) + " " + wanted("Second", 4)
    page = f"<body><div>{paragraphs('First', 4)}</div><div class=comments>{paragraphs('Reader', 9)}</div></body>"
    assert html.main_text(page) == wanted("First", 4)


LONG = "A long paragraph, with much to say. " * 20


@pytest.mark.parametrize(
    "page,want",
    [
        # No text of the content goes because it is short.
        (f"<body><p>{LONG}</p><ul><li>Milk</li><li>Eggs</li></ul></body>", LONG + "Milk Eggs"),
        (f"<body><div><p>{LONG}</p><table><tr><td>1</td><td>kg</td></tr></table></div></body>", LONG + "1 kg"),
        (f"<body><div><p>{LONG}</p></div><ul><li><a href=a>Home</a></li><li><a href=b>More</a></li></ul></body>", LONG.strip()),
        # The header of an article is its own, that of the page is not.
        (f"<article><header><h1>The title</h1><p>By me</p><nav><h2>Menu</h2></nav></header><p>{LONG}</p></article>", "The title " + LONG.strip()),
        (f"<header><h1>Site</h1></header><article><p>{LONG}</p></article>", LONG.strip()),
        # An open select does not take the page.
        (f"<article><p>Choose <select><option>a<option>b<p>{LONG}</p></article>", "Choose " + LONG.strip()),
        ("<article><p>Choose <select><option>a</option></select> it, then.</p></article>", "Choose it, then."),
        # Quotes that nothing closes.
        (f"<article><p don't>one, two</p><p>{LONG}</p></article>", "one, two " + LONG.strip()),
        ("<article>" + "<p don't>one, two</p>" * 101 + "</article>", " ".join(["one, two"] * 101)),
        ("<p>text, and <!-- a > b", "text, and"),
        ("<p>2 < 3, and <b", "2 < 3, and <b"),
    ],
)
def test_whole_content(page, want):
    assert html.main_text(page) == want


def test_broken_markup_takes_linear_time():
    for page in ("<a '" * 50_000, "<" * 200_000, "<p>" * 50_000, "<!--" * 50_000, "<script>" * 20_000, "x" * 1_000_000, "</div>" * 50_000, "<a '" * 50_000 + "</p>"):
        html.main_text(page)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x", "y"), (1, "u", f"<article>{ARTICLE}</article>", "x", "y"), (None, None, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, TEXT, len(TEXT)), (1, TEXT, len(TEXT))]
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
