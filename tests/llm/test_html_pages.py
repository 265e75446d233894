"""Pages whose layout is not that of the test table."""

import pytest

WORDS = " ".join(f"word{i}" for i in range(60))
ARTICLE = f"<article><h1>Title here</h1><p>{WORDS}</p><p>More {WORDS}</p></article>"
TEXT = f"Title here\n{WORDS}\nMore {WORDS}"
PAGES = {
    "head without its end": (f"<html><head><title>T t</title><body><nav><a>m</a></nav>{ARTICLE}<footer>f</footer></body></html>", TEXT),
    "layout class": (f'<body><div class="layout has-sidebar"><aside>side</aside>{ARTICLE}</div></body>', TEXT),
    "state class": (f'<body><div class="share-enabled">{ARTICLE}</div></body>', TEXT),
    "marked wrapper": (f'<body><div class="search">{ARTICLE}</div></body>', TEXT),
    "form around all": (f"<body><form>{ARTICLE}<input></form></body>", TEXT),
    "form around all, no article": (f'<body><form id=aspnet><div class="header">top</div><div><p>{WORDS}</p></div><div class="footer">foot</div></form></body>', WORDS),
    "notice period": (f'<body><article><p>{WORDS}</p><p class="notice-period">Three months.</p></article></body>', f"{WORDS}\nThree months."),
    "menu without its end": (f"<body><nav><ul><li>one<li>two</ul>{ARTICLE}</body>", TEXT),
    "options without their ends": (f"<body><select><option>one<option>two</select>{ARTICLE}</body>", TEXT),
    "comments longer than the article": (f'<body><article><p>{WORDS}</p><section id="comments"><p>{WORDS} {WORDS} {WORDS}</p></section></article></body>', WORDS),
    "teaser in the sidebar": (f"<body>{ARTICLE}<aside><article class=teaser><p>tease me</p></article></aside></body>", TEXT),
    "headers": (f"<body><header><h1>Site</h1></header><article><header><h1>Real</h1></header><p>{WORDS}</p></article></body>", f"Real\n{WORDS}"),
    "adverts inside": (f'<body><article><p>{WORDS}</p><div class="ad-slot-3">Buy</div><p>the end</p><div class="google-ads">Buy</div></article></body>', f"{WORDS}\nthe end"),
    "advert paragraph without its end": (f'<body><article><p>{WORDS}<p class="ad">buy this<p>the end {WORDS}</article></body>', f"{WORDS}\nthe end {WORDS}"),
    "not shown": (f'<body><article><p>{WORDS}</p><p style="display: none">x y</p><p hidden>z</p></article></body>', WORDS),
    "references and space": (f"<body><article><p>{WORDS}  a&amp;b\n c&nbsp;d</p></article></body>", f"{WORDS} a&b c d"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    from marketloom.llm.html_extraction import extract

    page, text = PAGES[name]
    assert extract(page, {}) == text


def test_class_names_weigh():
    """A class that labelled pages have outside their content only takes its words out of the region."""
    from marketloom.llm.html_extraction import extract

    page = f'<body><div class="teaserblock"><p>{WORDS}</p></div><hr><div class="story"><p>{WORDS} end</p></div></body>'
    assert extract(page, {"c:teaserblock": -3.0, "t:hr": -5.0}) == f"{WORDS} end"


def test_empty_table(spark):
    from marketloom.llm.html_extraction import extract_pages, learn

    pages = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars int")
    assert learn(pages) == {} and extract_pages(pages, {}).count() == 0
    pages = spark.createDataFrame([(None, None, None, "x"), (1, "u", f"<article>{WORDS}</article>", "y"), (1, "u", f"<article>{WORDS}</article>", "y")], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in extract_pages(pages, learn(pages)).collect()) == [0, len(WORDS), len(WORDS)]
