"""Main text of pages whose article is known by construction."""
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marketgrid.llm.html_extract import extract, main_texts

P = ["First, a paragraph with commas, some of them, and words enough to score well.",
     "Second paragraph, of the same length and make, that also belongs to the article text.",
     "Third one: it is plain, and long enough to be counted as a paragraph of prose as well."]
SHORT = "Short."
ARTICLE = "".join(f"<p>{p}</p>" for p in [*P, SHORT])
TEXT = "\n\n".join([*P, SHORT])
LINKS = "<ul>" + "".join(f'<li><a href="/{k}">Link number {k}, with a rather long title text</a></li>' for k in range(9)) + "</ul>"
COMMENTS = "".join(f"<p>Comment {k}, which is long, has commas, and would score like prose if it were not a comment.</p>" for k in range(5))

PAGES = {
    "article": f"<nav>{LINKS}</nav><article>{ARTICLE}</article><footer>&copy; x, y, and a long line of legal text here.</footer>",
    "divs": f"<div class=menu>{LINKS}</div><div><div>{ARTICLE}</div></div><div class='sidebar'><p>{P[0]}</p></div>",
    "named": f"<div id=content>{ARTICLE}</div><div id='comments'>{COMMENTS}</div><div>{LINKS}</div>",
    "unclosed": f"<header><p>{P[1]}</p></header><main>" + "".join(f"<p>{p}" for p in [*P, SHORT]) + "</main><aside><p>" + P[0],
    "forms": f"<article>{ARTICLE}<form><p>{P[0]}</p><select><option>{P[0]}</select></form><div class='share-buttons'>{P[1]}</div></article>",
    "scripts": f"<script>if (a<b) '<p>{P[0]}</p>'</script><style>p>a{{}}</style><article>{ARTICLE}<script>x</SCRIPT ><noscript><p>{P[0]}</p></noscript></article>",
    "notice": f"<div role=dialog><p>{P[0]}</p></div><div class='cookie-notice'>{COMMENTS}</div><div style='display: none'>{COMMENTS}</div><article>{ARTICLE}</article>",
    "sections": f"<article><section>{ARTICLE[:len(P[0]) + 7]}</section><section>{ARTICLE[len(P[0]) + 7:]}</section></article>",
    "comment in article": f"<article>{ARTICLE}<section class='comments'>{COMMENTS}</section></article>{COMMENTS[:0]}",
    "upper": f"<BODY><ARTICLE>{ARTICLE.replace('<p>', '<P>')}</ARTICLE></BODY>",
}


@pytest.mark.parametrize("name", PAGES)
def test_article_alone(name):
    assert extract(f"<!DOCTYPE html><html><head><title>{P[0]}</title></head><body>{PAGES[name]}</body></html>") == TEXT


def test_headings_lists_entities():
    html = ("<article><header><h1>A &amp; B</h1></header><p>x&nbsp;y &lt;b&gt; &#233;&#x41; &bogus; &am"
            f"</p><ul><li>one</li><li>two<ul><li>three</ul></ul><p>{P[0]} <b>bold</b>,\n <a href=x>linked</a><br>next\t line</p></article>")
    assert extract(html) == f"A & B\n\nx y <b> éA &bogus; &am\n\none\n\ntwo\n\nthree\n\n{P[0]} bold, linked next line"


def test_odd_pages():
    assert extract(None) == extract("") == extract("<html><body></body></html>") == extract("<nav>x</nav>") == ""
    assert extract("just text, no tags") == "just text, no tags"
    assert extract("<p>a < b and c > d <") == "a < b and c > d <"
    assert extract("<article><p>cut off in a tag <a href='x") == "cut off in a tag"
    assert extract("<!-- never closed <p>x</p>") == ""
    deep = "<div>" * 20_000 + ARTICLE
    assert extract(deep) == TEXT
    wide = "<article>" + "<p>word</p>" * 30_000 + "</article>"
    assert extract(wide).count("word") == 30_000


def test_main_texts(spark):
    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType()),
                         StructField("text", StringType()), StructField("n_chars", StringType())])
    rows = [(1, "u", PAGES["article"], "t", "n"), (1, "u", PAGES["article"], "t", "n"), (2, None, None, None, None), (None, "v", "", "x", "x")]
    got = main_texts(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted(
        [(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "v", "", 0)], key=str)
    assert main_texts(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "comments-open", "post-with-widgets", "search-results",
                                  "sidebar content", "widgets", "notice", "top-story"])
def test_names_around_the_article(name):
    for kind in ("article", "div"):
        assert extract(f"<body><nav>{LINKS}</nav><div class='{name}'><{kind}>{ARTICLE}</{kind}></div></body>") == TEXT


@pytest.mark.parametrize("name", ["tags", "notice", "related", "form", "share"])
def test_prose_with_such_a_name_in_the_article(name):
    html = f"<article>{ARTICLE}<div class='{name}'><p>{P[0]}</p></div><div class='{name}'>{LINKS}</div><div class='ad'><p>{P[1]}</p></div></article>"
    assert extract(html) == f"{TEXT}\n\n{P[0]}"


def test_marked_beside_the_article():
    """Comments and sidebars go, also if they hold articles of their own."""
    posts = "".join(f"<article class=comment>{c}</article>" for c in (COMMENTS, ARTICLE))
    assert extract(f"<main><article>{ARTICLE}</article><section class='comments'>{posts}</section>"
                   f"<div class='sidebar'><article><p>{P[1]}</p></article></div></main>") == TEXT


def test_captions_formulas_drawings():
    html = (f"<article><p>{P[0]}</p><figure><img src=x><figcaption>A caption.</figcaption></figure>"
            "<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><svg><text>axis</text><text>label</text></svg></article>")
    assert extract(html) == f"{P[0]}\n\nA caption.\n\nSo x=1.\n\naxis label"


def test_short_article_beside_long_others():
    advert = f"<div class='ad'>{P[0]}</div>"
    assert extract(f"{advert}<article><h1>Title</h1><p>{SHORT}</p>{advert}</article>") == f"Title\n\n{SHORT}"
    assert extract(f"<div class='sidebar'><article>{ARTICLE}</article></div><article><p>{SHORT}</p></article>") == SHORT


@pytest.mark.parametrize("kind", ["div class=sec", "section", "div"])
@pytest.mark.parametrize("around", ["<div class=wrap>{}</div>", "<div><div>{}</div></div>", "{}"])
def test_sections_without_an_article_element(kind, around):
    """Every section of a page without article or main comes out, with its heading and what stands between."""
    body = "".join(f"<{kind}><h2>Part {k}</h2><div class=txt><p>{p}</p></div></{kind.split()[0]}>" + "<ul><li>An item</ul>" * (k == 1)
                   for k, p in enumerate(P))
    want = f"Part 0\n\n{P[0]}\n\nPart 1\n\n{P[1]}\n\nAn item\n\nPart 2\n\n{P[2]}"
    page = f"<body><div>{LINKS}</div>{around.format(body)}<div>{LINKS}</div><div class='comments'>{COMMENTS}</div></body>"
    assert extract(page) == want


def test_sections_of_uneven_length():
    long = "".join(f"<p>{p}</p>" for p in P * 4)
    short = f"<p>{P[1]}</p>"
    sections = [short, long, short]
    page = "<div id=wrap>" + "".join(f"<div class=sec><h3>H{k}</h3><div>{s}</div></div>" for k, s in enumerate(sections)) + "</div>"
    got = extract(f"<body>{page}<div><div><p>A short line, of legal text.</p></div></div></body>")
    assert got == "\n\n".join(["H0", P[1], "H1", *P * 4, "H2", P[1]])


@pytest.mark.parametrize("name", ["post", "blog-post", "entry", "post-12", "story full"])
@pytest.mark.parametrize("header", ["<header>", "<header class=entry-header>", "<header class='post-header'>"])
def test_header_of_a_post(name, header):
    """The title in a post's own header stays, the page's header goes."""
    page = f"<header><h1>Site</h1></header><div class='{name}'>{header}<h1>Title</h1></header>{ARTICLE}</div><div class=menu>{LINKS}</div>"
    assert extract(f"<body>{page}</body>") == f"Title\n\n{TEXT}"


def test_header_of_a_page_goes():
    assert extract(f"<body class=single-post><div id=page><header><h1>Site</h1></header><div>{ARTICLE}</div></div></body>") == TEXT
