import html as H
import re
import time

from seqspark.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site name</header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy &amp; pay.</div><div id="cookie-notice">We use cookies, a lot of them, every day of the year.</div>
<article><h1>Head &amp; tail</h1><p>One  <b>two</b><br>three.<p>Ok.</p><aside>See also</aside><div class="advert"><div>x</div>y</div>
<ul><li>item <a href="#">link</a></li></ul></article>
<section class="comments"><p>Nice post, thank you for it, I liked the second part very much.</p></section>
<form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""


def test_article_between_boilerplate():
    assert main_text(PAGE) == "Head & tail\n\nOne two three.\n\nOk.\n\nitem link"


def test_without_article_takes_the_surge():
    body = "<div><p>%s</p><p>%s</p><p>Ok.</p></div>" % ("long text here " * 9, "more text " * 9)
    got = main_text("<body><div class='menu'><a>a</a></div>" + body + "<div class=footer>c</div></body>")
    assert got.startswith("long text here") and got.endswith("Ok.") and "menu" not in got


def test_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<article><p>cut &am"), (6, "u", '<article><p title="a>b</p>')]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = [(r.page_id, r.text, r.n_chars) for r in got.collect()]
    assert out[:5] == [(1, "", 0), (2, "", 0), (3, "", 0), (4, "plain", 5), (4, "plain", 5)]
    assert out[5] == (5, "cut &am", 7)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_given_pages_against_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert [k for k in want if want[k] != got[k]] == []


def test_adverts_and_link_lists_do_not_cut_the_text():
    assert main_text("<body><div><p>A</p><div class=ad>x</div><p>longer B</p></div></body>") == "A\n\nlonger B"
    assert main_text("<p>A</p><div class=ad>x</div><p>longer B</p>") == "A\n\nlonger B"
    links = "".join(f"<li><a href=#>link {k}</a></li>" for k in range(6))
    whole = "\n\n".join(["long text " * 8 + "end", *(f"link {k}" for k in range(6)), "after"])
    for name in ("article", "div"):
        assert main_text(f"<div><a>home</a></div><{name}><p>{'long text ' * 8}end</p><ul>{links}</ul><p>after</p></{name}>").endswith(whole)
    menu = "".join(f"<div><a href=#>go {k}</a></div>" for k in range(9))
    assert main_text(f"<div>{menu}</div><nav>n</nav><div><p>{'long text ' * 8}end</p></div>") == "long text " * 8 + "end"


def test_nothing_inside_an_article_is_lost():
    prose = "some words of an article that go on for a while, without any link at all, to the end of the line"
    for name in ("article-header", "map share", "side-effects", "form-follows-function"):
        assert main_text(f"<article><p>{prose} 1</p><div class='{name}'><p>Short.</p></div><p>{prose} 2</p></article>") == f"{prose} 1\n\nShort.\n\n{prose} 2"
        assert main_text(f"<div><p>{prose} 1</p><div class='{name}'><p>{prose}</p></div></div>") == f"{prose} 1\n\n{prose}"
    share = "<div class=share><a href=#>Mail it</a> <a href=#>Post it</a></div>"
    assert main_text(f"<article><header><h1>Head</h1></header><p>{prose}</p>{share}<p>End</p></article>") == f"Head\n\n{prose}\n\nEnd"
    assert main_text(f"<main><p>{prose}</p></main><nav><a>x</a></nav><main><p>two</p></main>") == f"{prose}\n\ntwo"
    aside = f"<p>{prose} 1</p><aside><p>See this.</p></aside><p>{prose} 2</p>"
    for page in (f"<article>{aside}</article>", f"<div>{aside}</div>", f"<body>{aside}</body>"):
        assert main_text(page) == f"{prose} 1\n\n{prose} 2"
    links = "".join(f"<p><a href=#>link {k}</a></p>" for k in range(4))
    assert main_text(f"<article><p>{prose}</p>{links}<p>End</p></article>") == "\n\n".join([prose, *(f"link {k}" for k in range(4)), "End"])


def test_unclosed_boilerplate_ends_with_its_parent():
    assert main_text("<div><div><span class=ad>buy<span>x</span></div><p>Text</p></div>") == "Text"
    assert main_text("<div><p class=ad>buy<p>Text</p></div>") == "Text"
    assert main_text("<div class=ad><div>buy</div> now</div><p>Text</p>") == "Text"


def test_time_grows_with_the_length_alone():
    def seconds(n):
        pages = ["<p>a<span>" * n + "</p></b>" * n, "<div>x" * n + "</ul></p>" * n, "<span class=ad>" * n + "</p>" * n, "<p class=share>x" * n, "<div class=share>x" * n, "<a <b x='" * n]
        start = time.process_time()
        for page in pages:
            main_text(page)
        return time.process_time() - start

    seconds(1000)
    assert seconds(16000) < 12 * max(seconds(4000), 0.05)


def test_other_columns_pass(spark):
    rows = spark.createDataFrame([(1, "<p>one " + "word " * 200_000 + "</p>", "old", {"k": 1}, 7)], "page_id long, html string, text string, tags map<string,int>, lines int")
    got = extract(rows).collect()[0]
    assert got.page_id == 1 and got.tags == {"k": 1} and got.lines == 7 and got.n_chars == len(got.text) == 1_000_003
