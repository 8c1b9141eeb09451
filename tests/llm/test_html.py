"""HTML extraction: layout families that training never sees, nesting, unclosed elements, and odd rows."""

import random
import time

import pytest

from marlowe.llm import html

WORDS = "river stone quiet garden letter winter morning market bridge window silver paper coffee harbour story village music teacher evening summer".split()


@pytest.fixture(scope="module")
def model():
    return html.train()


def say(rng, low=8, high=30):
    return " ".join(rng.choices(WORDS, k=rng.randint(low, high))).capitalize() + "."


def parts(rng):
    return {"title": " ".join(rng.choices(WORDS, k=5)).capitalize(), "text": [say(rng) for _ in range(rng.randint(2, 9))], "side": [say(rng, 3, 14) for _ in range(3)], "menu": [w.capitalize() for w in rng.sample(WORDS, 5)]}


def p(texts, tag="p"):
    return "".join(f"<{tag}>{t}</{tag}>" for t in texts)


def links(names, tag="li"):
    return "".join(f'<{tag}><a href="/{n}">{n}</a></{tag}>' for n in names)


def weblog(x):
    return f"""<body class="home single with-sidebar"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">{x["side"][0]}</a></p></div>
    <nav id="site-navigation" class="main-navigation"><ul class="menu">{links(x["menu"])}</ul></nav></header><div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main">
    <article id="post-7" class="post type-post hentry"><header class="entry-header"><h1 class="entry-title">{x["title"]}</h1></header><div class="entry-content">{p(x["text"])}</div></article>
    <div id="comments" class="comments-area"><h2 class="comments-title">{x["side"][1]}</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><div class="comment-content">{p(x["side"])}</div></article></li></ol></div></main></div>
    <aside id="secondary" class="widget-area"><section class="widget"><h2 class="widget-title">{x["side"][2]}</h2><ul>{links(x["menu"])}</ul></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">{p(x["side"][:1])}</div></footer></div>"""


def magazine(x):
    half = len(x["text"]) // 2
    return f"""<body><div class="cookie-consent"><div><div><p>{x["side"][0]}</p><button>Accept</button></div></div></div><div class="layout-wrapper"><div class="top-nav"><div class="inner">{links(x["menu"], "span")}</div></div>
    <div class="story"><div><div><section><div class="grid"><h1>{x["title"]}</h1>{p(x["text"][:half])}<div class="ad-slot"><div><p>{x["side"][1]}</p></div></div>{p(x["text"][half:])}</div></section></div></div></div>
    <div class="related-posts"><h3>{x["side"][2]}</h3><div>{p(x["side"])}</div></div><div class="newsletter-signup"><form><h4>{x["side"][0]}</h4><label>Mail</label></form></div><div class="footer"><div><div>{p(x["side"])}</div></div></div></div>"""


def old_tables(x):
    return f"""<body><table width=100%><tr><td colspan=2 class=header><b>{x["side"][0]}</b></td></tr><tr><td class=sidebar><table>{"".join(f"<tr><td><a href=/>{m}</a></td></tr>" for m in x["menu"])}</table></td>
    <td><table><tr><td><h1>{x["title"]}</h1>{p(x["text"])}</td></tr></table></td></tr><tr><td class=footer>{x["side"][1]}</td></tr></table>"""


def manual(x):
    return f"""<body><header><a class="logo" href="/">{x["menu"][0]}</a><form role="search"><label>{x["menu"][1]}</label><input></form></header><div class="columns"><nav class="toc" role="navigation"><div><ul>{links(x["menu"])}</ul></div></nav>
    <main role="main"><section><h1>{x["title"]}</h1><section><h2>{x["menu"][2]} guide</h2>{p(x["text"][:1])}<section><ul>{p(x["text"][1:], "li")}</ul></section></section></section></main></div><footer role="contentinfo"><p>{x["side"][0]}</p></footer>"""


def plain(x):
    return f"<h1>{x['title']}</h1>" + "".join(f"<p>{t}\n" for t in x["text"])


def unnamed(x):
    return f"""<body><div><nav><ul>{links(x["menu"])}</ul></nav><div><div><div><div><div><div><div><div><h1>{x["title"]}</h1><div>{p(x["text"], "div")}</div></div></div></div></div></div></div></div></div><div><footer><div><div>{p(x["side"])}</div></div></footer></div></div>"""


def press(x):
    return f"""<body id=top><div class="banner" role="banner"><div>{x["side"][0]}</div></div><div role="navigation"><dl>{links(x["menu"], "dd")}</dl></div><div class="wrap"><div class="left"><div class="newsText"><div class="headline"><h2>{x["title"]}</h2></div>
    <div><blockquote><p>{x["text"][0]}</p></blockquote>{p(x["text"][1:])}</div><div class="socialShare"><ul>{links(x["menu"])}</ul></div></div></div><div class="right"><div class="popularWidget"><article><h4>{x["side"][1]}</h4><p>{x["side"][2]}</p></article></div></div></div>
    <section class="discussion"><h3>{x["menu"][3]}</h3><div><div><div>{p(x["side"])}</div></div></div></section><div class="sponsoredLinks"><p>{x["side"][0]}</p></div><div id="footerNav"><p>{x["side"][1]}</p></div>"""


def wanted(x, family):
    return "\n".join([x["title"], *([f"{x['menu'][2]} guide"] if family is manual else []), *x["text"]])


def test_held_out_layouts(model):
    for family in (weblog, magazine, old_tables, manual, plain, unnamed, press):
        rng, kept, got_all, want_all = random.Random(3), 0, 0, 0
        for _ in range(40):
            x = parts(rng)
            got, want = html.extract(family(x), model).split("\n"), wanted(x, family).split("\n")
            kept += sum(len(t) for t in want if t in got)
            got_all, want_all = got_all + sum(map(len, got)), want_all + sum(map(len, want))
        assert kept / got_all >= 0.98 and kept / want_all >= 0.98, (family.__name__, kept / got_all, kept / want_all)


TEXTS = ["Alpha beta gamma delta one two three, four five six.", "Second paragraph here with some words in it. And more.", "Third short one.", "Fifth."]
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>"
FOOT = "<footer>&copy; 2024 Some Company. All rights reserved.</footer>"


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("depth", [0, 1, 3, 6, 20, 60])
def test_wrappers_change_nothing(model, tag, depth):
    a, b = f"<{tag}>" * depth, f"</{tag}>" * depth
    body, want = "<h1>Title of it</h1>" + p(TEXTS), "\n".join(["Title of it", *TEXTS])
    for page in (
        f"{MENU}<article>{a}{body}{b}</article>{FOOT}",
        f"{MENU}<div class=article-body>{a}{body}{b}</div>{FOOT}",
        f"{MENU}<main><article><div class=row><div class=col>{a}{body}{b}</div></div></article></main>{FOOT}",
        f"{a}{body}{b}",
        f"<table><tr><td>{a}{body}{b}</td></tr></table>",
        f"{MENU}<article>{body}</article><div class=sidebar>{a}<h2>Related stories</h2><p>Something else to read.</p>{b}</div>{FOOT}",
        f"{a}<article>{body}<div class=comments>{a}<h1>Reader comments here</h1><p>What a fine text this is.</p>{b}</div></article>{b}{FOOT}",
    ):
        assert html.extract(f"<html><body>{page}</body></html>", model) == want


def test_unclosed_and_raw_elements(model):
    body, want = "<h1>Title of it</h1>" + p(TEXTS), "\n".join(["Title of it", *TEXTS])
    for tag in ("video", "canvas", "select", "noscript", "svg", "object", "audio", "math"):
        assert html.extract(f"{MENU}<article><{tag}>{body}</article>{FOOT}", model) == want, tag
        page = f"<article><h1>Title of it</h1><{tag}>inside</{tag}>{p(TEXTS)}</article>"
        assert ("inside" in html.extract(page, model)) == (tag in ("object", "math")), tag
    assert html.extract(f"<script src=http://x/>var a = 'Some code. And more.';</script><article>{body}</article>", model) == want
    assert html.extract(f"<article>{body}</article><svg/><script>var a='<p>no</p>'", model) == want
    assert [b.text for b in html.blocks("<math><mi>x</mi><mo>=</mo><mn>2</mn></math> so")] == ["x=2 so"]


def test_implied_end_tags():
    deep = "<div>" * 30
    assert [b.tag for b in html.blocks(f"<ul><li>{deep}a<li>b</ul>c")] == ["div", "li", ""]
    assert [(b.tag, b.above) for b in html.blocks("<table><tr><td>a<tr><td>b<td>c</table><p>d<div>e")][-1] == ("div", frozenset({"a:div"}))
    assert [b.tag for b in html.blocks("<ul><li>a<ul><li>b</ul>c<li>d")] == ["li", "li", "li", "li"]
    assert [b.tag for b in html.blocks("<dl><dt>a<dd>b<dt>c</dl>")] == ["dt", "dd", "dt"]
    assert [b.text for b in html.blocks("<p>a<button>b</button>c")] == ["a", "b", "c"]


def test_time_grows_with_the_page_only(model):
    began = time.time()
    for page in ("<div>" * 60_000 + "text", "<video>" * 60_000 + "text", "<div class=nav><li>x" * 20_000, "<p>a <b>b" * 60_000, "<table><tr><td>" * 20_000 + "t", "<" * 100_000, "<a b='" * 2_000):
        html.extract(page, model)
    assert time.time() - began < 60


def test_odd_rows(spark, model):
    rows = [(1, None, "u"), (2, "", None), (3, "<p>Just one plain paragraph.</p>", "u"), (3, "<p>Just one plain paragraph.</p>", "u"), (None, "<p>" + "word " * 50_000, "u"), (4, "<p", "u")]
    df = spark.createDataFrame(rows, "page_id BIGINT, html STRING, HTML2 STRING").selectExpr("*", "1 AS text", "2 AS n_chars")
    out = html.main_text(df, model)
    assert out.columns == [*df.columns, "main_text"]
    got = sorted((r["page_id"] or 0, r["main_text"]) for r in out.collect())
    assert got == [(0, ("word " * 50_000).strip()), (1, ""), (2, ""), (3, "Just one plain paragraph."), (3, "Just one plain paragraph."), (4, "")]
    assert html.main_text(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        html.main_text(df.selectExpr("*", "1 AS Main_Text"), model)
