import html
import math
import random
import re
import time

import pytest

from tallyspark.llm.html_text import main_text, parse, weigh
from tallyspark.llm.queries import op5_html_extraction

SF = "/root/testdata/sf0.001"
PROSE = "A sentence of fair length that stands in the article, with words enough to weigh something. " * 3


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


NAV = "<nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav>"
CASES = {
    "plain article": (page(f"{NAV}<article><h1>Title</h1><p>{PROSE}</p><p>Two &amp; three &#233;</p></article><footer>&copy; x</footer>"), ["Title", PROSE.strip(), "Two & three é"]),
    "no semantic elements": (page(f"<div id=top><a href=/>Home</a> <a href=/y>News</a></div><div class=content><p>{PROSE}</p><p>{PROSE}</p></div><div class='site-footer'>(c)</div>"), [PROSE.strip(), PROSE.strip()]),
    "comments leave": (page(f"<main><h1>H</h1><p>{PROSE}</p></main><section id=comments><article class=comment><p>{PROSE} I disagree.</p></article></section>"), ["H", PROSE.strip()]),
    "comments inside the article leave": (page(f"<article><p>{PROSE}</p><div class='comment-list'><p>{PROSE} no</p></div></article>"), [PROSE.strip()]),
    "notices, adverts, forms": (page(f"<div class='cookie-notice'>We use cookies</div><article><p>{PROSE}</p><div class=ad>Buy</div><form><label>Mail</label><input></form><p>End</p></article><aside>Side</aside>"), [PROSE.strip(), "End"]),
    "unclosed elements": (page(f"{NAV}<article><h1>T</h1><p><b>{PROSE}<br><p>Second<li>x"), ["T", PROSE.strip(), "Second", "x"]),
    "scripts and comments": (page(f"<article><script>var a='<p>no</p>';</script><!-- <p>no</p> --><p>{PROSE}</p><style>p{{}}</style></article>"), [PROSE.strip()]),
    "inline elements": (page("<article><p>a<b>b</b> c <a href=x>d</a>\n\te<br>f</p></article>"), ["ab c d e f"]),
    "short article, long menu": (page(f"<nav>{'<a href=x>Menu entry</a> ' * 40}</nav><article><p>Hi.</p></article><footer>{PROSE}</footer>"), ["Hi."]),
    "cut page": (f"<html><body>{NAV}<article><h1>T</h1><p>{PROSE}", ["T", PROSE.strip()]),
    "wrapper with a telling name": (page(f"<div class='page with-sidebar'><div><p>{PROSE}</p><p>{PROSE}</p></div><div class=sidebar><p>links</p></div></div>"), [PROSE.strip()] * 2),
    "no text": (page(NAV), []), "empty article": (page(f"{NAV}<article></article>"), []), "no markup": ("just text", ["just text"]), "empty": ("", []), "null": (None, []),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    source, want = CASES[name]
    assert main_text(source).split("\n\n") == (want or [""])


def test_long_pages_are_read_whole():
    source = page("<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>")
    assert main_text(source) == "\n\n".join([PROSE.strip()] * 5000)
    assert main_text("<div>" * 20000 + "deep") == "deep"


@pytest.mark.parametrize("opened", ["<div>", "<li>", "<div><li>", "<ul><li>", "<div></span></p>", "<td>", "<form>", "<article><header>", "<div><article>"])
def test_deep_pages_take_linear_time(opened):
    """20,000 open elements and as many stray ends; with a walk along the path for each it takes minutes."""
    began = time.process_time()
    main_text(opened * 20000 + "deep" + "</div></li></em></section>" * 20000)
    assert time.process_time() - began < 10


def test_query_takes_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op5_html_extraction(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        inner = re.sub(r"</?b>", "", inner.replace("<br>", " "))
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("<[^>]+>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("script", ["for(var i=0;i<n;i++){f(i)}", "if(a<b)c='it\\'s'", "x=\"<p title='\"", "var s='</p>',t='<div'", "<!-- if (a<b) -->"])
def test_scripts_end_at_their_end_tag(script):
    want = "\n\n".join([PROSE.strip()] * 2)
    assert main_text(page(f"<script>{script}</script><article><p>{PROSE}</p><SCRIPT>{script}</Script ><p>{PROSE}</p></article>")) == want
    assert main_text(page(f"<article><p>{PROSE}</p></article><script>{script}")) == PROSE.strip()


FIVE = f"<p>{PROSE}</p>" * 5
WHOLE = {
    "two containers": (f"<div>{FIVE}</div><div>{FIVE}</div>", [PROSE.strip()] * 10),
    "two containers of unequal prose": (f"<div>{FIVE}</div><div><p>{PROSE[:90]}</p><p>Some words more.</p></div>", [PROSE.strip()] * 5 + [PROSE[:90].strip(), "Some words more."]),
    "an apostrophe in a tag": (f"<article><p title=don't>{PROSE}</p><p>second</p></article>", [PROSE.strip(), "second"]),
    "a quote that nothing closes": (f"<article><p title='{PROSE}>first</p><p title = \"a > b\">second</p><p a=\"x>third</p></article>", ["first", "second", "third"]),
    "names inside other attributes": (f"<article><div data-class=ad title='id=menu'>{FIVE}</div></article>", [PROSE.strip()] * 5),
    "two articles": (f"<article>{FIVE}</article><div><article><p>Short.</p></article></div>", [PROSE.strip()] * 5 + ["Short."]),
    "heading and lead beside the container": (f"<h1>Title</h1><p>{PROSE}</p><div>{FIVE}</div>", ["Title", *[PROSE.strip()] * 6]),
    "prose beside a short article": (f"<article><p>Short.</p></article><div>{FIVE}</div>", ["Short.", *[PROSE.strip()] * 5]),
    "prose before a teaser": (f"<div>{FIVE * 2}</div><div class=teasers><article>A teaser.</article></div>", [PROSE.strip()] * 10 + ["A teaser."]),
    "a thread longer than the article": (f"<article><h1>H</h1><p>{PROSE}</p></article><div id=comments>{FIVE * 4}</div>", ["H", PROSE.strip()]),
    "a thread longer than its article, inside": (f"<article><p>{PROSE}</p><section class='post-comments'>{FIVE * 4}</section></article>", [PROSE.strip()]),
    "a thread without an article": (f"<div><h1>H</h1><p>{PROSE}</p></div><div class='comment-list'>{FIVE * 4}</div>", ["H", PROSE.strip()]),
    "a long sidebar": (f"<div>{FIVE}</div><div class='sidebar left'>{FIVE * 3}</div>", [PROSE.strip()] * 5),
    "a long sidebar beside an article": (f"<article>{FIVE}</article><div id=main-sidebar>{FIVE * 3}</div>", [PROSE.strip()] * 5),
    "a form around the page": (f"<form action=/><input type=hidden><div id=header>Site</div><div><h1>H</h1>{FIVE}</div><div class=footer>f</div></form>", ["H", *[PROSE.strip()] * 5]),
    "a form around the paragraphs": (f"<form><div>{FIVE}</div><input></form>", [PROSE.strip()] * 5),
    "a form with an article": (f"<form><article>{FIVE}</article></form>", [PROSE.strip()] * 5),
    "an article's own header": (f"<header>Site</header><article><header><h1>Title</h1></header>{FIVE}<footer>by me</footer></article>", ["Title", *[PROSE.strip()] * 5]),
    "an article's header without a heading": (f"<article><header><a href=/>Share</a></header>{FIVE}</article>", [PROSE.strip()] * 5),
    "a discussion is the page": (f"<div class=discussion><div>{FIVE}</div></div>", [PROSE.strip()] * 5),
    "article teasers in an aside": (f"<main>{FIVE}</main><aside><article><p>{PROSE}</p></article></aside>", [PROSE.strip()] * 5),
}


@pytest.mark.parametrize("name", WHOLE)
def test_all_main_text_is_kept(name):
    body, want = WHOLE[name]
    assert main_text(page(NAV + body)).split("\n\n") == want


@pytest.mark.parametrize("name", ["post-body share-enabled", "widget-content", "related-story", "search-page", "with-sidebar", "comments-open", "discussion"])
def test_names_of_wrappers_take_no_main_text(name):
    want = "\n\n".join([PROSE.strip()] * 5)
    assert main_text(page(f"{NAV}<article><div class='{name}'>{FIVE}</div></article>")) == want
    assert main_text(page(f"{NAV}<div id='{name}'><div>{FIVE}</div></div>")) == want
    assert main_text(page(f"<article><div class='{name}'>{FIVE}<div class=share>Share</div><div class=comments>I disagree</div></div></article>")) == want


def unmarked(source, menus):
    """A page whose elements no longer say what they are."""
    source = re.sub(r"\s(?:class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]*)", "", source, flags=re.I)
    return re.sub(rf"<(/?)(article|main{menus})\b", r"<\1div", source, flags=re.I)


def test_density_finds_the_text_without_markers(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [main_text(p) for p in pages]
    same = lambda menus: sum(main_text(unmarked(p, menus)) == w for p, w in zip(pages, want)) / len(pages)
    assert same("") >= 0.99 and same("|nav|header|footer|aside") >= 0.9
    found = [set(main_text(unmarked(p, "|nav|header|footer|aside")).split("\n\n")) for p in pages]
    assert all(set(w.split("\n\n")) <= f for w, f in zip(want, found) if w)


def slow_counts(node, links=0):
    """(characters, tags, link characters, link tags) of a subtree of (tag, children and texts)."""
    total = [0, 0, 0, 0]
    for part in node[1]:
        if isinstance(part, str):
            n = len("".join(part.split()))
            total[0] += n
            total[2] += n if links else 0
        else:
            inside = slow_counts(part, links + (part[0] == "a"))
            total = [a + b for a, b in zip(total, inside)]
            total[1] += 1
            total[3] += part[0] == "a"
    return total


def slow_density(node, body):
    c, t, lc, lt = slow_counts(node)
    if not c:
        return 0.0
    base = math.log(c * max(lc, 1) / max(c - lc, 1) + body[2] / max(body[0], 1) * c + math.e)
    return c / max(t, 1) * max(math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)), 0) / max(math.log(base), 0.1)


@pytest.mark.parametrize("seed", range(40))
def test_densities_equal_a_slow_computation(seed):
    r = random.Random(seed)

    def tree(depth):
        parts = []
        for _ in range(r.randrange(1, 5)):
            kind = r.random()
            parts.append(tree(depth - 1) if kind < 0.6 and depth else ("a", ["link " * r.randrange(1, 4)]) if kind < 0.75 else "some words " * r.randrange(1, 20))
        return ("div", parts)

    def source(node):
        return f"<{node[0]}>" + "".join(p if isinstance(p, str) else source(p) for p in node[1]) + f"</{node[0]}>"

    made = ("body", [tree(4)])
    nodes = weigh(parse("".join(source(p) for p in made[1])))
    body, queue = slow_counts(made), [made]
    for node in queue:
        queue += [p for p in node[1] if not isinstance(p, str) and p[0] != "a"]
    assert len(queue) == len(nodes)
    for slow, node in zip(queue, nodes):
        assert node.density == pytest.approx(slow_density(slow, body))
        assert node.sum == pytest.approx(sum(slow_density(p, body) for p in slow[1] if not isinstance(p, str) and p[0] != "a"))
