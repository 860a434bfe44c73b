import random
import html
import re

from tallyloom.llm.html_extract import Template, article, deduce_templates, extract, judge_template, nested, occurrence_vectors, read_page
from tallyloom.llm.queries import QUERIES

from .conftest import SF

FURNISHED = """<!doctype html><html><head><title>no</title><script>if (a < b) "</p>"</script><style>p {}</style></head>
<body><header class="top"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li>menu</ul></nav>
<main><article><header><h1>Title &amp; more</h1></header><p>One<br>two &nbsp; <b>thr</b>ee &lt;x&gt;<!-- no -->
<div class="ad-slot ad">buy</div><p>Next<aside>related</aside><ul><li>i1<li>i2</ul><form>mail <input></form>
<pre>a  b</pre><section class="comments"><p>bad</p></section></article></main><div class="sidebar">s</div><footer>f</footer>"""


def page(k, kind):
    text = f"<h1>Head {k}</h1><p>Body {k} of the <i>page</i> with words {k * 7}.</p><p>Common line.</p>"
    if kind == "plain":  # no article element: the slot is found by the template alone
        return f'<html><body><div class="nav">n{k}</div><div class="top"><div class="menu">m</div></div><div class="wrap"><div class="c{k}">{text}<p>All have this.</p></div></div><div class="footer">f{k}</div></body></html>'
    return f"<html><body><nav>n{k}</nav><article>{text}</article><footer>f</footer></body></html>"


def test_one_page():
    assert article(FURNISHED, Template(("/html/body/main/article",))) == "Title & more\n\nOne two three <x>\n\nNext\n\ni1\n\ni2\n\na b"
    assert article("") == "" and article("no markup &amp; text") == "no markup & text"
    assert article("<article><p>cut <b>of") == "cut of"


def test_names_of_layouts_and_of_parts_of_an_article():
    body = "<h1>Head</h1><p>Some words of a text that is long enough.</p>"
    want = "Head\n\nSome words of a text that is long enough."
    menu = "<div class=menu><a href=/>home</a></div>"
    for wrapper in ("class='has-sidebar'", "class=no-sidebar", "class='page with-sidebar'", "class='content search-layout'", "id='main-widget'", "class=widget"):
        for inner in (f"<article>{body}</article>", f"<div>{body}</div>"):
            assert article(f"<body><div {wrapper}>{inner}</div></body>") == want
            if wrapper != "class=widget":
                assert article(f"<body>{menu}<div {wrapper}>{inner}</div><div class='sidebar'>s</div></body>") == want
    assert article(f"<main><div class=search-layout>{body}</div></main>") == want
    assert article("<article><div class=article-header><h1>Head</h1></div><p>Text</p><div class=post-legal>Law</div><div class=share-buttons>s</div></article>") == "Head\n\nText\n\nLaw"
    assert article("<div class=entry-header><h1>Head</h1></div><p>Text</p>") == "Head\n\nText"
    comments = "<section class=comments-area><article>" + "said long things " * 30 + "</article></section>"
    assert article(f"<article>{body}{comments}</article>") == want
    assert article(f"<body><article>{body}</article>{comments}</body>") == want


def test_inline_buttons_and_adverts():
    assert article("<p>One <button class=x>Buy <b>now</b></button>two <span class=ad>ad <span>in</span></span>three</p>") == "One two three"
    assert article("<p>One <button><div>Buy</div></button> two</p><p>a <span class='ad'>cut<p>Next") == "One\n\ntwo\n\na\n\nNext"


def test_template_of_a_host_without_articles(spark):
    rows = [(k, f"http://plain.example/{k}", page(k, "plain")) for k in range(8)] + [(100 + k, f"https://News.example/{k}", page(k, "news")) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: r for r in deduce_templates(occurrence_vectors(pages.select("page_id", "url", "html"))).collect()}
    assert found["plain.example"].roots == ["/html/body/div.wrap/div.c0"] and found["news.example"].roots == ["/html/body/article"]
    for limit in (32_000_000, -1):  # broadcast and join
        got = {r.page_id: r.text for r in extract(pages, broadcast_bytes=limit).collect()}
        assert got == {k + d: f"Head {k}\n\nBody {k} of the page with words {k * 7}." for k in range(8) for d in (0, 100)}


def test_all_slots_of_a_host_are_kept(spark):
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    kinds = {
        "wrapper": lambda k: f"<article><h1>Head {k}</h1><p>Lead {k}</p><div class=content><p>{long(k)}</p></div></article>",
        "one": lambda k: f"<main><article><h1>Head {k}</h1><p>Lead {k}. {long(k)}</p></article></main>",
        "beside": lambda k: f"<div><div class=intro><h1>Head {k}</h1>Lead {k}</div><div class=long>{long(k)}</div></div>",
        "parts": lambda k: f"<article class=a>Head {k}</article><article class=b>Lead {k} {long(k)}</article>",
        "teaser": lambda k: f"<div>Head {k} Lead {k} {long(k)}</div><article>Other</article>",
    }
    rows = [(k, f"http://{kind}.example/{k}", f"<html><body><nav>n{k}</nav>{make(k)}<footer>f</footer></body></html>") for kind, make in kinds.items() for k in range(8)]
    for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id
        assert [x in r.text for x in (f"Head {k}", f"Lead {k}", long(k), f"n{k}\n")] == [True, True, True, False], r.url


def hosts():
    """Pages of hosts whose tags and names mislead, and the text each should give."""
    body = lambda k: [f"Body {k} begins here, {'and goes on ' * (k % 3)}and ends.", f"Second part of page {k} with {k * 11} words."]
    ps = lambda k: "".join(f"<p>{t}</p>" for t in body(k))
    menu = lambda n: "".join(f"<li><a href=/{i}>Entry number {i} of {n}</a></li>" for i in range(12))
    kinds = {
        # the post is called like a share bar, and the header varies
        "social": lambda k: (f"<div class=header>t{k}</div><div class=post><div class=social-history>{ps(k)}</div></div>", body(k)),
        # all of the site is one form, as some frameworks have it
        "form": lambda k: (f"<form><div class=x1><ul>{menu(9)}</ul></div><div class=x2><h1>Head {k}</h1>{ps(k)}</div></form>", [f"Head {k}", *body(k)]),
        # menus without a telling tag or name, other links on each page
        "links": lambda k: (f"<div class=q1><ul>{menu(k)}</ul></div><div class=q2><h1><a href=/{k}>Head {k}</a></h1>{ps(k)}</div>", [f"Head {k}", *body(k)]),
        # the text stands in an aside
        "aside": lambda k: (f"<div class=q1>{'' if k % 2 else 'x'}</div><aside><h2>Head {k}</h2>{ps(k)}{ps(k + 100)}</aside>", [f"Head {k}", *body(k), *body(k + 100)]),
    }
    rows, want = [], {}
    for host, make in kinds.items():
        for k in range(8):
            html, text = make(k)
            rows.append((len(rows), f"http://{host}.example/{k}", f"<html><body>{html}</body></html>"))
            want[len(rows) - 1] = text
    # a page of few words: alone, the names would win; its host's template says what is what
    rows.append((len(rows), "http://social.example/short", "<html><body><div class=header>A header that is longer than the post</div><div class=post><div class=social-history><p>Short.</p></div></div></body></html>"))
    want[len(rows) - 1] = ["Short."]
    return rows, want


def test_misleading_tags_and_names_and_what_the_template_is_for(spark):
    rows, want = hosts()
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, url, _ in rows:
        lines = [x for x in got[k].split("\n\n") if x != "x"]
        assert lines == want[k], url
    without = {k: article(source) for k, _, source in rows}
    for host in ("social", "form", "links", "aside"):
        assert any(without[k] != got[k] for k, url, _ in rows if f"//{host}." in url), host


def test_classes_against_brute_force(spark):
    """Tokens with equal vectors of counts over the pages of a host, computed pair by pair."""
    rows = [(k, "http://a.example/", page(k, "plain") + ("<div id=extra><p class=q>more</p></div>" if k % 2 else "")) for k in range(6)]
    counts = {}
    for k, (_, _, source) in enumerate(rows):
        for path, e in read_page(source).elements().items():
            counts.setdefault(path, [0] * len(rows))[k] = e[0]
    found = [r for r in occurrence_vectors(spark.createDataFrame(rows, "page_id long, url string, html string")).where("host = 'a.example' and element <> ''").collect()]
    assert {r.element for r in found} == set(counts)
    for r in found:
        assert (r.pages, r.uses) == (sum(map(bool, counts[r.element])), sum(counts[r.element]))
        for s in found:
            assert ((r.low, r.high, r.pages) == (s.low, s.high, s.pages)) == (counts[r.element] == counts[s.element])


def test_nesting():
    tree = nested({"/h": 0, "/h/b": 0, "/h/b/d/x": 1, "/h/b/d/x/p": 1, "/h/b/y": 2, "/h/b/d/x/p/z": 2})
    assert tree == {"/h": "", "/h/b": "/h", "/h/b/d/x": "/h/b", "/h/b/d/x/p": "/h/b/d/x"}  # class 2 lies in two slots
    roots, out, spared = judge_template({"/h": (0, 100, 0, 9, 0), "/h/n": (0, 20, 0, 1, 2), "/h/m": (0, 80, 0, 8, 2)}, 1, 100)
    assert (roots, out, spared) == (["/h/m"], ["/h/n"], ["/h/m"])


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://[broken", ""), (3, "x", "<p>only</p>"), (3, "x", "<p>only</p>"), (None, "http://a.b/", "<article>" + "<p>long text</p>" * 5000)]
    got = sorted(map(tuple, extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")).collect()), key=repr)
    assert [(r[0], r[2], r[3]) for r in got if r[0] is not None] == [(1, "", 0), (2, "", 0), (3, "only", 4), (3, "only", 4)]
    assert [r[3] for r in got if r[0] is None] == [5000 * 11 - 2]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_against_the_articles(spark, small):
    truth = {}
    for r in small("pages").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?[ab]\b[^>]*>|<!--.*?-->", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", inner)]
        truth[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = QUERIES["op6_html_extraction"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == truth
    assert all(r.n_chars == len(r.text) for r in got)


def test_hosts_of_any_size_give_the_same_article(spark):
    """A menu in one run, a footer line and the story, without telling tags or names, on hosts of 2 to 8 pages."""
    rng, rows, want = random.Random(6), [], {}
    for n in range(2, 9):
        cls = [f"q{rng.randrange(10**6)}" for _ in range(4)]
        for k in range(n):
            story = [f"Story {n} {k} part {j} " + " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(30)) for j in range(3)]
            menu = "".join(f'<a href="/{x}">{x}</a> ' for x in ("home", "news", "sport"))
            body = "".join(f"<p>{x}</p>" for x in story)
            rows.append((len(rows), f"http://h{n}.example/{k}", f'<html><body><div class="{cls[0]}">{menu}</div><div class="{cls[1]}">{body}</div><div class="{cls[2]}">All rights of house {n}</div></body></html>'))
            want[len(rows) - 1] = "\n\n".join(story)
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
