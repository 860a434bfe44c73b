"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: its block elements, each named by its path of tags, classes and ids,
and its text runs, named by path and text.  Tokens whose occurrence vectors over the pages of a
host are equal form an equivalence class.  A vector is known by its support and by sums of
hashes of (page, count), so classes come out of one map-side combined aggregation and a hot
host is never gathered in one place.

A class is valid if it is frequent enough, its elements occur once on a page, and all of them
lie in one slot of the classes around it.  Paths nest, so the elements of the valid classes form a
tree, the template, and what lies between them is slots.  The template is judged with the sums of all
of a host's pages: an element with most of the text is no furniture whatever its tag or class is
called, one of short links is furniture whatever it is called, and only for the others tags and names
decide.  The slots are what is left below the deepest element that leaves no text outside (article
and main elements come before it where they hold most of the text).  Template text, and below
the template what a page's own elements say is a menu, an advert, a form or comments, goes.

Templates are small (bounded by the tokens that a fixed share of a host's pages have); they are
broadcast below a checked size and joined by host beyond it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|object|canvas|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
# Elements that begin and end a block, those without content, and marks of page furniture.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACES = {"br", "hr", "img", "wbr", "input"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ENDS_P = BLOCKS - {"p", "body", "html", "head"}
FURNITURE_TAGS = set("nav footer aside form head menu dialog button".split())
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side-bar|aside|widget|widgets|footer|footnav|header|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|comments?|commentlist|replies|reply|respond|disqus|pagination|pager|skip|copyright|legal|disclaimer|hidden|sr-only)(?=$|[\s_-])",
    re.I,
)
# Words that name parts of an article as well, names that say what a page has or lacks, and words that never name a layout.
PARTS = set("header masthead legal disclaimer notice notices alert copyright".split())
ARTICLE_WORDS = set("article entry post story content".split())
STATES = re.compile(r"(?:has|no|with|without)[_-]", re.I)
REPLIES = set("comment comments commentlist replies reply respond disqus".split())
ADVERTS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?)(?=$|[\s_-])", re.I)
#: Pages of a host from which on it has a template.
LEAST_PAGES = 2
MARKED = re.compile(r"/(?:article|main)(?:\.[^/]*)?(?=/|$)")
SUMS = ["pages", "uses", "low", "high", "chars", "links", "anchors"]
FIELDS = "host string, token long, element string, evidence long, " + ", ".join(f"{c} long" for c in SUMS)
#: What an element's tag, role or style says, beside the degrees of ``_doubt``.
SURE = 4


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _furniture(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Tag, role or style make it furniture, with all it holds."""
    if tag in FURNITURE_TAGS or attrs.get("role", "").lower() in FURNITURE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if tag == "header" and not inside_article:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I))


@lru_cache(100_000)
def _doubt(names: str, inside_article: bool) -> int:
    """What class and id say: 0 no furniture, 1 a name with such a word in it, 2 a name of such words, 3 comments."""
    most = 0
    for name in names.lower().split():
        words = re.split("[_-]", name)
        found = [] if STATES.match(name) else [m[0].strip("_-") for m in FURNITURE.finditer(name)]
        if inside_article or ARTICLE_WORDS.intersection(words):
            found = [w for w in found if w not in PARTS]
        if found:
            most = max(most, 3 if REPLIES.intersection(found) else 2 if sum(1 + w.count("-") for w in found) == len(words) else 1)
    return most


@dataclass
class Page:
    """A page's runs of text as (element, text, characters in links), and by element, in page order after a root 0:
    the element around it, its path, what its tag and names say by themselves, whether it is article or main, and how
    many links begin in it."""

    runs: list[tuple[int, str, int]]
    around: list[int]
    paths: list[str]
    evidence: list[int]
    marked: list[bool]
    anchors: list[int]

    def below(self, own: list[int]) -> list[int]:
        """Sums over each element and all below it."""
        out = own[:]
        for k in range(len(out) - 1, 0, -1):
            out[self.around[k]] += out[k]
        return out

    def elements(self) -> dict[str, list[int]]:
        """By path: uses, characters below, those in links, links below, evidence."""
        sums = [[0] * len(self.paths) for _ in range(2)]
        for k, words, linked in self.runs:
            sums[0][k] += len(words)
            sums[1][k] += linked
        chars, links, anchors = (self.below(x) for x in (*sums, self.anchors))
        out: dict[str, list[int]] = {}
        for k in range(1, len(self.paths)):
            e = out.setdefault(self.paths[k], [0, 0, 0, 0, 0])
            e[:] = e[0] + 1, e[1] + chars[k], e[2] + links[k], e[3] + anchors[k], max(e[4], self.evidence[k])
        return out


@dataclass(frozen=True)
class Template:
    """roots: paths of the elements that hold the slots; out: furniture; spared: no furniture, whatever their names say;
    constant: runs that are the same on all pages."""

    roots: tuple[str, ...] = ()
    out: frozenset[str] = frozenset()
    spared: frozenset[str] = frozenset()
    constant: frozenset[int] = field(default=frozenset())


def read_page(text: str) -> Page:
    runs: list[tuple[int, str, int]] = []
    around, paths, evidence, marked, inside, anchors = [0], [""], [0], [False], [False], [0]
    stack: list[tuple[str, int]] = [("", 0)]
    run: list[str] = []
    in_link, links = False, 0
    skip: list | None = None  # an inline button or advert: tag, how many are open, depth of the stack

    def flush() -> None:
        if run:
            if words := " ".join(html.unescape("".join(run)).split()):
                runs.append((stack[-1][1], words, min(links, len(words))))
            run.clear()

    end = 0
    for m in TOKEN.finditer(text):
        if m.start() > end and not skip:
            run.append(text[end : m.start()])
            links += (m.start() - end) * in_link
        end = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SPACES:
            run.append(" ")
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not m["close"]
                anchors[stack[-1][1]] += in_link and not skip
            if skip:
                skip[1] += (-1 if m["close"] else 1) * (tag == skip[0])
                skip = skip if skip[1] else None
            elif not m["close"] and (tag == "button" or ("=" in m["attrs"] and tag not in VOID and ADVERTS.search(_names(m["attrs"])))):
                run.append(" ")  # inline, but never part of the text
                skip = [tag, 1, len(stack)]
            continue
        flush()
        links = 0
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            skip = skip if skip and len(stack) >= skip[2] else None
            continue
        shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for k in range(len(stack) - 1, skip[2] - 1 if skip and skip[0] == "button" else 0, -1):
            if stack[k][0] in shut:
                del stack[k:]
                break
            if stack[k][0] not in ("p", "td", "th", "li", "dt", "dd") and stack[k][0] not in shut:
                break
        skip = skip if skip and len(stack) >= skip[2] else None
        raw = m["attrs"]
        attrs = {a.lower(): v.strip("\"'") for a, v in ATTR.findall(raw)} if len(raw) > 1 else {}
        above = stack[-1][1]
        name = tag
        if attrs:
            marks = sorted((attrs.get("class", "") + " #" + attrs["id"] if "id" in attrs else attrs.get("class", "")).split())
            name = ".".join([tag, *(re.sub(r"\d+", "0", x).replace("/", "_") for x in marks)])
        stack.append((tag, len(paths)))
        around.append(above)
        paths.append(f"{paths[above]}/{name}")
        doubt = _doubt(f"{attrs.get('class', '')} {attrs.get('id', '')}", inside[above]) if attrs and tag not in ("body", "html", "article", "main") else 0
        evidence.append(SURE if _furniture(tag, attrs, inside[above]) else doubt)
        marked.append(tag in ("article", "main"))
        inside.append(inside[above] or marked[-1])
        anchors.append(0)
    if end < len(text) and not skip:
        run.append(text[end:])
    flush()
    return Page(runs, around, paths, evidence, marked, anchors)


def _names(raw: str) -> str:
    return " ".join(v.strip("\"'") for a, v in ATTR.findall(raw) if a.lower() in ("class", "id"))


def _judge(page: Page, evidence: list[int]) -> list[bool]:
    """Which elements of a page are furniture by its own evidence.  Tags, roles and styles count.  Names are in doubt:
    they don't count on an element that holds most of what is in article and main elements, nor, if
    such a word is only part of the name, on one that holds most of the page's text (not as
    links).  If that leaves a page without text, other names don't count there either."""
    n = len(evidence)
    sure = [False] * n
    for k in range(1, n):
        sure[k] = sure[page.around[k]] or evidence[k] == SURE
    own, linked = [0] * n, [0] * n
    for k, words, links in page.runs:
        if not sure[k]:
            own[k] += len(words)
            linked[k] += links
    if not any(0 < e < SURE for e in evidence):
        return sure
    below, links, held = page.below(own), page.below(linked), [0] * n
    for k in range(n - 1, 0, -1):
        held[page.around[k]] += below[k] if page.marked[k] else held[k]
    for spared in (1, 3):
        out = [False] * n
        for k in range(1, n):
            doubt = evidence[k] % SURE
            wrapper = (doubt < 3 and 2 * held[k] > held[0]) or (doubt <= spared and 2 * below[k] > below[0] and 2 * links[k] <= below[k])
            out[k] = out[page.around[k]] or sure[k] or (doubt > 0 and not wrapper)
        if any(x and not f for x, f in zip(own, out, strict=True)):
            break
    return out


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """Per host (and over all hosts as ``*``) each token's support, uses, vector hash (two sums), characters, those in
    links, the number of links, and the evidence of an element.  ``pages``: id, url, html.  Tasks add up what they have before the shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}

        def flush() -> pa.RecordBatch:
            host, token = zip(*sums, strict=True) if sums else ((), ())
            columns = list(zip(*sums.values(), strict=True)) if sums else [()] * (2 + len(SUMS))
            kinds = [pa.string(), *[pa.int64()] * (1 + len(SUMS))]
            out = pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(token, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["host", "token", "element", "evidence", *SUMS])
            sums.clear()
            return out

        for batch in batches:
            for key, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(url)
                page = read_page(source or "")
                tokens = [(_hash(path), path, e) for path, e in page.elements().items()]
                runs: dict[int, int] = {}
                for at, text, _ in page.runs:
                    runs[k] = runs.get(k := _hash(f"{page.paths[at]}\0{text}", 1), 0) + 1
                tokens += [(k, None, (n, 0, 0, 0, 0)) for k, n in runs.items()]
                tokens.append((0, "", (1, sum(len(t) for _, t, _ in page.runs), sum(n for *_, n in page.runs), 0, 0)))
                for k, path, (n, chars, links, inner, evidence) in tokens:
                    vector = xxhash.xxh64_intdigest(f"{key}\0{url}\0{n}")
                    for where in (host, "*") if path is not None else (host,):
                        s = sums.setdefault((where, k), [path, 0, *[0] * len(SUMS)])
                        s[1] = max(s[1], evidence)
                        for i, x in enumerate((1, n, vector & 0xFFFFFFFF, vector >> 32, chars, links, inner), 2):
                            s[i] += x
            if len(sums) > 200_000:
                yield flush()
        yield flush()

    summed = pages.mapInArrow(counted, FIELDS).groupBy("host", "token")
    return summed.agg(F.max("element").alias("element"), F.max("evidence").alias("evidence"), *[F.sum(c).alias(c) for c in SUMS])


def nested(elements: dict[str, int]) -> dict[str, str]:
    """The template tree: each element (path -> class) that nests with its class, and the element around it.

    A class whose outermost elements lie in different slots (elements) of the others isn't
    valid, and leaves the tree.
    """
    while True:
        parent = {}
        for path in elements:
            up = path.rpartition("/")[0]
            while up and up not in elements:
                up = up.rpartition("/")[0]
            parent[path] = up
        slots: dict[int, set[str]] = {}
        for path, up in parent.items():
            if elements.get(up) != elements[path]:
                slots.setdefault(elements[path], set()).add(up)
        bad = {k for k, s in slots.items() if len(s) > 1}
        if not bad:
            return parent
        # the innermost of the invalid classes first: others may nest once it is gone
        depth = {k: max(p.count("/") for p, c in elements.items() if c == k) for k in bad}
        worst = max(bad, key=lambda k: (depth[k], k))
        elements = {p: c for p, c in elements.items() if c != worst}


def judge_template(elements: dict[str, tuple[int, int, int, int, int]], pages: int, total: int, linked: int = 0) -> tuple[list[str], list[str], list[str]]:
    """(roots, out, spared) of a template, from each element's class, characters, those in links, number of links, and evidence.

    An element with more than half of all text outside links is spared (comments only if nothing else is
    left).  One that is mostly links, three or more of them a page, and no heading, is out; of
    the others those are out whose tag or names say so, but names don't count on what holds most of the
    text in article and main elements.
    """
    parent = nested({p: e[0] for p, e in elements.items()})
    order = sorted(parent, key=lambda p: (p.count("/"), p))
    marked = [p for p in order if (m := MARKED.search(p)) and m.end() == len(p)]
    held = lambda p: sum(elements[x][1] for x in marked if x == p or x.startswith(p + "/"))
    for last in (False, True):
        out, spared, kept = set(), set(), {"": total} | {p: elements[p][1] for p in order}
        for p in order:
            _, chars, links, anchors, evidence = elements[p]
            if any(p.startswith(x + "/") for x in out):
                kept[p] = 0
                continue
            most = 2 * (chars - links) > total - linked
            wraps = 0 < evidence < 3 and 2 * held(p) > held("") > 0
            menu = 2 * links > chars and anchors >= 3 * pages and not most and not re.search(r"/h[1-6][^/]*$|/(?:article|main)[^/]*$", p)
            names = evidence in (1, 2) and not most and not wraps
            if menu or (not last and (names or evidence == 3)) or (evidence == SURE and not most):
                out.add(p)
                up = p
                while up:
                    up = parent[up]
                    kept[up] -= chars
                kept[p] = 0
            elif evidence:
                spared.add(p)
        if kept[""] > 0:
            break
    at = ""
    while not (m := MARKED.search(at)) and (inner := [p for p in order if parent[p] == at and p not in out and kept[p] == kept[at] > 0]):
        at = inner[0]
    outer = [p for p in marked if kept[p] and not any(p.startswith(x + "/") for x in marked)]
    roots = outer if sum(kept[p] for p in outer) * 2 >= kept[""] > 0 else [at] if at else []
    return roots, sorted(out), sorted(spared)


TEMPLATES = "host string, pages long, roots array<string>, out array<string>, spared array<string>, constant array<long>"


def deduce_templates(vectors: DataFrame, support: float = 0.5) -> DataFrame:
    """(host, pages, roots, out, spared, constant), one row for each host: its ``Template``.

    Only tokens on at least ``support`` of a host's pages (2 at least) enter a class, so a host's
    classes are no more than its pages are long.
    """
    totals = vectors.where("token = 0").select("host", F.col("pages").alias("host_pages"), F.col("chars").alias("host_chars"), F.col("links").alias("host_links"), F.col("low").alias("all_low"), F.col("high").alias("all_high"))
    frequent = vectors.where(f"token <> 0 and pages >= {LEAST_PAGES}").join(totals, "host").where((F.col("pages") >= support * F.col("host_pages")))
    once = F.col("element").isNotNull() & (F.col("uses") == F.col("pages"))
    grouped = frequent.groupBy("host", "host_pages", "host_chars", "host_links", "all_low", "all_high", "pages", "low", "high").agg(F.collect_list(F.when(once, F.struct("element", "chars", "links", "anchors", "evidence"))).alias("elements"), F.collect_list(F.when(F.col("element").isNull(), F.col("token"))).alias("runs"))
    # the runs that every page has belong to the class of the page itself
    whole = (F.col("low") == F.col("all_low")) & (F.col("high") == F.col("all_high")) & (F.col("pages") >= LEAST_PAGES)
    by_host = grouped.groupBy("host", "host_pages", "host_chars", "host_links").agg(F.collect_list("elements").alias("classes"), F.flatten(F.collect_list(F.when(whole, F.col("runs")))).alias("constant"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for pages, chars, links, classes in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                elements = {e["element"]: (k, e["chars"], e["links"], e["anchors"], e["evidence"]) for k, c in enumerate(sorted(classes, key=repr)) for e in c}
                found.append(judge_template(elements, pages, chars, links))
            lists = [pa.array([x[i] for x in found], pa.list_(pa.string())) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, batch.column(5)], ["host", "pages", "roots", "out", "spared", "constant"])

    return by_host.mapInArrow(judged, TEMPLATES)


def article(source: str, template: Template = Template()) -> str:
    """The page's text: blocks in its slots, less furniture and template text."""
    page = read_page(source)
    evidence = [SURE if p in template.out else 0 if p in template.spared else e for p, e in zip(page.paths, page.evidence, strict=True)]
    furniture = _judge(page, evidence)
    runs = [(k, t) for k, t, _ in page.runs if not furniture[k]]
    slots = [False] * len(page.paths)
    roots = set(template.roots).intersection(page.paths)
    if not roots:
        # the page isn't made by the template: its outermost article and main elements are the slots if they hold most of it
        at = [k for k, m in enumerate(page.marked) if m]
        slots = _inside(page, set(at))
        if 2 * sum(len(t) for k, t in runs if slots[k]) < sum(len(t) for _, t in runs):
            slots = [True] * len(page.paths)
    else:
        slots = _inside(page, {k for k, p in enumerate(page.paths) if p in roots})
        if not any(slots[k] for k, _ in runs):
            slots = [True] * len(page.paths)
    own = [(page.paths[k], t) for k, t in runs if slots[k]]
    if template.constant:
        varying = [(p, t) for p, t in own if _hash(f"{p}\0{t}", 1) not in template.constant]
        if 2 * sum(len(t) for _, t in varying) > sum(len(t) for _, t in own):
            own = varying
    return "\n\n".join(t for _, t in own)


def _inside(page: Page, roots: set[int]) -> list[bool]:
    out = [False] * len(page.paths)
    for k in range(1, len(out)):
        out[k] = k in roots or out[page.around[k]]
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 32_000_000) -> DataFrame:
    """id, url, text and n_chars of every page, from its whole HTML.

    A null or empty page gives the empty text; a null or broken url counts as the host "";
    repeated rows are pages of their own; an empty table stays empty.  Other columns are dropped.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    templates = materialize(deduce_templates(occurrence_vectors(rows)))
    listed = sum((F.length(F.array_join(c, "/")) for c in ("roots", "out", "spared")), F.length("host"))
    size = templates.agg(F.sum(listed + 8 * F.size("constant") + 64)).first()[0] or 0
    spark = pages.sparkSession
    fallback = {r.host: Template(tuple(r.roots)) for r in templates.where("host = '*'").collect()}.get("*", Template())
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def done(batch: pa.RecordBatch, found: Iterator[Template]) -> pa.RecordBatch:
        texts = [article(source or "", template) for source, template in zip(batch.column(2).to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    few = F.col("pages") < LEAST_PAGES
    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast({r.host: Template(tuple(r.roots), frozenset(r.out), frozenset(r.spared), frozenset(r.constant)) for r in templates.where(~few).collect()})

        def by_lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield done(batch, (known.value.get(host_of(u), fallback) for u in batch.column(1).to_pylist()))

        return rows.mapInArrow(by_lookup, schema)

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())], ["id", "url", "html", "host"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(*(batch.column(k).to_pylist() for k in range(3, 7)), strict=True)
            yield done(batch, (fallback if r is None else Template(tuple(r), *map(frozenset, rest)) for r, *rest in lists))

    hosted = rows.mapInArrow(with_host, T.StructType([*rows.schema.fields, T.StructField("host", T.StringType())]))
    names = ["roots", "out", "spared", "constant"]
    return hosted.join(templates.where(~few).select("host", *names), "host", "left").select("id", "url", "html", *names).mapInArrow(joined, schema)
