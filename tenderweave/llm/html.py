"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements; inline markup belongs to the block around it. Each node has
features: its tag, tokens of its class, id and role, density of its subtree (characters, tags, links,
sentence ends), depth, and statistics of its siblings. Trees are trained on a bounded sample of
pages that say themselves where their article is (article and main elements); each also appears in
variants in which those elements are anonymous or only named by class, and with menus, notices,
comments and the like put in, so that the model leans on more than one clue.

Decoding picks for each subtree the best of: keep all of it, drop all of it, or go on to the children
one by one. A node that is kept or dropped whole has no descendant that says otherwise. Going on costs
a share of what there is to decide, so a short menu beside a long article is still told apart; a
navigation, footer, aside or form of negative odds is never kept with what is around it.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees

TRAIN_PAGES = 150
TRAIN_CHARS = 200_000
SPLIT_COST = 30.0
SPLIT_SHARE = 0.02
LENT = 1.0
BATCH_NODES = 20_000

# HTML element names and usual words of class names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template iframe object svg math canvas audio video select option textarea button datalist".split())
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())  # what can stand in a head
CONTROLS = ("button", "select", "option", "textarea", "datalist")  # left open, they end where a block begins
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "body": ("head", "title")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}
KINDS = ("html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "dl", "dd")
GOOD = frozenset("article content main body post story entry text prose maincontent blogpost news copy".split())
BAD = frozenset(
    "ad ads advert advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget related recommended footer foot header masthead comment comments "
    "reply replies discussion disqus respond cookie consent notice notices alert popup modal newsletter subscribe subscription signup share sharing social toolbar pagination pager tags form search login copyright legal".split()
)


PARTS = frozenset("nav footer aside form".split())
LENDS_NOT = PARTS | frozenset("div section header".split())
CUES = frozenset("comment comments reply replies says ago posted share tweet subscribe newsletter cookie cookies copyright reserved menu home login register search related advertisement sponsored privacy terms contact".split())

_NONE: frozenset[str] = frozenset()

#: A reference of more digits than int() takes; eight of them are beyond all characters already.
_LONG = re.compile("&#(?=[0-9]{1000})0*([0-9]{1,8})[0-9]*")


class _Dom(HTMLParser):
    """Block nodes in page order; node 0 is the page. parts: (node, text) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.tokens, self.hidden, self.tags, self.link = ["html"], [-1], [_NONE], [False], [1], [0]
        self.marked = [False]
        self.parts: list[tuple[int, list[str]]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]  # inline elements stand with their block
        self.open: Counter[str] = Counter()  # names on the stack: most closing tags need no look at it
        self.mute = self.links = 0
        self.fresh = True

    def parse_html_declaration(self, i):
        """A marked section ends at the next > like any unknown declaration, as in HTML5; the parser's own raises on unknown names."""
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        if self.open["head"] and tag not in HEAD:
            self._close(("head",), ())
        if tag in CLOSES_P:
            self._close(("p",), ("table", "td", "th"))
            while any(self.open[c] for c in CONTROLS):
                self._close(CONTROLS, ())
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPES.get(tag, ()))
        node = self.stack[-1][1]
        self.tags[node] += 1
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            if tag not in INLINE:
                self.fresh = True
            return
        if tag in UNSEEN:
            self.mute += 1
        elif tag not in INLINE:
            self.tag.append(tag)
            self.parent.append(node)
            own = dict(attrs) if attrs else {}
            named = " ".join(own.get(k) or "" for k in ("class", "id", "role", "itemprop", "aria-label")) if own else ""
            self.marked.append("data-part" in own)
            self.tokens.append(frozenset(re.findall(r"[a-z]+", named.lower())) if named.strip() else _NONE)
            self.hidden.append(bool(own) and ("hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "")))
            self.tags.append(1)
            self.link.append(0)
            node = len(self.tag) - 1
            self.fresh = True
        if tag == "a":
            self.links += 1
        self.stack.append((tag, node))
        self.open[tag] += 1

    def handle_endtag(self, tag):
        self._close((tag,), ())

    def _close(self, names, scopes):
        """Closes the innermost open element of these names, unless one of scopes comes first."""
        if not any(self.open[name] for name in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in scopes:
                return
            if self.stack[k][0] in names:
                for name, _ in self.stack[k:]:
                    self.open[name] -= 1
                    self.mute -= name in UNSEEN
                    self.links -= name == "a"
                    self.fresh |= name not in INLINE
                del self.stack[k:]
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _text(self, data):
        if self.fresh or not self.parts:
            self.parts.append((self.stack[-1][1], [data]))
            self.fresh = False
        else:
            self.parts[-1][1].append(data)

    def handle_data(self, data):
        if self.stack[-1][0] == "head" and data.strip():
            self._close(("head",), ())
        if not self.mute:
            self._text(data)
            if self.links:
                self.link[self.stack[-1][1]] += len(data.strip())


#: Columns of the features behind the one for each of KINDS.
STATS = ("good", "bad", "hidden", "depth", "size", "own", "density", "links", "stops", "paragraphs", "share", "before", "siblings", "place", "alike", "of_most", "of_parent", "children", "cues", "heading_cues", "up_good", "up_bad")
_COLUMN = {name: len(KINDS) + k for k, name in enumerate(STATS)}
_KIND = {name: k for k, name in enumerate(KINDS)}


class Page:
    """The tree of a page, its blocks of text, and the features of its nodes. Time and memory grow with the page's length."""

    def __init__(self, html: str | None):
        dom = _Dom()
        dom.feed(_LONG.sub(r"&#\1", html or ""))
        dom.close()
        self.tag, self.parent, self.tokens, self.marked = dom.tag, dom.parent, dom.tokens, dom.marked
        self.blocks = [(node, text) for node, raw in dom.parts if (text := " ".join("".join(raw).split()))]
        n = len(self.tag)
        own, stops, cues, heading, before = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
        seen = last = 0
        for node, text in self.blocks:
            own[node] += len(text)
            stops[node] += text.count(".") + text.count("!") + text.count("?")
            if len(text) < 200:  # a cue in a long paragraph says nothing
                cues[node] += sum(w in CUES for w in re.findall(r"[a-z]+", text.lower()))
            k = node
            while k >= 0 and before[k] < 0:
                before[k], heading[k] = seen, last
                k = self.parent[k]
            if self.tag[node] in ("h1", "h2", "h3", "h4"):
                last = cues[node]
            seen += len(text)
        self.own, self.size = own, list(own)
        tags, link, paragraphs, depth = list(dom.tags), list(dom.link), [int(t == "p") for t in self.tag], [0] * n
        self.children = children = [[] for _ in range(n)]
        for i in range(1, n):
            children[self.parent[i]].append(i)
            depth[i] = depth[self.parent[i]] + 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for x in (self.size, tags, link, stops, paragraphs, cues):
                x[p] += x[i]
        count, place, alike, most = [1] * n, [0] * n, [1] * n, list(self.size)
        for some in children:
            if len(some) < 2:
                continue
            names = Counter(self.tag[k] for k in some)
            top = max(self.size[k] for k in some)
            for j, k in enumerate(some):
                count[k], place[k], alike[k], most[k] = len(some), j, names[self.tag[k]], top
        up = np.array([0, *self.parent[1:]])
        size, total = np.array(self.size, np.float64), max(1, self.size[0])
        good, bad = (np.array([len(t & known) if t else 0 for t in self.tokens], np.float64) for known in (GOOD, BAD))
        column = lambda x: np.array(x, np.float64)
        stats = (
            good, bad, column(dom.hidden), column(depth), np.log1p(size), np.log1p(column(own)), size / column(tags), column(link) / np.maximum(1, size), 100 * column(stops) / np.maximum(1, size), column(paragraphs), size / total,
            np.where(column(before) < 0, seen, column(before)) / total, column(count), column(place) / column(count), column(alike) / column(count), size / np.maximum(1, column(most)), size / np.maximum(1, size[up]),
            column([len(c) for c in children]), 100 * column(cues) / np.maximum(20, size), column(heading), np.where(np.arange(n) > 0, good[up], 0), np.where(np.arange(n) > 0, bad[up], 0),
        )
        self.features = np.zeros((n, len(KINDS) + len(STATS)))
        for i, t in enumerate(self.tag):
            if t in _KIND:
                self.features[i, _KIND[t]] = 1
        self.features[:, len(KINDS) :] = np.stack(stats, axis=1)

    def lent(self, odds: np.ndarray) -> np.ndarray:
        """odds with a share of those of the article or main element around, where these are positive: what stands in an
        article is its text unless much speaks against it. Containers get none, nor what is in them: they may be anything."""
        lends, out = [0.0] * len(self.tag), np.array(odds, np.float64)
        for i, tag in enumerate(self.tag):
            up = lends[self.parent[i]] if i else 0.0
            if tag in ("article", "main"):
                lends[i] = max(0.0, float(odds[i]))
            elif tag not in LENDS_NOT and not self.tokens[i] & BAD:
                lends[i] = up
                out[i] += LENT * up
        return out

    def choices(self, odds: np.ndarray) -> list[int]:
        """The best consistent choice for each subtree: 1 keep it, -1 drop it, 0 go on to the children.

        To keep or drop a subtree is worth its nodes' odds, weighted by their own text; to go on the
        node's own text decided for itself, and the children's best choices, less the cost of going
        on. A part of negative odds can't be kept, nor can anything around it as a whole.
        """
        n = len(self.tag)
        whole, best, how, pure = [0.0] * n, [0.0] * n, [0] * n, [True] * n
        for i in range(n - 1, -1, -1):
            s, some = float(odds[i]), self.children[i]
            if self.size[i]:
                pure[i] = all(pure[c] for c in some) and not (self.tag[i] in PARTS and s <= 0)
            whole[i] = (self.own[i] + 20 * (self.size[i] > 0)) * s + sum(whole[c] for c in some)
            one = max(-whole[i], whole[i]) if pure[i] else -whole[i]
            best[i], how[i] = one, 1 if pure[i] and whole[i] > 0 else -1
            if some:
                worth = self.own[i] * abs(s) + sum(best[c] for c in some)
                split = worth - min(SPLIT_COST, SPLIT_SHARE * abs(worth))
                if split > one:
                    best[i], how[i] = split, 0
        return how

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Whether each node's own text is kept."""
        odds = self.lent(odds)
        how, kept = self.choices(odds), [False] * len(self.tag)
        for i in range(len(how)):
            if i and how[self.parent[i]]:
                how[i] = how[self.parent[i]]
            kept[i] = how[i] > 0 or (how[i] == 0 and odds[i] > 0)
        return kept

    def text(self, odds: np.ndarray) -> str:
        kept = self.decode(odds)
        return "\n\n".join(text for node, text in self.blocks if kept[node])


def _other(page: Page, i: int) -> bool:
    """Whether a node is a part that is no article's: by its name, its classes, or as a variant put it in."""
    return page.tag[i] in ("nav", "footer", "aside", "form", "header") or page.marked[i] or bool(page.tokens[i] & BAD)


def _truth(page: Page) -> list[int]:
    """Of a page with marked articles: 1 inside, 0 outside or in a marked other part, -1 for nodes that hold both."""
    n = len(page.tag)
    inside, other = [0] * n, [False] * n
    for i in range(n):
        up = inside[page.parent[i]] if i else 0
        other[i] = _other(page, i) or bool(i and other[page.parent[i]])
        inside[i] = 0 if other[i] else 1 if page.tag[i] in ("article", "main") else up
    good = [page.own[i] * inside[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        good[page.parent[i]] += good[i]
    return [-1 if not page.size[i] or 0 < good[i] < page.size[i] else int(good[i] > 0) for i in range(n)]


def _name(rng: random.Random, telling: list[str]) -> str:
    """A class attribute: telling, neutral, or none."""
    kind = rng.random()
    if kind < 0.3:
        return f' class="{rng.choice(telling)}{rng.choice(["", "-box", " c1"])}"'
    return f' class="{rng.choice("ckxz")}{rng.randrange(100)}"' if kind < 0.7 else ""


def _reader_comments(some, rng: random.Random) -> str:
    """A list of like parts: a name, a short text, sometimes a heading and links to reply."""
    tag, inner, reply = rng.choice(["div", "li", "section"]), rng.choice(["p", "div"]), rng.random() < 0.5
    name = _name(rng, ["comment", "reply"])
    one = lambda: f"<{tag}{name}><{inner}>{some(rng.randrange(1, 3))}</{inner}><p>{some(rng.randrange(2, 45))}</p>" + ("<a href='#'>Reply</a>" if reply else "") + f"</{tag}>"
    alone = lambda: f"<{tag}{name}><p>{some(rng.randrange(2, 45))}</p></{tag}>"
    head = rng.choice(["", "", f"<h3>{rng.choice(['Comments', '3 comments', 'Replies', some(1)])}</h3>"])
    return head + "".join(rng.choice([one, alone])() for _ in range(rng.randrange(2, 7)))


def _sections(html: str, rng: random.Random) -> str:
    """The page with its article's paragraphs in neutral containers of several each."""
    m = re.search(r"(?is)<(article|main)(?=[ >]).*</\1>", html)
    if not m:
        return html
    pieces = re.split(r"(?i)(?=<p[ >])", m[0])
    out, k = pieces[0], 1
    while k < len(pieces):
        step = rng.randrange(2, 6)
        body, end = "".join(pieces[k : k + step]), ""
        if k + step >= len(pieces):
            body, end = body[: body.rindex("</")], body[body.rindex("</") :]
        out += f"<div{_name(rng, ['section'])}>{body}</div>{end}"
        k += step
    return html[: m.start()] + out + html[m.end() :]


def _article(html: str) -> tuple[re.Match, list[str]] | None:
    """The article of a page and the texts of its paragraphs, if it has both."""
    m = re.search(r"(?is)<(article|main)(?=[ >])[^>]*>(.*)</\1>", html)
    texts = [x[1] for x in re.finditer(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</?(?:p|article|main|div|h\d|ul|ol|section|aside|form|nav|footer)[ >])", m[0])] if m else []
    return (m, texts) if any(t.strip() for t in texts) else None


def _listed(html: str, rng: random.Random) -> str:
    """The page with a part of its article's paragraphs, or all of them, as items of a list, a sentence each."""
    if not (found := _article(html)):
        return html
    m, texts = found
    texts = [t for t in texts if t.strip()]
    first = rng.randrange(len(texts))
    last = rng.randrange(first, len(texts)) + 1
    items = [x for x in re.split(r"(?<=[.!?])\s+", " ".join(texts[first:last])) if x.strip()] or texts[:1]
    outer, inner = rng.choice(["ul", "ol", "ol"]), rng.choice(["", "", "p"])
    item = (lambda x: f"<li><p>{x}</p></li>") if inner else (lambda x: f"<li>{x}</li>")
    plain = lambda some: "".join(f"<p>{t}</p>" for t in some)
    head = h[0] if (h := re.search(r"(?is)<h[12][ >].*?</h[12]>", m[2])) else ""
    body = head + plain(texts[:first]) + f"<{outer}>" + "".join(map(item, items)) + f"</{outer}>" + plain(texts[last:])
    return html[: m.start(2)] + body + html[m.end(2) :]


def _short(html: str, rng: random.Random) -> str:
    """The page with one or two of its article's paragraphs, with or without its heading; they may be alike."""
    if not (found := _article(html)):
        return html
    m, texts = found
    one = rng.choice([t for t in texts if t.strip()])
    head = h[0] if (h := re.search(r"(?is)<h[12][ >].*?</h[12]>", m[2])) and rng.random() < 0.5 else ""
    return html[: m.start(2)] + head + f"<p>{one}</p>" * rng.choice([1, 1, 2]) + html[m.end(2) :]


def _tabled(html: str, rng: random.Random) -> str:
    """The page's article as a cell of a table, beside or below a cell of links."""
    m = re.search(r"(?is)<(article|main)(?=[ >])[^>]*>.*</\1>", html)
    if not m:
        return html
    links = "".join(f'<a href="#">{w}</a>{rng.choice(["<br>", " ", " | "])}' for w in rng.sample(["Home", "News", "About us", "Contact", "Products", "Archive", "Help"], rng.randrange(2, 7)))
    between = rng.choice(["</td><td>", "</td></tr><tr><td>"])
    return f'<table><tr><td data-part="1">{links}{between}{m[0]}</td></tr></table>'


def _variants(html: str, other: str, rng: random.Random) -> Iterator[str]:
    """The page as it is, its article alone, in sections, short, as a list or in a table, and with other parts put in around
    and inside the article."""
    yield html
    yield _listed(html, rng)
    yield _short(html, rng)
    yield _tabled(rng.choice([html, html, _short(html, rng), _listed(html, rng)]), rng)
    if alone := re.search(r"(?is)<(article|main)[ >].*</\1>", rng.choice([html, html, _short(html, rng), _listed(html, rng)])):
        yield alone[0]
    words = re.sub(r"<[^>]*>", " ", other).split() or ["text"]
    some = lambda n: " ".join(words[(k := rng.randrange(len(words))) : k + n])
    bad = sorted(BAD)
    link = lambda: f'<a href="#">{rng.choice([some(1), some(2), "Home", "Menu"])}</a>'
    parts = [
        ("text", lambda: f"<p>{some(rng.randrange(3, 60))}</p>" * rng.randrange(1, 4)),
        ("form", lambda: f"<div>{some(3)}</div><div>{some(2)}</div>"),
        ("menu", lambda: "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(1, 9)))),
        ("nav", lambda: " ".join(link() for _ in range(rng.randrange(1, 6)))),
        ("comments", lambda: _reader_comments(some, rng)),
    ]
    tags = {"text": ["div", "aside", "section"], "form": ["form", "div"], "menu": ["div", "ul", "nav"], "nav": ["nav", "div"], "comments": ["div", "section", "ol"]}
    for place in ("inside", "before", "after"):
        put = ""
        for kind, body in rng.sample(parts, 3 if place != "after" else 2) + ([parts[4]] if place == "after" else []):
            tag = rng.choice(tags[kind])
            telling = _name(rng, bad) if kind != "text" or place != "inside" else f' class="{rng.choice(bad)}"'
            put += f'<{tag} data-part="1"{telling}>{body()}</{tag}>'
        base = rng.choice([_sections, _sections, _listed, _short, lambda h, _: h, lambda h, _: h])(html, rng)
        if place == "before":
            yield re.sub(r"(?i)<article|<main", lambda m: put + m[0], base, count=1)
        else:
            yield re.sub(r"(?i)</article>|</main>", lambda m: put + m[0] if place == "inside" else m[0] + put, base, count=1)


def _anonymous(page: Page, rng: random.Random) -> None:
    """Takes the names of article elements and of other parts, and maybe gives a telling class."""

    def rename(i: int, new: str, clue: str, telling: bool) -> None:
        page.features[i, _KIND[page.tag[i]]] = 0
        page.features[i, _KIND[new]] = 1
        page.features[i, _COLUMN[clue]] = telling
        for c in page.children[i]:
            page.features[c, _COLUMN[f"up_{clue}"]] = telling

    for i, tag in enumerate(page.tag):
        if tag in ("article", "main"):
            rename(i, rng.choice(["div", "section"]), "good", rng.random() < 0.4)
        elif tag in ("nav", "footer", "aside", "header") and rng.random() < 0.7:
            rename(i, "div", "bad", rng.random() < 0.5)


def train(pages: list[str]) -> Trees | None:
    """Trees from pages with article or main elements; None without any."""
    rng = random.Random(0)
    x, y = [], []
    for k, html in enumerate(pages):
        for one in _variants(html, pages[k - 1], rng):
            for hide in (False, True):
                page = Page(one)
                truth = np.array(_truth(page))
                if hide:
                    _anonymous(page, rng)
                x.append(page.features[truth >= 0])
                y.append(truth[truth >= 0])
    if not x or not 0 < np.concatenate(y).sum() < sum(map(len, y)):
        return None
    return Trees().fit(np.concatenate(x), np.concatenate(y))


def _by_hand(x: np.ndarray) -> np.ndarray:
    """Odds without a model: paragraphs speak for, named other parts and links against."""
    at = lambda name: x[:, _COLUMN[name]]
    bad = at("bad") + at("up_bad") + sum(x[:, _KIND[t]] for t in ("nav", "header", "footer", "aside", "form"))
    return 1.0 + 2 * at("good") - 4 * bad - 3 * at("links")


def _extractor(model: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, nodes, pages = 0, 0, []
            htmls = batch.column("html")
            for i in range(len(htmls)):
                pages.append(Page(htmls[i].as_py()))
                nodes += len(pages[-1].tag)
                if nodes >= BATCH_NODES or i == len(htmls) - 1:
                    x = np.concatenate([p.features for p in pages])
                    odds = model.score(x) if model else _by_hand(x)
                    texts, at = [], 0
                    for p in pages:
                        texts.append(p.text(odds[at : at + len(p.tag)]))
                        at += len(p.tag)
                    part = batch.slice(first, len(pages))
                    yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    first, nodes, pages = i + 1, 0, []

    return run


def sampled(pages: DataFrame, sample: int) -> list[str]:
    """The first `sample` different pages by hash that mark their article and aren't over TRAIN_CHARS long.

    First only hashes are ranked, then the pages of those hashes are fetched: the driver gets `sample`
    pages at most, however many tasks read the table.
    """
    marked = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= TRAIN_CHARS)).select("html", F.xxhash64("html").alias("h"))
    last = marked.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return []
    return [r[0] for r in marked.where(F.col("h") <= last).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").select("html").collect()]  # a bounded sample


def extracted(pages: DataFrame, sample: int = TRAIN_PAGES) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    pages has page_id, url and html; other columns don't matter. A null or empty html has the empty
    text. Text outside all elements is a block of the page's. The model is trained on the first
    `sample` pages by hash that have an article or main element and at most TRAIN_CHARS characters;
    without such pages a fixed formula takes its place. Pages of any length are read whole, in time
    that grows with their length. Nodes of even odds go. Repeated rows give a row each; no pages: no rows.
    """
    model = train(sampled(pages, sample))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extractor(model), "page_id long, url string, text string, n_chars long")
