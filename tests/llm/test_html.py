import time
from itertools import product

import numpy as np

from tenderweave.llm.boosting import Trees
from tenderweave.llm.html import PARTS, SPLIT_COST, SPLIT_SHARE, Page, extracted, sampled, train

NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News and more</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 The Company. All rights.</footer>"


def words(k, n):
    return " ".join(f"wort{(k * 7 + i * i) % 91}" for i in range(n)) + "."


def page(k, tag="article", cls="", extra=""):
    close = tag
    attr = f' class="{cls}"' if cls else ""
    body = "".join(f"<p>{words(k + i, 12 + (k * 5 + i * 3) % 40)}" + ("</p>" if (k + i) % 2 else "") for i in range(4))
    return f"<!DOCTYPE html><html><head><title>t {k}</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{NAV}<!-- c --><div class=\"ad\">{words(k, 9)}</div><{tag}{attr}><h1>Head &amp; {k}</h1>{body}{extra}</{close}>{FOOT}</body></html>"


def truth(k):
    return "\n\n".join([f"Head & {k}", *(words(k + i, 12 + (k * 5 + i * 3) % 40) for i in range(4))])


def test_blocks_white_space_and_references():
    p = Page("x<p>a <b>b</b>\n\n c&nbsp;&lt;d&gt;<br>e<p>f<div>g</div>h<script>n</script><ul><li>i<li>j</ul><table><tr><td>k<td>l</table>&eacute;")
    assert [t for _, t in p.blocks] == ["x", "a b c <d> e", "f", "g", "h", "i", "j", "k", "l", "é"]


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    odds = Trees(30, 3).fit(x[:3000], y[:3000]).score(x[3000:])
    assert ((odds > 0) == y[3000:]).mean() > 0.97


def _worth(p, odds, choice, i):
    """Of a labelling of all nodes (1, -1 or 0), by the definition; None if it contradicts itself."""
    inside = lambda j: [j, *(x for c in p.children[j] for x in inside(c))]
    if choice[i]:
        under = inside(i)
        if any(choice[j] != choice[i] for j in under) or (choice[i] > 0 and any(p.tag[j] in PARTS and p.size[j] and odds[j] <= 0 for j in under)):
            return None
        return choice[i] * sum((p.own[j] + 20 * (p.size[j] > 0)) * odds[j] for j in under)
    if not p.children[i]:
        return None
    each = [_worth(p, odds, choice, c) for c in p.children[i]]
    if None in each:
        return None
    worth = p.own[i] * abs(odds[i]) + sum(each)
    return worth - min(SPLIT_COST, SPLIT_SHARE * abs(worth))


def test_decoding_is_the_best_of_all_consistent_labellings():
    for html in ("<div><div><p>aaaaaaaaaaaaaaaaaaaaaaaaa</p><p>b</p></div><p>cccccccccccccccccccccccccccccc</p></div>", "<nav>home</nav><div>dddddddddd<aside>ee</aside><p>ffffff</p></div><p></p>"):
        p = Page(html)
        for seed in range(60):
            odds = np.random.default_rng(seed).normal(0, 3, len(p.tag))
            best = max((w, c) for c in product((1, -1, 0), repeat=len(p.tag)) if (w := _worth(p, odds, c, 0)) is not None)
            how = p.choices(odds)
            state = list(how)
            for i in range(1, len(state)):
                state[i] = state[p.parent[i]] or state[i]
            assert abs(_worth(p, odds, tuple(state), 0) - best[0]) < 1e-6
            kept = p.decode(odds)
            assert all(kept[i] == (state[i] > 0) for i in range(len(kept)) if state[i])


def test_wide_deep_and_inline_pages_take_linear_time():
    for make in (lambda n: "<ul>" + "<li>x y z" * n + "</ul>", lambda n: "<p>" + "<i>x</i> y " * n, lambda n: "<div>" * n + "x" + "</p></div>" * n):
        took = []
        for n in (25_000, 100_000):
            began = time.process_time()
            p = Page(make(n))
            p.decode(np.ones(len(p.tag)))
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 1


def test_menus_and_comments_without_telling_names():
    model = train([page(k) for k in range(60)])
    run = lambda h: (lambda p: p.text(model.score(p.features)))(Page(h))
    plain = lambda h: h.replace("<nav>", '<div class="k2">').replace("</nav>", "</div>").replace("<article", '<div class="c7"').replace("</article>", "</div>").replace('class="ad"', 'class="k8"')
    comments = '<div class="k9">' + "".join(f'<div class="k1"><p>Ann {i}</p><p>{words(i, 6 + i)}</p></div>' for i in range(4)) + "</div>"
    for k in range(70, 80):
        h = page(k)
        assert run(plain(h)) == truth(k)
        assert run(h.replace(NAV, '<nav><a href="/">Home</a></nav>')) == truth(k)
        assert run(plain(h.replace("</article>", "</article>" + comments))) == truth(k)


def test_articles_without_the_rest(spark):
    rows = [(k, f"http://x/{k}", page(k)) for k in range(60)]
    odd = [
        (100, page(100, "div", "post-content")),
        (101, page(101, "section", "story")),
        (102, page(102, extra='<section class="comments"><p>' + words(3, 30) + "</p><p>" + words(4, 20) + "</p></section>")),
        (103, page(103).replace("<article", '<aside class="sidebar"><p>' + words(5, 25) + '</p></aside><div class="cookie-notice">' + words(6, 14) + "</div><article")),
        (104, page(104, extra='<form class="newsletter"><p>' + words(8, 6) + "</p><input></form>")),
    ]
    rows += [(k, None, h) for k, h in odd] + [(200, "u", None), (201, "u", ""), (7, "again", page(7)), (202, "u", "<article><p>" + words(1, 40000) + "</article>")]
    got = {(r.page_id, r.url): r for r in extracted(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()}
    assert len(got) == len(rows)
    for k, url, html in rows:
        r = got[k, url]
        assert r.n_chars == len(r.text)
        if k < 200:
            assert r.text == truth(k), k
    assert got[200, "u"].text == got[201, "u"].text == "" and len(got[202, "u"].text.split()) == 40000
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_no_training_pages(spark):
    assert train([]) is None
    rows = [(1, "u", f"<body>{NAV}<div><p>{words(1, 30)}</p></div>{FOOT}")]
    assert [r.text for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [words(1, 30)]


def test_marked_sections_cost_no_text():
    for odd in ("<![foo]>", "<![]>", "<![ ]>", "<![if !IE]>", "<![endif]>", "<![endif]-->", "<![CDATA[x]]>", "<![1[a]>", "<![foo\n bar[ ]]>"):
        p = Page(f"<p>one</p>{odd}<p>two</p><p>three</p>")
        assert [t for _, t in p.blocks] == ["one", "two", "three"], odd
    assert [t for _, t in Page("<p>one</p><![foo").blocks][0] == "one"
    long = Page(f"<p>a&#{'9' * 6000};b</p><p>c&#{'0' * 6000}65;</p><p>d</p>")
    assert [t for _, t in long.blocks] == ["a\ufffdb", "cA", "d"]


def test_the_sample_is_bounded_and_has_no_copies(spark):
    rows = [(k, page(k % 20)) for k in range(100)] + [(500, "<p>no article</p>"), (501, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").repartition(16)
    got = sampled(df, 10)
    assert len(got) == 10 == len(set(got)) and got == sampled(df.repartition(3), 10)
    assert len(sampled(df, 1000)) == 20


def test_no_article_is_lost_to_its_markup(spark, sf_dir):
    model = train(sampled(spark.read.parquet(f"{sf_dir}/pages.parquet"), 150))
    run = lambda h: (lambda p: p.text(model.score(p.features)))(Page(h))
    p = ["This is the first paragraph of a text that has some words and ends here.", "The second one goes on about something else, with commas, and a full stop.", "A third paragraph closes it all. It has two sentences."]
    text = "".join(f"<p>{x}</p>" for x in p)
    items = [f"Step {i}: take the part number {i} and put it beside the others." for i in range(9)]
    steps = "<ol>" + "".join(f"<li>{x}</li>" for x in items) + "</ol>"
    whole = "\n\n".join(["H", *p])
    pages = [
        (f"<html><head><title>T</title>{NAV}<article><h1>H</h1>{text}</article>{FOOT}", whole),  # both head's end and body may be left out
        (f"<html><head><meta charset=x>{NAV}<article><h1>H</h1>{text}</article>{FOOT}", whole),
        *((f"<body>{NAV}<{c}>Go <article><h1>H</h1>{text}</article>{FOOT}</body>", whole) for c in ("button", "select><option", "textarea", "datalist")),
        (f"<body>{NAV}<noscript><article><h1>H</h1>{text}</article></noscript>{FOOT}</body>", whole),
        (f"<body>{NAV}<article><h1>How</h1>{steps}</article>{FOOT}</body>", "\n\n".join(["How", *items])),
        (f"<body>{NAV}<article><h1>How</h1>{text}{steps}</article>{FOOT}</body>", "\n\n".join(["How", *p, *items])),
        (f"<article><p>{p[0]}</p></article>", p[0]),
        (f"<body>{NAV}<article><p>{p[0]}</p></article>{FOOT}</body>", p[0]),
        (f"<body>{NAV}<article>{f'<p>{p[0]}</p>' * 3}</article>{FOOT}</body>", "\n\n".join([p[0]] * 3)),
        (f'<table><tr><td><a href="/">Home</a><br><a href="/n">News</a><br><a href="/c">Contact</a></td><td><h1>H</h1>{text}</td></tr></table>', whole),
    ]
    for html, want in pages:
        assert run(html) == want, html


def test_what_a_head_may_hold_stays_unseen():
    p = Page("<head><title>t</title><style>s</style><noscript><link href=x></noscript><script>j</script></head><p>a</p>")
    assert [t for _, t in p.blocks] == ["a"]
    assert [t for _, t in Page("<head><title>t</title>loose text<p>a").blocks] == ["loose text", "a"]
    assert [t for _, t in Page("<p>a</p><select><option>x<option>y</select><p>b</p><button>z</button>c").blocks] == ["a", "b", "c"]
