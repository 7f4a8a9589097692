"""Main text of hosts with copies, mixed layouts, and marks around the article."""

from lithic.llm.wrapper import extract, main_text, parse


def texts(spark, htmls):
    df = spark.createDataFrame([(k, "http://h.example/", h) for k, h in enumerate(htmls)], "page_id long, url string, html string")
    return [r.text for r in extract(df).orderBy("page_id").collect()]


def article(k, nav="", extra=""):
    return f"<html><body><nav>menu {nav}</nav><div class=x><p>Same promise</p></div><div class=y><h1>head {k}</h1><p>story {k}</p></div>{extra}</body></html>"


def test_copies_vote_once(spark):
    # pages of one article, exact and under other menus, next to a few others: whichever is the pivot, no article is lost
    for main in range(4):
        pages = [article(k) for k in range(3)] + [article(main)] * 12 + [article(main, nav=k) for k in range(12)]
        for got, k in zip(texts(spark, pages), [0, 1, 2] + [main] * 24, strict=True):
            assert got.endswith(f"head {k}\nstory {k}")
    # many copies of an odd page don't keep a true template node
    odd = "<html><body><div class=x><p>Odd promise</p></div><div class=y><h1>odd</h1><p>odd story</p></div></body></html>"
    got = texts(spark, [article(k) for k in range(12)] + [odd] * 30)
    assert got[:12] == [f"head {k}\nstory {k}" for k in range(12)]


def test_layouts_have_their_own_pivots(spark):
    def other(k):
        return f"<html><body><div class=z><p>Other promise</p></div><section class=w><h2>Also constant</h2><p>tale {k}</p></section></body></html>"

    listing = "<html><body><ul class=list><li>Entry</ul></body></html>"
    cut = "<html><body><nav>menu"
    pages = [article(k) for k in range(8)] + [other(k) for k in range(8)] + [listing, cut]
    want = [f"head {k}\nstory {k}" for k in range(8)] + [f"tale {k}" for k in range(8)] + ["Entry", ""]
    assert texts(spark, pages) == want
    # optional parts don't set pages apart that are too few for a layout of their own
    few = [article(k, extra=("", "<aside>more</aside>", "<footer>end</footer>")[k % 3]) for k in range(6)]
    assert texts(spark, few) == [f"head {k}\nstory {k}" for k in range(6)]


def test_marks_around_the_article():
    text = lambda html: main_text(parse(html))
    story = "<h1>head</h1><p>A story that is longer than all around it.</p>"
    want = "head\nA story that is longer than all around it."
    # the end tag of head is optional
    assert text(f"<html><head><title>t</title><meta charset=utf-8><body>{story}</body></html>") == want
    assert text(f"<title>t</title><head><link rel=x><div>{story}</div>") == want
    assert text(f"<head><noscript><img src=x></noscript><title>t</title></head><body>{story}") == want
    # a class or id of a wrapper that has a mark for a part
    for name in ("has-sidebar", "content-sidebar-wrap", "page no-header", "with_comments", "site-header-fixed"):
        for inner in (story, f"<article>{story}</article>", f"<main>{story}</main>"):
            page = f"<body><div class='{name}'><div class=sidebar>aside</div><div class=in>{inner}</div><div id=comments-list>me</div></div></body>"
            assert text(page) == want, page
    assert text(f"<body><div class=sidebar><main>{story}</main></div></body>") == want
    # parts that aren't the article stay off, whatever they hold
    more = "<p>" + "more and more text " * 20 + "</p>"
    for part in (f"<div class=sidebar>{more}</div>", f"<div class=related><article>{more}</article></div>", f"<div id=comments-list>{more}</div>", f"<div class='cookie-consent'>{more}</div>"):
        inner = f"<article>{story}</article>" if "article" in part else story
        assert text(f"<body><div>{inner}</div>{part}</body>") == want, part


def test_induction_decides(spark, monkeypatch):
    """Unmarked template blocks go only by induction; parts named by other words stay; no word is cut out of a sentence."""
    import lithic.llm.wrapper as W

    def page(k):
        return f"<body><div class=top><p>Our <a href=/>paper</a> since 1900</p></div><div class=text><h1>head {k}</h1><p>story {k} <b>Note:</b> the rest</p><section class=share-prices><p>prices {k}</p></section><section id=related-work><p>works {k}</p></section></div><div class=end><ul><li><a>Terms</a><li><a>Jobs</a></ul></div></body>"

    pages = [page(k) for k in range(8)]
    want = [f"head {k}\nstory {k} Note: the rest\nprices {k}\nworks {k}" for k in range(8)]
    assert texts(spark, pages) == want
    monkeypatch.setattr(W, "SAME", 2.0)  # no node is ever the same on so many pages
    assert texts(spark, pages) == [f"Our paper since 1900\n{w}\nTerms\nJobs" for w in want]


def test_names_of_parts():
    from lithic.llm.wrapper import _marked

    assert all(map(_marked, ["comments-list", "cookie-consent", "ad", "ad-2", "sideBar", "side-bar", "site-footer", "related-posts", "commentList", "skip-link"]))
    assert not any(map(_marked, ["share-prices", "related-work", "content-sidebar-wrap", "site-header-fixed", "download", "searching", "story", "12", ""]))


def test_tree_matching_against_all_matchings():
    """Size of the matching against every ordered matching of children, and no bound on depth."""
    import random
    from functools import cache

    from lithic.llm.wrapper import match

    def tree(rng, depth):
        return f"<{(t := rng.choice('ab'))}1>" + "".join(tree(rng, depth - 1) for _ in range(rng.randint(0, 3) if depth else 0)) + f"</{t}1>"

    @cache
    def most(p, q):
        if p.label != q.label:
            return 0

        def best(i, j):
            if i == len(p.kids) or j == len(q.kids):
                return 0
            return max(best(i + 1, j), best(i, j + 1), most(p.kids[i], q.kids[j]) + best(i + 1, j + 1) if p.kids[i].label == q.kids[j].label else 0)

        return 1 + best(0, 0)

    rng = random.Random(2)
    for _ in range(60):
        a, b = (parse("".join(tree(rng, 3) for _ in range(2))) for _ in range(2))
        assert len(match(a, b)) == most(a, b)
    deep = [parse("<div>" * 3000 + x) for x in ("<p>a</p>", "<p>b</p><ul></ul>")]
    assert len(match(*deep)) == 3002
