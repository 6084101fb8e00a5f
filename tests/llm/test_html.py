"""HTML extraction: planted pages whose main text is known."""

import random
import time

import pytest

from brindle.llm import html_extract as h

PAGES = "page_id long, url string, html string"
SHELL = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{}<aside>More</aside><footer>&copy; me</footer></body></html>'


def page(i, body, host="www.Example.org:80"):
    return (i, f"https://{host}/p{i}?q=1", SHELL.format(body))


CASES = {
    "article": ("<article><h1>Head</h1><p>One  two\n three.</p><p>Four &amp; f&iuml;ve&nbsp;six.</p></article>", "Head One two three. Four & fïve six."),
    "unclosed": ("<article><p><b>Bold<p>Second<ul><li>a<li>b</ul>tail</article>", "Bold Second a b tail"),
    "inline": ("<article><p>a<b>b</b>c <i>d</i><br>e</p></article>", "abc d e"),
    "inside": ('<article><p>Text</p><div class="share-buttons">Share</div><form><p>Mail</p></form><div class="comments"><p>Nice</p></div><div id="ad-1">Buy</div><p>End</p></article>', "Text End"),
    "comment markup": ("<article><p>Text<!-- <p>no</p> --> more</p><script>x<p>no</p></script></article>", "Text more"),
    "entities": ("<article><p>&lt;p&gt; &#233; &#x1F600; &unknown; AT&T</p></article>", "<p> é 😀 &unknown; AT&T"),
    "divs": ('<div class="wrap"><div class="content"><p>Long enough main text of this page.</p><p>And more.</p></div><div class="sidebar">x</div></div>', "Long enough main text of this page. And more."),
    "hidden": ('<main><p>Shown</p><p hidden>no</p><div style="display: none">no</div><p aria-hidden="true">no</p></main>', "Shown"),
    "quotes": ("<article data-x='a>b' title=\"c>d\"><p>Text</p></article>", "Text"),
}


@pytest.mark.parametrize("name", CASES)
def test_planted_pages(spark, name):
    body, want = CASES[name]
    got = h.extract_pages(spark.createDataFrame([page(1, body)], PAGES)).first()
    assert (got.text, got.n_chars) == (want, len(want))


def test_hosts_vote(spark):
    """A page takes its host's path where its own best container is a wider one: lists of links beside the story, other ones on each page, go."""
    usual = '<div class="story"><p>{}</p></div>'
    links = '<div class="extra"><a href="/a">Other story {0}</a> <a href="/b">And {0} more</a></div>'
    rows = [page(i, usual.format(f"story {i} " * 40)) for i in range(5)] + [page(9, usual.format("short <a href='/c'>linked</a> story") + links.format(9)), page(10, usual.format("another") + links.format(10))]
    got = {r.page_id: r for r in h.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert (got[9].text, got[10].text) == ("short linked story", "another")
    assert len({(r.host, r.path) for r in got.values()}) == 1
    assert h.extract(rows[5][2], None)[0] == "short linked story Other story 9 And 9 more"


def test_other_text_in_a_repeated_container_stays(spark):
    """Five pages with one lead, two with leads of their own."""
    body = '<div class="lead">{}</div><div class="story"><p>{}</p></div>'
    rows = [page(i, body.format("Subscribe &amp; save", f"story {i} " * 9)) for i in range(5)] + [page(7, body.format("Only here: a lead.", "story seven")), page(8, body.format("Only there, too.", "story eight"))]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[7] == "Only here: a lead. story seven" and got[8] == "Only there, too. story eight"
    assert all(got[i] == (f"story {i} " * 9).strip() for i in range(5))


def test_texts_of_formulas_and_objects_stay():
    assert h.extract("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><object data='a.png'>A picture of it.</object></article>", None)[0] == "So x=1. A picture of it."


def brute_pages(rows):
    """Boilerplate, votes and extraction of all pages, by lists in one process."""
    hosts = {}
    for i, url, text in rows:
        hosts.setdefault(url.split("/")[2].lower(), []).append((i, text))
    out = {}
    for pages in hosts.values():
        seen = {}
        for _, text in pages:
            regions = h.read_page(text).regions()
            for path, own in regions.items():
                seen.setdefault(path, {}).setdefault(own, []).append("|".join(regions.values()))
        known = {}
        for path, texts in seen.items():
            total = sum(map(len, texts.values()))
            again = {own: wholes for own, wholes in texts.items() if len(wholes) >= 3 and len(set(wholes)) > 1}
            if path and 2 * sum(map(len, again.values())) > total:
                known[path] = frozenset(h._digest(own) for own, wholes in again.items() if 50 * len(wholes) >= total)
        votes = {}
        for _, text in pages:
            path, weight = h.vote(text, known)
            if path:
                votes[path] = votes.get(path, 0) + weight
        winner = min(votes, key=lambda p: (-votes[p], p)) if votes else None
        out |= {i: h.extract(text, winner, known) for i, text in pages}
    return out


def test_whole_pages_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        host = f"h{i % 4}.net"
        parts = [f'<div class="story c{i % 2}"><h1>Title {i}</h1><p>{" ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(60)))}</p></div>']
        parts += [f'<div class="teaser">{rng.choice(["Buy now", "Read on", f"Only on {i}"])}</div>'] * rng.randrange(2)
        parts += [f'<div class="more"><a href="/{k}">Story {k}</a></div>' for k in rng.sample(range(99), rng.randrange(3))]
        parts += [f"<p>Loose text {rng.randrange(5)}</p>"] * rng.randrange(2)
        rng.shuffle(parts)
        rows.append(page(i, "<div class='page'>" + "".join(parts) + "</div>", host))
    got = {r.page_id: (r.text, r.path) for r in h.extract_pages(spark.createDataFrame(rows, PAGES).repartition(5)).collect()}
    want = brute_pages(rows)
    assert got == want
    assert sum("Only on" in t for t, _ in got.values()) > 5 and not any("Story" in t for t, p in got.values() if p.endswith("story c#"))


def test_other_host_keeps_its_own_path(spark):
    rows = [page(i, f'<div class="a"><p>{"text " * 30}</p></div>') for i in range(3)] + [page(5, '<section class="b"><p>other host</p></section>', "b.net")]
    got = {r.page_id: r for r in h.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[5].text == "other host" and got[5].host == "b.net" and got[0].host == "example.org"


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no url", "plain text"), (None, "http://x.y/", "<p>a"), (4, "http://x.y/", "<nav>only menus</nav>"), (5, "http://x.y/", "<article><p>" + "long " * 100_000), (6, "http://x.y/", "<<<>>> < a & b <p"), (6, "http://x.y/", "<<<>>> < a & b <p")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS host", "'x' AS path", "'x' AS text", "'x' AS n_chars")
    got = {(r.page_id, r.url): r.text for r in h.extract_pages(pages).collect()}
    assert got[1, None] == got[2, ""] == got[4, "http://x.y/"] == ""
    assert got[3, "no url"] == "plain text" and got[None, "http://x.y/"] == "a"
    assert got[5, "http://x.y/"] == ("long " * 100_000).strip()
    assert h.extract_pages(pages).count() == len(rows)


def test_empty_table(spark):
    assert h.extract_pages(spark.createDataFrame([], PAGES)).collect() == []


MAIN = "<h1>Title</h1><p>The whole story of this page, told at length.</p><p>And its end.</p>"
STORY = "Title The whole story of this page, told at length. And its end."
NAMED = {
    "layout class": (f'<div class="layout has-sidebar"><div class="content with-sidebar">{MAIN}</div></div>', STORY),
    "heading id": ('<article><h2 id="binary-search">Binary search</h2><p id="related">Halve it.</p></article>', "Binary search Halve it."),
    "section": ('<article><p>Text</p><section class="related-work" id="related"><h2>Related work</h2><p>None.</p></section></article>', "Text Related work None."),
    "post header": (f'<div class="post"><div class="post-header"><h1>Title</h1></div>{MAIN[14:]}</div>', STORY),
    "most text": (f'<div class="search">{MAIN}</div>', STORY),
    "only article": (f'<div id="widget"><article>{MAIN}</article></div>', STORY),
    "form page": (f'<form id="aspnetForm"><div>{MAIN}</div></form>', STORY),
    "code": ('<article><pre>a = 1 <span class="token comment"># one</span></pre></article>', "a = 1 # one"),
    "still dropped": ('<article><p>Text</p><div class="cookie-banner">a</div><ul class="main-menu"><li>b</ul><div id="comments">c</div><div class="related-posts">d</div></article><div class="site-header">e</div>', "Text"),
    "long comments": (f'<article><p>Text</p><div class="comments"><p>{"so nice " * 50}</p></div></article>', "Text"),
}


@pytest.mark.parametrize("name", NAMED)
def test_names_drop_no_main_text(name):
    body, want = NAMED[name]
    assert h.extract(SHELL.format(body), None)[0] == want


def test_no_unmarked_text_is_left_outside():
    """A title and a lead beside the body stay, however long the body is."""
    body = '<main><h1>Title</h1><p>lead</p><div class="body"><section><h2>Part</h2><div>' + "<p>long text</p>" * 99 + "</div></section></div></main>"
    assert h.extract(SHELL.format(body), None)[0] == "Title lead Part" + " long text" * 99


def test_host_path_that_leaves_out_main_text_is_not_used(spark):
    """A page of another layout keeps all of its text; what repeats on a host without a mark goes everywhere."""
    usual = '<div class="story"><p>{}</p></div><div class="extra"><p>see this</p></div>'
    rows = [page(i, usual.format(f"story {i} " * 40)) for i in range(5)] + [page(8, '<div class="story"><p>a third of it</p></div><div class="more"><p>and the other two thirds</p></div>')]
    got = {r.page_id: r.text for r in h.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[8] == "a third of it and the other two thirds"
    assert all(got[i] == ("story %d " % i * 40).strip() for i in range(5))


def test_copies_of_a_page_make_no_boilerplate(spark):
    rows = [page(i, '<main><h1>Same title</h1><p>Same lead</p><div class="b"><p>Same text</p></div></main>') for i in range(6)]
    assert {r.text for r in h.extract_pages(spark.createDataFrame(rows, PAGES)).collect()} == {"Same title Same lead Same text"}


@pytest.mark.parametrize("page", ["<a " * 333_000, '<a "' * 250_001 + ">", "<div class='x'>" * 60_000 + "end", "<b>" * 50_000 + "</p>" * 50_000, "<article>" * 30_000 + "end", "<p><b>" * 60_000 + "end", "<" * 1_000_000 + ">"], ids=["unclosed", "quotes", "nested", "unopened", "articles", "inline", "brackets"])
def test_broken_markup_takes_linear_time(page):
    began = time.perf_counter()
    text, _ = h.extract(page, None)
    assert time.perf_counter() - began < 10  # seconds, not the hours of a quadratic scan
    assert text == "end" or "end" not in page


def test_tags_with_stray_quotes_are_markup():
    assert h.extract('<main><p class="a>one</p><p>two</p></main>', None)[0] in ("two", "one two")
    assert h.extract("<main><p title='>'>one</p> 1 < 2 &amp; 3 > 2</main>", None)[0] == "one 1 < 2 & 3 > 2"


def test_repeated_rows_are_extracted_each(spark):
    page = "<html><body><article><p>The text</p></article></body></html>"
    rows = [(1, "http://h/1", page)] * 3 + [(None, None, page)]
    got = h.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["The text"] * 4
