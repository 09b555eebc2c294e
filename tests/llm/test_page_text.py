import itertools
import random

import pytest

from ledgerloom.llm import page_text

ODDS = {f: max(-2.0, min(2.0, x)) for f, x in page_text.PRIOR.items()}
LONG = "This is a long sentence of the article that goes on for more than a dozen words, as prose does."


def price(cost, links, label):
    return sum(abs(c) for c, content in zip(cost, label) if content != (c >= 0) and c) + sum(c for a, b, c in links if label[a] != label[b])


def test_cut_is_least_of_all_labellings():
    rnd = random.Random(5)
    for _ in range(800):
        n = rnd.randint(1, 8)
        cost = [rnd.randint(-9, 9) for _ in range(n)]
        links = [(a, b, rnd.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.4]
        best = min((price(cost, links, x), -sum(x)) for x in itertools.product((False, True), repeat=n))
        got = page_text.cut(cost, links)
        assert (price(cost, links, got), -sum(got)) == best


def test_cut_of_long_chains():
    rnd = random.Random(6)
    cost = [rnd.randint(-900, 900) for _ in range(20000)]
    links = [(i, i + 1, 1000) for i in range(19999)]
    keep, drop = 0, 0  # the least price of all labellings so far whose last block is kept, or dropped
    for i, c in enumerate(cost):
        cross = 1000 if i else 0
        keep, drop = min(keep, drop + cross) + max(-c, 0), min(drop, keep + cross) + max(c, 0)
    assert price(cost, links, page_text.cut(cost, links)) == min(keep, drop)


@pytest.mark.parametrize(("source", "text"), [
    (f"<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p><b>Short<br><p>{LONG}</p></article><footer>&copy; x</footer>", f"A & B\nShort\n{LONG}"),
    (f"<script>var a='<p>no</p>'</script><style>p{{}}</style><title>T &lt;</title><main><p>{LONG}</p><!-- <p>no</p> --><aside>Other things to read</aside><p>End.</p></main>", f"{LONG}\nEnd."),
    (f'<div class="site-header"><a href=/>Logo</a></div><div id="content"><p>{LONG}</p><div class="adBox">Buy now!</div><p>B</p></div><div class="sidebar"><p>{LONG}</p></div>', f"{LONG}\nB"),
    (f'<article><p>{LONG}</p></article><section id="comments"><article><p>{LONG} I agree.</p></article></section>', LONG),
    (f'<form><label>Name</label><input><button>Send</button></form><div class="cookie-notice">We use cookies, as you know.</div><article><header><h1>Title</h1></header><p>{LONG}</p></article>', f"Title\n{LONG}"),
    (f'<div class="page-with-sidebar"><article><p>{LONG}</p><p>{LONG}</p></article><div role="complementary">More</div></div>', f"{LONG}\n{LONG}"),
    ("<article><p>a\n\t b&nbsp;c &#233;&#x4e2d;&amp</p><p>5 < 6 & <i>7</i>></p><ul><li>x<li>y</ul></article>", "a b c é中&\n5 < 6 & 7>\nx\ny"),
    (f"<article><p>{LONG}</p><table><tr><td>1<td>2<tr><td>3</table><pre>x\n y</pre><svg><text>no</text></svg><p hidden>no</p></article>", f"{LONG}\n1\n2\n3\nx y"),
    (f"<article><p>{LONG}<p>{LONG}", f"{LONG}\n{LONG}"), ("", ""), ("<nav>a</nav>", ""), ("<", ""), (f"{LONG} < 5", f"{LONG} < 5"),
])
def test_pages(source, text):
    assert page_text.main_text(source, ODDS)[0] == text


def test_neighbours_decide_for_what_shows_nothing():
    page = page_text.Page(f"<div><p>{LONG}</p><p>Hm, well</p><p>{LONG}</p></div>")
    cost = page_text.costs(page, ODDS)
    weak = [cost[0], -300, cost[2]]
    assert page_text.cut(weak, page_text.edges(page)) == [True, True, True]
    assert page_text.cut(weak, []) == [True, False, True]


def test_hostile_markup():
    for source in ("<div>" * 20000 + "x", "<p>" * 20000, "</div>" * 20000, "<li>" * 20000 + "x", "<a b='" * 5000, "<!--" * 5000, "<script>" * 5000, "&amp" * 50000, "<p title=\"" * 3000 + ">x", "x" * 10**6):
        page_text.main_text(source, ODDS)


def test_extract(spark):
    rows = [(i, f"u{i}", f"<nav><a>m{i}</a></nav><article><p>{LONG} {i}</p></article><footer>&copy;</footer>", "x", 1) for i in range(30)]
    rows += [(40, None, None, None, 0), (41, "u", "", "t", 0), (None, "u", "<article>n</article>", "t", 0), (3, "u3", rows[3][2], "x", 1)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(4)).collect()
    want = [(i, u, f"{LONG} {i}") for i, u, _, _, _ in rows[:30]] + [(40, None, ""), (41, "u", ""), (None, "u", "n"), (3, "u3", f"{LONG} 3")]
    assert sorted(map(repr, ((r.page_id, r.url, r.text, r.n_chars) for r in got))) == sorted(map(repr, ((*w, len(w[2])) for w in want)))
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_evidence_is_learned_from_named_blocks(spark):
    page = "<nav>" + "<p><a>Menu entry of words</a></p>" * 30 + "</nav><article>" + f"<p>{LONG}</p>" * 30 + "</article>"
    odds = page_text.evidence(spark.createDataFrame([(page,)], "html string"))
    assert odds["links 3"] < -1 < 1 < odds["words 13"]
