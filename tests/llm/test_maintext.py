"""Main text: planted pages, the generated pages by their known article, the cut by brute force."""

import html
import random
import re
import time
from itertools import product
from math import exp, log1p

import pytest

from gapscope.llm import catalog, maintext

SF = "/root/testdata/sf0.01"


def known(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in out if b)


def test_query_on_generated_pages(spark):
    got = {r.page_id: r for r in catalog.QUERIES["op6_min_cut_text"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == known(p.html) and got[p.page_id].n_chars == len(known(p.html)) and got[p.page_id].url == p.url


LONG = "The committee met on Tuesday and agreed, after a long debate, to publish the whole report before the end of the month."
MORE = "Nobody had expected that outcome; the chair said as much in a short statement to the press."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
SIDE = f'<aside class="sidebar"><h3>Most read</h3><p><a href="/x">{MORE}</a></p></aside>'
FOOT = "<footer>&copy; 2024 Example. All rights reserved.</footer>"
COMMENTS = f'<section id="comments"><h3>Comments</h3><div class="comment"><p>{MORE} I disagree entirely with it.</p></div></section>'


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("<script>var a = '<p>no</p>';</script>", ""),
    (f"{LONG}", LONG),
    (f"<body><header><h1>Site</h1></header>{MENU}<article><h1>Report</h1><p>{LONG}</p><p>Short.</p><p>{MORE}</p></article>{SIDE}{FOOT}</body>",
     f"Report\n{LONG}\nShort.\n{MORE}"),
    (f'{MENU}<div class="cookie-notice"><p>{MORE} We use cookies.</p></div><div id="content"><h2>Report</h2><p>{LONG}<p>{MORE}<div class="ad">Buy now, it is cheap today.</div><p>{LONG}</div>{FOOT}',
     f"Report\n{LONG}\n{MORE}\n{LONG}"),
    (f'<main><p>{LONG}</p><form><label>Your name</label><button>Send it now</button></form><p>{MORE}</p>{COMMENTS}</main>', f"{LONG}\n{MORE}"),
    (f'<body class="page has-sidebar"><div class="post"><p>{LONG}</p><ul><li>First point of it</li><li>Second point of it</li></ul><p>{MORE}</p></div>{SIDE}</body>',
     f"{LONG}\nFirst point of it\nSecond point of it\n{MORE}"),
    (f"<article><p>Caf&eacute; &amp; bar&nbsp;&#8212; a<b>b</b>c <i>d</i>\n\t e<br>f. {LONG}</p><!-- <p>no</p> --><style>p{{}}</style></article>", f"Café & bar — abc d e f. {LONG}"),
    (f"<article><p style='display: none'>{MORE}</p><p>{LONG}</p><table><tr><td>One cell here<td>Two cells here</table></article>", f"{LONG}\nOne cell here\nTwo cells here"),
])
def test_planted_pages(page, want):
    assert maintext.main_text(page) == want


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_by_brute_force(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    scores = [r.uniform(-3, 3) for _ in range(n)]
    links = {(i, j): r.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
    cost = lambda side: sum(log1p(exp(-s)) if k else log1p(exp(s)) for s, k in zip(scores, side)) + sum(c for (i, j), c in links.items() if side[i] != side[j])
    assert cost(maintext.minimum_cut(scores, links)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p" * 2000, "x"), (2, "u", "<p" * 2000, "x"), (3, "u", "<div>" * 3000 + LONG, "x"),
            (4, "u", f"<p>{LONG}</p>" * 800, "x"), (5, "u", "</div></p></body><b><i></b>" + LONG, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in maintext.extract(pages).collect()))
    assert len(got) == 7 and got[0][1] == "" and got[1][1] == "" and got[4][1] == LONG and got[5][1] == "\n".join([LONG] * 800) and got[6][1] == LONG
    assert maintext.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("size", [70_000, 5_000_000])
@pytest.mark.parametrize("sign", ['"', "'"])
def test_attribute_values_of_any_length(size, sign):
    value = ("iVBORw0KGgo>/+<" * (size // 15 + 1))[:size]
    image = f"<img alt={sign}{sign} src={sign}data:image/png;base64,{value}{sign}>"
    page = f"{MENU}<div data-state={sign}{value}{sign} class=content><p>{LONG}</p>{image}<p>{MORE}</p></div><div data-x={sign}{value}{sign} class=sidebar><p>{LONG}</p></div>{FOOT}"
    assert maintext.main_text(page) == f"{LONG}\n{MORE}"
    assert maintext.main_text(f"<article><p>{LONG} {image}</p></article>") == LONG


@pytest.mark.parametrize("seed", range(200))
def test_tag_ends_by_plain_pattern(seed):
    plain = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>""")
    r = random.Random(seed)
    page = "".join(r.choices(["<i", "</b", '"', "'", " ", ">", "<", "x=", "y" * 201], k=r.randint(1, 150)))
    want, got, look, dead = [m.span() for m in plain.finditer(page)], [], 0, set()
    while m := maintext._TOKEN.search(page, look):
        stop = m.end() if page[m.end() - 1] == ">" else maintext._tag_end(page, m.end(), dead)
        look = max(m.end(), stop)
        if stop > 0:
            got.append((m.start(), stop))
    assert got == want


@pytest.mark.parametrize("page", ['<a "' + 'x<b" "' * 100_000 + "<", '<a x="' + "<a '" * 100_000, "<a b='" * 100_001, '<p"' * 100_000, "<p x='\">" * 50_001, '<a "' + '<b" "' * 50_000 + '\'<c "' * 50_000])
def test_open_quotes_in_linear_time(page):
    start = time.process_time()
    maintext.main_text(page)
    assert time.process_time() - start < 10


ARTICLE = "<p>The council met on Monday and agreed to build the bridge.</p><p>Work starts in May.</p>"
WANT = "The council met on Monday and agreed to build the bridge.\nWork starts in May."
COMMENT = "<p>I do not agree with this at all, it costs too much money, says reader number one here.</p>"


@pytest.mark.parametrize("page", [
    f"<body><article>{ARTICLE}</article><section class=comments>{COMMENT * 20}</section></body>",
    f"<body><div id=main>{ARTICLE}</div><div id=comments>{COMMENT * 20}</div></body>",
    f"<body><article>{ARTICLE}</article>" + f'<article class="comment">{COMMENT}</article>' * 20,
    f'<body><article>{ARTICLE}<div class="comment-list">{COMMENT * 20}</div></article>',
    f'<body><nav><a href=a>Home</a></nav><div class="post share">{ARTICLE}</div></body>',
    f'<body class="has-sidebar"><div class="search"><article>{ARTICLE}</article></div></body>'])
def test_comments_go_whatever_their_share_and_the_main_part_stays(page):
    assert maintext.main_text(page) == WANT


def test_words_of_scripts_without_blanks():
    lines = ["市议会星期一开会，同意建造新的大桥，工程将于五月开始，预计两年完成。", "居民对此表示欢迎，他们认为交通会更加方便，也会带来更多的就业机会。"]
    page = "<body><div id=menu><a href=a>首页</a> <a href=b>新闻</a></div>" + "".join(f"<p>{x}</p>" for x in lines)
    assert maintext.main_text(page) == "\n".join(lines)


@pytest.mark.parametrize("page", ["<body>" + (ARTICLE + "<p><a href=x>link</a></p>") * 45_000, "<div>a " * 700_000,
                                  "<div>a " * 350_000 + "</div>b " * 350_000], ids=["pairs", "deep", "closed"])
def test_pages_of_five_megabytes(page):
    import time
    start = time.time()
    assert len(page) > 4_500_000 and isinstance(maintext.main_text(page), str)
    assert time.time() - start < 60


def test_cut_value_against_all_labellings_of_random_graphs():
    import itertools
    import random
    r = random.Random(8)
    for _ in range(60):
        n = r.randint(2, 8)
        scores = [r.uniform(-3, 3) for _ in range(n)]
        links = {(i, j): r.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        cost = lambda kept: sum(abs(s) for s, k in zip(scores, kept) if k != (s > 0)) + sum(c for (i, j), c in links.items() if kept[i] != kept[j])
        got = cost(maintext.minimum_cut(scores, links))
        assert got == pytest.approx(min(cost(k) for k in itertools.product((False, True), repeat=n)), abs=1e-6)
