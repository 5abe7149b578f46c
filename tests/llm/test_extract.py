import random

import pytest

from tallyforge.llm import extract
from tallyforge.llm.extract import blocks_of, common

PAGES = "page_id long, url string, html string, text string, host string"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)
    return {r.page_id: r for r in extract.extract(df).collect()}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>one  two\n three</p><p>four</p>", "one two three\nfour"),
        ("plain &amp; simple &lt;b&gt; &#233; &nbsp;x", "plain & simple <b> é x"),
        ("<nav>menu</nav><article><h1>T</h1><p>a<b>b</b>c</article><footer>f</footer>", "T\nabc"),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> -->", "x"),
        ("<div class='ad banner'>buy<div>more</div></div><div>keep</div>", "keep"),
        ("<div id=comments><p>me too</p></div><p>keep</p>", "keep"),
        ("<form><input><button>go</button></form><p>keep", "keep"),
        ("<article><header>kept title</header><p>x</p></article>", "kept title\nx"),
        ("<header>site</header><p>x</p>", "x"),
        ("<p>open <a href='x>y'>link</a> end", "open link end"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p title=\"a>b\">x</p>", "x"),
        ("", ""),
        ("<script>never closed", ""),
    ],
)
def test_blocks(html, text):
    assert "\n".join(t for t, _ in blocks_of(html)) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html><head><title>t</title><script>'<p>'</script><body><p>x", "x"),
        ("<head><title>t</title><meta a=b><p>x</p>", "x"),
        ("<head><title>t</title>plain", "plain"),
        ("<nav>menu<article><p>x</p></article>", "x"),
        ("<form><input><main><p>x</p></main>", "x"),
        ("<aside>open<body><p>x</p>", "x"),
        ("<div class='content with-sidebar'><p>x</p></div>", "x"),
        ("<div id='comments-enabled-post'><p>x</p></div>", "x"),
        ("<article><div class='article-header'><h1>T</h1></div><p>x</p></article>", "T\nx"),
        ("<div class='site-header'>s</div><p>x</p>", "x"),
        ("<article><p>Body one</p></article><div id=comments><article class=comment>reader says</article></div>", "Body one"),
        ("<article><p>Body one</p><article class=comment>reader says</article><p>two</p></article>", "Body one\ntwo"),
        ("<article>a</article><div class=related><article>teaser</article></div><p>b</p>", "a\nb"),
        ("<article><p class=ad>Buy<p>Real text one</p><p>Real two</p></article>", "Real text one\nReal two"),
        ("<article><h1 class='article-header'>T</h1><p class='menu-of-the-day'>Soup</p></article>", "T\nSoup"),
        ("<ul><li class=ad>Buy<li>one<ul><li>two</ul><li>three</ul>", "one\ntwo\nthree"),
        ("<article><div class=ad>Buy<p>one</p><p>two</p></article>", "one\ntwo"),
        ("<aside><article>teaser</article></aside><article>own</article>", "own"),
        ("<b>bold<p>one</b> more</p><p>two", "bold\none more\ntwo"),
        ("<table><tr><td class=ad>Buy<td>cell<tr><td>next</table>", "cell\nnext"),
    ],
)
def test_ordinary_raw_pages_keep_their_text(html, text):
    assert "\n".join(t for t, _ in blocks_of(html)) == text


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.choice("abcd") for _ in range(rng.randrange(12))], [rng.choice("abcde") for _ in range(rng.randrange(12))]
        length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
        found = sorted(common(a, b))
        assert len(found) == length[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_lines_shared_with_the_nearest_page_go(spark):
    page = lambda k: f"<div>Home</div><div>Sections</div><div>Story {k} begins</div><div>It ends {k}</div><div>All rights reserved</div>"
    got = run(spark, [(k, f"http://h.example/{k}", page(k)) for k in range(6)] + [(9, "http://other.example/0", page(9))])
    assert all(got[k].text == f"Story {k} begins\nIt ends {k}" for k in range(6))
    assert got[9].text.startswith("Home\n")  # alone on its host


def test_articles_keep_shared_passages_and_copies_are_not_held_against_each_other(spark):
    page = lambda k: f"<div>Home</div><article><p>Common passage.</p><p>Own {k}</p></article>"
    got = run(spark, [(1, "http://h/a", page(1)), (2, "http://h/b", page(2)), (3, "http://c/a", "<p>same</p><p>text</p>"), (4, "http://c/b", "<p>same</p><p>text</p>")])
    assert got[1].text == "Common passage.\nOwn 1"
    assert got[3].text == got[4].text == "same\ntext"


def test_odd_rows(spark):
    long = "<p>" + "word " * 100_000 + "</p>"
    got = run(spark, [(1, None, None), (2, None, ""), (3, "no scheme", "<p>x</p>"), (4, "http://h/p", long), (5, "http://h", "text")])
    assert (got[1].text, got[1].n_chars, got[2].text) == ("", 0, "")
    assert got[3].text == "x" and got[3].url == "no scheme"
    assert got[4].n_chars == len(("word " * 100_000).strip())
    assert run(spark, []) == {}


def test_repeated_rows_and_a_hot_path(spark, monkeypatch):
    monkeypatch.setattr(extract, "BLOCK", 4)
    df = spark.createDataFrame([(i % 30, "http://hot/same", f"<article>own {i % 30}</article>", "", "") for i in range(60)], PAGES)
    got = extract.extract(df).collect()
    assert len(got) == 60 and all(r.text == f"own {r.page_id}" for r in got)


def test_shared_lines_decide_inside_articles_too(spark):
    page = lambda k: f"<div>Menu</div><div>Aside {k}</div><article><p>Own {k}</p><p>Passage {k // 2}</p><p>Also {k}</p><p>Please donate</p></article>"
    got = run(spark, [(k, f"http://h/{k}", page(k)) for k in range(8)] + [(9, "http://alone/x", page(9))])
    assert all(got[k].text == f"Aside {k}\nOwn {k}\nPassage {k // 2}\nAlso {k}" for k in range(8))
    assert got[9].text == "Menu\nAside 9\nOwn 9\nPassage 4\nAlso 9\nPlease donate"


def test_near_copies_of_an_article_stay_whole(spark):
    page = lambda k: f"<article><p>One</p><p>Two</p><p>Three</p><p>Copy {k}</p></article>"
    got = run(spark, [(k, f"http://h/{k}", page(k)) for k in range(8)])
    assert all(got[k].text == f"One\nTwo\nThree\nCopy {k}" for k in range(8))


def test_order_holds_in_a_large_host_and_copies_look_further(spark, monkeypatch):
    monkeypatch.setattr(extract, "BLOCK", 4)
    page = lambda s, k: f"<p>Menu of {s}</p><p>Story {s} {k}</p>"
    rows = [(100 * s + k, f"http://large/{s:02}/{k:02}", page(s, k)) for s in range(40) for k in range(4)]
    rows += [(10_000 + k, f"http://copies/{k:03}", "<p>Site</p><p>Copied</p>" if 1 < k < 90 else f"<p>Site</p><p>Own {k}</p>") for k in range(92)]
    got = run(spark, rows)
    assert all(got[100 * s + k].text == f"Story {s} {k}" for s in range(40) for k in range(4))
    assert all(got[10_000 + k].text == ("Copied" if 1 < k < 90 else f"Own {k}") for k in range(92))


def test_pages_match_a_plain_reading(spark, tiny):
    from html.parser import HTMLParser

    blocks = {"p", "h1", "h2", "li", "ul", "article", "br"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts, self.out = 0, [], []

        def flush(self):
            if t := " ".join("".join(self.parts).split()):
                self.out.append(t)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            if tag in blocks:
                self.flush()
            self.inside += tag == "article"

        def handle_endtag(self, tag):
            if tag in blocks:
                self.flush()
            self.inside -= tag == "article"

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = extract.op3(spark, tiny).collect()
    assert len(got) == len(pages)
    for r in got:
        reader = Reader()
        reader.feed(pages[r.page_id] or "")
        reader.close()
        assert r.text == "\n".join(reader.out) and r.n_chars == len(r.text)


def test_pages_without_article_against_brute_force(spark, monkeypatch):
    """Pairing by URL, alignment and deletion by plain Python on the blocks of each page."""
    monkeypatch.setattr(extract, "BLOCK", 5)
    rng, rows = random.Random(11), []
    for host in ("a", "b", "c"):
        for k in range(rng.randrange(15, 40)):
            section = k // 6
            own = [f"{host} {k} {i} {rng.random()}" for i in range(rng.randrange(0, 4))]
            lines = ["Home", f"Section {section}", *own, rng.choice(["Also read", "Subscribe now"]), "Imprint"]
            if rng.random() < 0.2:
                lines = ["Home", "Out of order", "Imprint"]
            rows.append((len(rows), f"http://{host}/{section:02}/{k:03}", lines))
    order = sorted(rows, key=lambda r: r[1])

    def lcs(a, b):
        best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + (a[i],) if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j], key=len)
        return best[-1][-1]

    want = {}
    for at, (i, url, lines) in enumerate(order):
        gone = set()
        for step in (-1, 1):
            k = at + step
            while 0 <= k < len(order) and order[k][2] == lines:
                k += step
            if 0 <= k < len(order) and order[k][1][:9] == url[:9]:
                found = lcs(lines, order[k][2])
                if not (len(found) in (len(lines), len(order[k][2])) and len(found) > 1):
                    gone |= set(found)  # lines of a page differ from each other
        want[i] = "\n".join(x for x in lines if x not in gone)
    got = run(spark, [(i, u, "".join(f"<div>{x}</div>" for x in lines)) for i, u, lines in rows])
    assert {i: r.text for i, r in got.items()} == want
