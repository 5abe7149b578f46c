import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import urlrules

PAGES, LABELS = "page_id long, url string, host string, good string", "page_id long, good boolean"


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "https://example.org/es/1", "https://x.example.org/es/", "https://example.org/en/123", "https://example.org/en/2", "https://notexample.org/es/1", "ftp://com/fr/1", "http://a.com/fr/?q",
    "http://a.com/fr?x", "http://a.com/de/1#y", "http://a.com?x=/de/", "http://a.com#/de/", "http://a.net/p", "x://y://z/w", "http://É.com/de/", "http://com/de/\n1", "://org/1",
]


def test_rules_against_plain_python(spark):
    pages = spark.createDataFrame([(i, u, "h", "g") for i, u in enumerate(URLS)], PAGES)
    got = {r.page_id: r for r in urlrules.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    for i, u in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path) == split(u), u
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and r.verdict == (verdict or "allow"), u


def test_pages(spark, tiny):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    got = urlrules.op9(spark, tiny).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r.page_id])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and r.verdict == (verdict or ("block" if r.purity < urlrules.MIN_PURITY else "allow"))


def tree(spark, rows):
    """Template and purity by url, from (url, good labels, bad labels)."""
    pages, labels = [], []
    for url, good, bad in rows:
        for g in [True] * good + [False] * bad + [None]:
            pages.append((len(pages), url, "", ""))
            if g is not None:
                labels.append((len(pages) - 1, g))
    got = urlrules.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS)).collect()
    return {r.host + r.path: r for r in got}


def test_variable_segments_become_wildcards(spark):
    rows = [(f"http://h/item/{k}", 1, 0) for k in range(5)] + [(f"http://h/tag/name{chr(97 + k)}x", 1, 0) for k in range(25)] + [("http://h/spam/page", 0, 60)]
    got = tree(spark, rows)
    assert {got[f"h/item/{k}"].template for k in range(5)} == {got["h/item/0"].template}
    assert got["h/tag/nameax"].template == got["h/tag/namebx"].template
    assert got["h/spam/page"].template != got["h/item/0"].template
    assert got["h/spam/page"].verdict == "block" and got["h/item/0"].verdict == "allow"


@pytest.mark.parametrize("siblings", [20, 21, 60])
def test_a_bad_section_is_blocked_among_any_number_of_siblings(spark, siblings):
    rows = [(f"http://h/s{chr(97 + k // 26)}{chr(97 + k % 26)}/1", 10, 0) for k in range(siblings - 1)] + [("http://h/bad/1", 0, 60)]
    got = tree(spark, rows)
    assert got["h/bad/1"].verdict == "block" and got["h/saa/1"].verdict == "allow"
    assert len({r.template for r in got.values()}) == 2


def test_similar_branches_merge_and_unlike_ones_do_not(spark):
    got = tree(spark, [("http://h/a/x", 40, 2), ("http://h/b/x", 38, 2), ("http://h/c/x", 2, 60)])
    assert got["h/c/x"].template != got["h/a/x"].template
    assert got["h/c/x"].purity < urlrules.MIN_PURITY < got["h/a/x"].purity
    even = tree(spark, [("http://k/a/x", 40, 2), ("http://k/b/x", 38, 2)])
    assert even["k/a/x"].template == even["k/b/x"].template


def test_purity_is_smoothed(spark):
    got = tree(spark, [("http://h/p/x", 200, 0), ("http://g/q/x", 0, 1)])
    share = 200 / 201
    assert got["g/q/x"].purity == pytest.approx(urlrules.PRIOR * share / (urlrules.PRIOR + 1)) and got["g/q/x"].verdict == "allow"


def test_empty_repeated_and_deep(spark):
    none = spark.createDataFrame([], LABELS)
    assert urlrules.judge(spark.createDataFrame([], PAGES), none).count() == 0
    deep = "http://h/" + "/".join("abcdefghijkl")
    df = spark.createDataFrame([(1, deep, "", ""), (1, deep, "", ""), (2, deep + "x" * 5000, "", ""), (None, deep, "", "")], PAGES)
    got = urlrules.judge(df, none).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "http://h/en/7.html?x=1", "", ""), (2, "http://h/en/8/", "", ""), (3, "http://h/en/9#top", "", ""), (4, "http://h/en", "", ""), (5, None, "", ""), (6, "http://h/10", "", "")], PAGES)
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 1), (10, 1, None), (10, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.good for r in urlrules.page_labels(pages, labels).where(F.col("page_id").isNotNull()).collect()}
    assert got == {1: True, 2: False, 3: False, 6: True}


def test_tree_against_plain_python(spark):
    """Wildcards, merges and purities of random paths, each step by loops over all pages."""
    rng = random.Random(3)
    rows = []
    for host in ("h", "k"):
        for _ in range(160):
            first = rng.choice(["news", "blog", "shop", "spam", f"u{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"])
            path = [first, *(rng.choice(["a", "b", "1", f"x{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"]) for _ in range(rng.randrange(0, 9)))]
            label = None if rng.random() < 0.4 else rng.random() < (0.1 if first == "spam" else 0.9)
            rows.append((host, "/".join(path), label))
    lexical = [(h, tuple("*" if re.search("[0-9]", s) else s for s in p.split("/")), g) for h, p, g in rows]
    now = {(h, t): list(t) for h, t, _ in lexical}

    def level(d):
        groups = {}
        for h, t, g in lexical:
            x = now[h, t]
            if len(x) >= d:
                child = groups.setdefault((h, tuple(x[: d - 1])), {}).setdefault(x[d - 1], [0, 0, 0])
                child[0] += 1
                child[1] += g is True
                child[2] += g is False
        return groups

    def alike(child, kids):
        n, good = child[1] + child[2], sum(c[1] for c in kids.values())
        m = sum(c[1] + c[2] for c in kids.values())
        others, p = m - n, good / max(m, 1)
        error = (p * (1 - p) * (1 / max(n, 1) + 1 / max(others, 1))) ** 0.5
        return n, others, abs(child[1] / max(n, 1) - (good - child[1]) / max(others, 1)) <= urlrules.SIMILAR * error

    def change(d, groups, what, by):
        picked = {(key, s) for key, kids in groups.items() for s, c in kids.items() if what(c, kids)}
        for (h, _), x in now.items():
            if len(x) >= d and ((h, tuple(x[: d - 1])), x[d - 1]) in picked:
                x[d - 1] = by

    def wild(c, kids):
        n, others, same = alike(c, kids)
        varied = sum(k[0] == 1 for k in kids.values()) >= urlrules.NEW_SHARE * sum(k[0] for k in kids.values())
        return len(kids) > 1 and varied and not (n >= urlrules.ENOUGH and others and not same)

    def merge(c, kids):
        n, others, same = alike(c, kids)
        return len(kids) > 1 and (not n or not others or same)

    d = 0
    while any(n > 1 for n in Counter((h, tuple(x[:d])) for (h, _), x in now.items() if len(x) > d).values()):
        d += 1
        change(d, level(d), wild, "*")
    for k in range(d, 0, -1):
        change(k, level(k), merge, "~")
    sums = {}
    for h, t, g in lexical:
        s = sums.setdefault((h, "/".join(now[h, t])), [0, 0])
        s[0] += g is True
        s[1] += g is False
    share = sum(s[0] for s in sums.values()) / sum(sum(s) for s in sums.values())
    pages = spark.createDataFrame([(i, f"http://{h}/{p}", "", "") for i, (h, p, _) in enumerate(rows)], PAGES)
    labels = spark.createDataFrame([(i, g) for i, (_, _, g) in enumerate(rows) if g is not None], LABELS)
    got = {r.page_id: r for r in urlrules.judge(pages, labels).collect()}
    for i, (h, t, _) in enumerate(lexical):
        template = "/".join(now[h, t])
        good, bad = sums[h, template]
        purity = (good + urlrules.PRIOR * share) / (good + bad + urlrules.PRIOR)
        assert got[i].template == template and got[i].purity == pytest.approx(purity)
        assert got[i].verdict == ("block" if purity < urlrules.MIN_PURITY else "allow")
    assert len({r.template for r in got.values()}) > 5
