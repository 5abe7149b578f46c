"""URL filters: explicit host and path rules, and a path-template tree for what they leave.

Per host, paths become templates: segments with a digit are variable. From the first level down, the segments under a parent
become one wildcard if they vary: if by the Good-Turing estimate, the share of pages whose segment no other page has, the
next page would bring a new segment in at least NEW_SHARE of cases. Segments with ENOUGH labels whose share of good ones
differs from that of their siblings stay out of the wildcard. From the deepest level up, sibling branches whose share of good labelled pages
does not differ from that of the other siblings at SIMILAR standard errors are merged. A template's purity is its
share of good labels, smoothed by PRIOR pages of the overall share; below MIN_PURITY it is blocked.

All of it is grouping and joining with DataFrame functions: pages are first summed up to their (host, template) pairs, so a
hot host is one row for each of its templates.

Defined cases: a null url or one without ``://`` has an empty host and path; templates without labels get the overall
purity; paths may have any number of segments, and levels below the last that two paths share are left as they are; without
any label nothing is blocked by the tree; repeated rows are judged
alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_persisted, persist, table

#: (host, path prefix, verdict); a rule holds for its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
NEW_SHARE = 0.5
ENOUGH = 5
SIMILAR = 1.96
PRIOR = 10.0
MIN_PURITY = 0.5
WILD, MERGED = "*", "~"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, _URL, 2)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def by_rules(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The path's segments, with a wildcard for those that hold a digit."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.when(s.rlike("[0-9]"), F.lit(WILD)).otherwise(s))


def _at(depth: int) -> tuple[Column, Column]:
    """The parent and the segment of a level."""
    return F.array_join(F.slice("t", 1, depth - 1), "/").alias("parent"), F.element_at("t", depth).alias("seg")


def _replaced(depth: int, by: str) -> Column:
    return F.concat(F.slice("t", 1, depth - 1), F.array(F.lit(by)), F.slice("t", F.lit(depth + 1), F.size("t")))


def _step(tree: DataFrame, changed: DataFrame, on: list[str], depth: int, by: str) -> DataFrame:
    """tree with the segment of this level replaced where changed says so."""
    parent, seg = _at(depth)
    keyed = tree.withColumns({"parent": F.when(F.size("t") >= depth, parent), "seg": F.when(F.size("t") >= depth, seg)})
    out = keyed.join(changed.withColumn("yes", F.lit(True)), on, "left").withColumn("t", F.when(F.col("yes"), _replaced(depth, by)).otherwise(F.col("t")))
    out = persist(out.select("host", "lexical", "t", "pages", "good", "bad"), "url-tree")
    drop_persisted(tree)
    return out


def _children(tree: DataFrame, depth: int) -> DataFrame:
    """Segments of a level, with the number of siblings and whether they vary, the labels of each and of its siblings, and whether their shares are alike."""
    children = tree.where(F.size("t") >= depth).groupBy("host", *_at(depth)).agg(F.sum("pages").alias("p"), F.sum("good").alias("g"), F.sum("bad").alias("b"))
    varied = F.count_if(F.col("p") == 1) >= NEW_SHARE * F.sum("p")
    rest = children.groupBy("host", "parent").agg(F.sum("g").alias("gs"), F.sum("b").alias("bs"), F.count("*").alias("n"), varied.alias("varied"))
    n, m = F.col("g") + F.col("b"), F.col("gs") + F.col("bs")
    others, p = m - n, F.col("gs") / F.greatest(m, F.lit(1))
    error = F.sqrt(p * (1 - p) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    apart = F.abs(F.col("g") / F.greatest(n, F.lit(1)) - (F.col("gs") - F.col("g")) / F.greatest(others, F.lit(1)))
    return children.join(rest, ["host", "parent"]).select("host", "parent", "seg", "n", "varied", n.alias("labels"), others.alias("others"), (apart <= SIMILAR * error).alias("alike"))


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, lexical, template, purity) from pages (page_id, host, path) and labels (page_id, good)."""
    lexical = pages.select("page_id", "host", F.array_join(segments(F.col("path")), "/").alias("lexical"))
    seen = lexical.join(labels, "page_id", "left").groupBy("host", "lexical").agg(F.count("*").alias("pages"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    tree = persist(seen.withColumn("t", F.when(F.col("lexical") == "", F.array().cast("array<string>")).otherwise(F.split("lexical", "/"))).select("host", "lexical", "t", "pages", "good", "bad"), "url-tree")
    deepest = 0
    while not tree.where(F.size("t") > deepest).groupBy("host", _at(deepest + 1)[0]).count().where("count > 1").isEmpty():
        deepest += 1
        own = (F.col("labels") >= ENOUGH) & (F.col("others") > 0) & ~F.col("alike")
        tree = _step(tree, _children(tree, deepest).where((F.col("n") > 1) & F.col("varied") & ~own).select("host", "parent", "seg"), ["host", "parent", "seg"], deepest, WILD)
    for depth in range(deepest, 0, -1):
        similar = (F.col("n") > 1) & ((F.col("labels") == 0) | (F.col("others") == 0) | F.col("alike"))
        tree = _step(tree, _children(tree, depth).where(similar).select("host", "parent", "seg"), ["host", "parent", "seg"], depth, MERGED)
    sums = tree.groupBy("host", F.array_join("t", "/").alias("template")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    overall = sums.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    share = (overall["g"] or 0) / max(1, (overall["g"] or 0) + (overall["b"] or 0)) if (overall["g"] or 0) + (overall["b"] or 0) else 1.0
    purity = (F.col("good") + PRIOR * share) / (F.col("good") + F.col("bad") + PRIOR)
    named = tree.select("host", "lexical", F.array_join("t", "/").alias("template"))
    return named.join(sums.withColumn("purity", purity), ["host", "template"]).select("host", "lexical", "template", "purity")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_purity: float = MIN_PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for pages (page_id, url) and labels (page_id, good)."""
    url = F.col("url")
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    tree = templates(split, labels)
    name, verdict = by_rules(rules, F.col("host"), F.col("path"))
    out = split.withColumn("lexical", F.array_join(segments(F.col("path")), "/")).join(tree, ["host", "lexical"], "left")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") < min_purity, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): the label of the document that a page's path ends with the number of; good is quality 1, not toxic."""
    number = F.expr(r"try_cast(regexp_extract(url, '(?s)^.*?://[^?#]*/([0-9]{1,18})(?:\\.[a-z]+)?/?(?:[?#]|$)', 1) AS bigint)")
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) != 1)).alias("good"))
    return pages.select("page_id", number.alias("doc_id")).where("doc_id IS NOT NULL").join(known, "doc_id").groupBy("page_id").agg(F.min("good").alias("good"))


def op9(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, page_labels(pages, table(spark, sf_dir, "labels")))
