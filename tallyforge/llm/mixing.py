"""Mixing sources to target weights by systematic sampling, with DataFrame functions alone.

Sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share all words; no target exceeds CAP times its
source's words, and what that leaves over is shared among the others by weight (water filling, in closed form over the
table of sources). A document's expected copies are its source's target / size. Within a source, documents stand in the
order of their size; over that order the expected copies are summed up from one random offset, and a document is emitted
once for each integer its step crosses. As the order is by size, the words taken differ from the target by about one
document.

No source is ever in one task: the sum over a source is that of its distinct sizes (one row each), plus that of SALTS
groups of equal documents, plus the rank within such a group. The offset is an MD5 of seed and source, so reruns agree.

Defined cases: a null or empty text has size 0; a source without words has target 0 and its documents are not taken;
equal documents are ordered by id (rows equal in id too are interchangeable, each is sampled); an empty table gives none.
Columns of docs may have any names: rows are carried whole, apart from what is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import n_words, persist, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: Equal sizes of a source are dealt over so many groups, by the first byte of an MD5.
SALTS = 256
SEED = "mix"


def targets(sources: DataFrame) -> DataFrame:
    """(_key, _words) with each source's _target; one row per source on either side.

    In the order of words / weight, level k = (all words - caps before k) / (weights from k on). It rises as long as
    sources stop at their caps and falls from then on, so its maximum is the level at which the water stands.
    """
    by_name, by_ratio = Window.orderBy("_key"), Window.orderBy("_ratio", "_key")
    out = sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")))
    out = out.withColumn("_ratio", F.col("_words") / F.col("_weight"))
    every = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("_words").over(every) - CAP * F.coalesce(F.sum("_words").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("_level", left / F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    target = F.least((CAP * F.col("_words")).cast("double"), F.col("_weight") * F.max("_level").over(every))
    return out.withColumn("_target", target).select("_key", "_words", "_target")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with _key (of the source; null sorts last), _size and _salt."""
    salt = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int")
    return docs.withColumns({"_key": F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))), "_size": n_words(F.col(text_col)), "_salt": salt})


def offsets(rows: DataFrame) -> DataFrame:
    """For each group (_key, _size, _salt): the documents of its source before it (_before), _words, _target and _u."""
    groups = rows.groupBy("_key", "_size", "_salt").agg(F.count("*").alias("_n"))
    sizes = groups.groupBy("_key", "_size").agg(F.sum("_n").alias("_n"))
    sources = targets(sizes.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).alias("_words")))
    run = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_smaller", run(Window.partitionBy("_key").orderBy("_size"))).drop("_n").join(sources, "_key")
    groups = groups.withColumn("_peers", run(Window.partitionBy("_key", "_size").orderBy("_salt"))).drop("_n")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.col("_key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return groups.join(sizes, ["_key", "_size"]).select("_key", "_size", "_salt", (F.col("_smaller") + F.col("_peers")).alias("_before"), "_words", "_target", u.alias("_u"))


def with_copies(rows: DataFrame, plan: DataFrame, id_col: str) -> DataFrame:
    """rows with _copies, _words and _target."""
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_size", "_salt").orderBy(id_col))
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(F.lit(0.0))
    crossed = lambda k: F.floor(F.col("_u") + F.col("_rate") * k)
    # A merge join: rows are dealt by these columns for their rank anyway, and the plan takes far more memory in the driver than in its file.
    out = rows.join(plan.hint("merge"), ["_key", "_size", "_salt"]).withColumns({"_rank": rank, "_rate": rate})
    return out.withColumn("_copies", (crossed(F.col("_rank")) - crossed(F.col("_rank") - 1)).cast("int"))


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes from it."""
    rows = persist(keyed(docs.select(F.col(id_col), text_col, source_col), id_col, text_col, source_col).drop(text_col, source_col), "mix-sizes")
    out = with_copies(rows, offsets(rows), id_col)
    return out.select(id_col, F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with its columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    rows = keyed(whole, "_id", "_text", "_source").drop("_text", "_source")
    plan = persist(offsets(rows.select("_key", "_size", "_salt")), "mix-offsets")
    taken = with_copies(rows, plan, "_id").where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def op6(spark, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents"))


#: The same by one ranking per source.
OP6_SQL = r"""
WITH s AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 2))::INT AS salt
  FROM documents),
src AS (SELECT k, sum(size)::BIGINT AS words FROM s GROUP BY k),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS weight FROM src),
l AS (SELECT *, (sum(words) OVER () - 3 * COALESCE(sum(words) OVER (ORDER BY words / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (ORDER BY words / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT k, words, least((3 * words)::DOUBLE, weight * max(level) OVER ()) AS target,
             ('0x' || substr(md5('mix' || k), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT doc_id, size, words, target, u, CASE WHEN words > 0 THEN target / words ELSE 0.0::DOUBLE END AS rate,
             row_number() OVER (PARTITION BY k ORDER BY size, salt, doc_id) AS n FROM s JOIN t USING (k))
SELECT doc_id, size, words AS source_size, target,
       ((floor(u + rate * n) - floor(u + rate * (n - 1)))::BIGINT * size)::BIGINT AS taken FROM r
"""
