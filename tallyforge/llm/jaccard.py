"""N-gram Jaccard join by grouped prefixes: links of documents whose word 5-gram sets have a similarity of 0.8 or more.

1. Every text becomes the set of its shingles' 64-bit hashes. All sets are put in one order of shingles, rare ones first:
   by the number of documents counted in 2^SKETCH_BITS buckets over the whole corpus (a table of fixed size, the only
   thing sent to all executors), then by hash. Any common order gives right results; this one keeps frequent passages
   out of prefixes.
2. Documents with equal sets are one class, which is numbered; classes with an identical prefix and size are one group.
3. The prefix of a group (the shortest that must meet the prefix of any partner) is laid out by shingle; shingles of one
   class alone go. First each group is held against PIVOTS groups of each of its shingles, and each class against the
   first of its group: that finds most components. Then the groups of a shingle that are not all in one component are
   joined with each other; a pair of groups passes if sizes, positions and, for groups of one class, parity sketches of
   64 * MAP_WORDS bits leave room for a link and it has met at none of the last PREVIOUS shingles of both. Only then are
   groups expanded to classes, where pairs of one component go.
4. A pair of classes is held against longer parity sketches (two to four bits for each shingle), and what still may link is
   verified on the whole sets of its two texts. A bit of a sketch is the parity of the shingles that hash to it, so
   differing bits never exceed differing shingles.

Hashes have 64 bits, set signatures 128; nothing else is approximate. A shingle of many groups is dealt over tasks by
SPLIT groups; the other joins by hot keys are between two shuffled tables, which adaptive execution splits.

Defined cases: texts without words (or null) have no shingles, link with nothing and are components of their own; with
fewer than five words the whole sequence is the one shingle; rows that share an id are one document, of which each row
keeps its own number of shingles; a null id gets a null component. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import MIX, drop_persisted, free, only, persist, pieces, runs_of, table, word_hashes
from tallyforge.llm.components import components

SHINGLE = 5
#: Similarity of a link, as a fraction.
NUM, DEN = 80, 100
SKETCH_BITS, BLOCK_BITS = 22, 16
#: Up to so many ids are broadcast (24 bytes each) to fetch or drop rows of documents; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000
PIVOTS = 4
PREVIOUS = 4
MAP_WORDS = 8
#: Groups of a shingle that one task holds against the others.
SPLIT = 1000
#: Pairs of texts hashed at once.
PAIRS = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SET = ["n", "s1", "s2"]


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    starts, h, rows = word_hashes(LOWER[buf], off)
    cut = np.searchsorted(rows, np.arange(len(off)))
    key = np.zeros(max(0, len(h) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        key += h[k : len(h) - SHINGLE + 1 + k] * MIX[k]
    key = (key ^ (key >> np.uint64(29))) * MIX[8]
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(key[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(((h[a:b] * MIX[: b - a]).sum(keepdims=True) + np.uint64(b - a)) * MIX[9])
        else:
            out.append(key[:0])
    return out


def sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, buf, off in pieces(column):
        yield from shingle_sets(buf, off)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def document_counts(texts: DataFrame) -> np.ndarray:
    """For each bucket of shingles, 8 times the binary logarithm of its documents, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        only("jaccard")
        for batch in batches:
            for s in sets_of(batch.column(0)):
                np.add.at(total, bucket(s), 1)
        if total.any():
            blocks = total.reshape(-1, 1 << BLOCK_BITS)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(counts), np.int32)
                total[block] = total.get(block, 0) + x.astype(np.int64)
        for block, x in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes()], pa.binary())})

    kind = "block int, counts binary"
    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint8)
    for row in texts.mapInArrow(count, kind).repartition(16, "block").mapInArrow(add, kind).collect():
        out[row["block"]] = np.frombuffer(row["counts"], np.uint8)
    return out.ravel()


def least_overlap(a: Column, b: Column) -> Column:
    """The smallest intersection that links sets of these sizes."""
    return F.ceil((NUM * (a + b)) / (NUM + DEN))


def signs(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit signatures of each set."""
    found = [((s * MIX[10] ^ s >> np.uint64(31)).sum(dtype=np.uint64), ((s ^ s >> np.uint64(33)) * MIX[11]).sum(dtype=np.uint64)) for s in sets]
    both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(both[:, k].copy()) for k in range(2)]


def parity(s: np.ndarray, m: int = 0) -> bytes:
    """For each place below m (the least power of two from twice the set's size on): whether an odd number of its shingles hash to it."""
    m = m or 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (s * MIX[9] >> np.uint64(32)) & np.uint64(m - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def sized(docs: DataFrame) -> DataFrame:
    """(id, n, s1, s2) of docs (id, text): size and signatures of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("jaccard")
        for batch in runs_of(batches, 1):
            sets = list(sets_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), *signs(sets)], names=["id", *SET])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, n int, s1 long, s2 long")


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(id, th, n, s1, s2, g, prefix, odd, bits) of docs (id, th, text) with words: g is a hash of prefix and size, odd and bits are parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs_of(batches, 2):
            where, sets, heads = [], [], []
            for i, s in enumerate(sets_of(batch.column(2))):
                if len(s):
                    where.append(i)
                    sets.append(s)
                    heads.append(s[np.lexsort((s, counts[bucket(s)]))[: len(s) - (NUM * len(s) + DEN - 1) // DEN + 1]])
            of_prefix = np.array([((h ^ h >> np.uint64(33)) * MIX[12]).sum(dtype=np.uint64) for h in heads], np.uint64)
            groups = (of_prefix + np.array([len(s) for s in sets], np.uint64) * MIX[13]).view(np.int64)
            flat = np.concatenate([*heads, np.zeros(0, np.uint64)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)), pa.array(flat))
            maps = np.frombuffer(b"".join(parity(s, 64 * MAP_WORDS) for s in sets), np.int64)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * MAP_WORDS), pa.array(maps))
            kept = [batch.column(k).take(pa.array(where, pa.int64())) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(s) for s in sets], pa.int32()), *signs(sets), pa.array(groups), lists, pa.array(map(parity, sets), pa.binary()), bits], names=["id", "th", *SET, "g", "prefix", "odd", "bits"])

    return docs.mapInArrow(run, f"id {dict(docs.dtypes)['id']}, th long, n int, s1 long, s2 long, g long, prefix array<long>, odd binary, bits array<long>")


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two parity sketches differ, the longer one folded to the shorter one's length."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    p, q = 8 * len(x), 8 * len(y)
    while p > q:
        p //= 2
        a = (a >> p) ^ (a & ((1 << p) - 1))
    while q > p:
        q //= 2
        b = (b >> q) ^ (b & ((1 << q) - 1))
    return (a ^ b).bit_count()


def near(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of classes those that may link by their sizes and parity sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fit = []
            for m, n, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                need = (NUM * (m + n) + NUM + DEN - 1) // (NUM + DEN)
                fit.append(need <= min(m, n) and differing(x, y) <= m + n - 2 * need)
            yield batch.filter(pa.array(fit, pa.bool_())).select([0, 1])

    a, b = (members.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("odd").alias(f"o{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "oa", "ob").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets link, from texts (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), PAIRS):
                part, ok = batch.slice(lo, PAIRS), []
                for x, y in zip(sets_of(part.column(2)), sets_of(part.column(3)), strict=True):
                    both = np.sort(np.concatenate([x, y]))
                    shared = np.count_nonzero(both[1:] == both[:-1])
                    ok.append(shared > 0 and DEN * shared >= NUM * (len(both) - shared))
                yield part.filter(pa.array(ok, pa.bool_())).select([0, 1])

    a, b = (texts.select(F.col("cls").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has at most BROADCAST_IDS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else df


def fits(an: str, ap: str, bn: str, bp: str) -> Column:
    """Whether groups of these sizes, the first of whose common shingles has these places in their orders, can link."""
    need = least_overlap(F.col(an), F.col(bn))
    return (F.col(ap) <= F.col(an) - need) & (F.col(bp) <= F.col(bn) - need)


def alike(an: str, am: str, bn: str, bm: str) -> Column:
    """Whether sets of these sizes and sketches can link; a null sketch says nothing."""
    differ = sum((F.bit_count(F.get(am, F.lit(k)).bitwiseXOR(F.get(bm, F.lit(k)))) for k in range(1, MAP_WORDS)), F.bit_count(F.get(am, F.lit(0)).bitwiseXOR(F.get(bm, F.lit(0)))))
    return F.coalesce(differ <= F.col(an) + F.col(bn) - 2 * least_overlap(F.col(an), F.col(bn)), F.lit(True))


def ordered_pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def group_pairs(lists: DataFrame, located: DataFrame) -> DataFrame:
    """Pairs (ga, gb) of groups that meet at a shingle, can link, and are not in one component, from located (g, lo, hi, bits)."""
    rows = lists.join(located, "g")
    mixed = rows.groupBy("shingle").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("k")).where("least < most")
    order = Window.partitionBy("g", "n").orderBy("pos")  # a prefix
    open_ = rows.join(mixed.select("shingle", F.ceil(F.col("k") / SPLIT).cast("int").alias("parts")), "shingle")
    open_ = persist(open_.withColumn("seen", F.array_compact(F.array(*[F.lag("shingle", k).over(order) for k in range(1, PREVIOUS + 1)]))), "jaccard-open")
    part = F.pmod(F.xxhash64("g", F.lit(5)), F.col("parts")).cast("int")
    x = open_.select("shingle", part.alias("part"), F.col("g").alias("ga"), F.col("n").alias("an"), F.col("pos").alias("ap"), F.col("lo").alias("al"), F.col("hi").alias("ah"), F.col("bits").alias("am"), F.col("seen").alias("as_"))
    y = open_.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("g").alias("gb"), F.col("n").alias("bn"), F.col("pos").alias("bp"), F.col("lo").alias("bl"), F.col("hi").alias("bh"), F.col("bits").alias("bm"), F.col("seen").alias("bs"))
    apart = ~((F.col("al") == F.col("bh")) & (F.col("ah") == F.col("bl")))
    met = x.join(y, ["shingle", "part"]).where((F.col("ga") < F.col("gb")) & apart & fits("an", "ap", "bn", "bp") & ~F.arrays_overlap("as_", "bs") & alike("an", "am", "bn", "bm"))
    out = persist(met.select("ga", "gb").distinct(), "jaccard-group-pairs")
    drop_persisted(open_)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    rows = persist(sized(texts.select("id", "text")), "jaccard-rows")
    found = prefixes(texts.where("id IS NOT NULL"), document_counts(texts.select("text")))
    same = found.groupBy(*SET).agg(F.min(F.struct("id", "th")).alias("rep"), *[F.first(c).alias(c) for c in ("g", "prefix", "odd", "bits")])
    members = persist(same.withColumn("cls", F.monotonically_increasing_id()), "jaccard-classes")
    laid = members.select("g", "n", F.posexplode("prefix").alias("pos", "shingle"))
    met = laid.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    lists = persist(laid.join(met, "shingle").distinct(), "jaccard-lists")

    groups = persist(members.groupBy("g").agg(F.min("cls").alias("first"), F.count("*").alias("m")), "jaccard-groups")
    others = members.select("cls", "g").join(groups.where("m > 1"), "g").where("cls <> first").select(*ordered_pair("cls", "first"))
    pivots = lists.groupBy("shingle").agg(F.array(*[F.min_by(F.struct(F.col("g").alias("gb"), F.col("n").alias("bn"), F.col("pos").alias("bp")), F.xxhash64("g", F.lit(k))) for k in range(PIVOTS)]).alias("with"))
    star = lists.join(pivots, "shingle").select("g", "n", "pos", F.inline("with")).where((F.col("g") != F.col("gb")) & fits("n", "pos", "bn", "bp")).select("g", "gb").distinct()
    leads = [groups.select(F.col("g").alias(k), F.col("first").alias(f"of_{k}")) for k in ("g", "gb")]
    star = star.join(leads[0], "g").join(leads[1], "gb").select(*ordered_pair("of_g", "of_gb"))

    def links(pairs: DataFrame) -> DataFrame:
        close = persist(near(pairs.distinct(), members), "jaccard-near")
        nodes = close.select(F.col("a").alias("cls")).unionByName(close.select(F.col("b").alias("cls"))).distinct()
        wanted = persist(members.select("cls", "rep.id", "rep.th").join(nodes, "cls"), "jaccard-wanted")
        fetched = texts.join(few(wanted), ["id", "th"]).groupBy("cls").agg(F.first("text").alias("text"))  # repeated rows are one
        held = persist(fetched, "jaccard-texts")
        out = persist(linked(close, held), "jaccard-links")
        for x in (close, wanted, held):
            drop_persisted(x)
        return out

    edges = links(others.unionByName(star))
    comp = components(edges.unionByName(of_one_id(rows, members)))
    at = persist(members.select("cls", "g", "rep", "bits").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")), "jaccard-located")
    located = at.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
    pairs = group_pairs(lists, located)
    inside = located.where("lo < hi").select(F.col("g").alias("ga"), F.col("g").alias("gb"))
    of = [at.select(F.col("g").alias(f"g{k}"), F.col("cls").alias(f"c{k}"), F.col("comp").alias(f"r{k}")) for k in "ab"]
    expanded = pairs.unionByName(inside).join(of[0], "ga").join(of[1], "gb").where("ra <> rb AND (ga <> gb OR ca < cb)")
    rest = links(expanded.select(*ordered_pair("ca", "cb")))
    to = [at.select(F.col("cls").alias(k), F.col("comp").alias(f"r{k}")) for k in "ab"]
    merged = components(rest.join(to[0], "a").join(to[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    at_last = at.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("cls", "rep", F.coalesce("root", "comp").alias("comp"))
    lowest = persist(at_last.groupBy("comp").agg(F.min("rep.id").alias("component_id")), "jaccard-lowest")
    named = persist(members.select(*SET, "cls").join(at_last.join(lowest, "comp").select("cls", "component_id"), "cls").drop("cls"), "jaccard-named")
    for x in (edges, comp, merged, rest, at, lowest, pairs, lists, groups, members):
        if hasattr(x, "_scratch_path"):
            drop_persisted(x)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return rows.join(named, SET, "left").select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def of_one_id(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes to which rows of one id belong."""
    own = rows.where("n > 0 AND id IS NOT NULL").withColumn("set", F.struct(*SET))
    several = own.groupBy("id").agg(F.min("set").alias("one"), F.max("set").alias("last")).where("one <> last").select("id", "one")
    pairs = own.join(several, "id").where("set <> one").select("one", "set").distinct()
    number = [members.select(F.struct(*SET).alias(c), F.col("cls").alias(k)) for c, k in (("one", "a"), ("set", "b"))]
    return pairs.join(number[0], "one").join(number[1], "set").select("a", "b")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays for each component: that with the smallest id.

    Of rows that repeat this id the one with the smallest hash of all columns stays. Rows without an id all stay.
    """
    own = free("_id", docs.columns)
    found = persist(classes(docs, id_col, text_col).where(F.col(id_col).isNotNull()).select(F.col(id_col).alias(own), (F.col(id_col) == F.col("component_id")).alias("first")), "jaccard-found")
    each = found.groupBy(own).agg(F.max("first").alias("first"), F.count("*").alias("n"))
    odd = persist(each.where("NOT first OR n > 1"), "jaccard-odd")  # ids that go, or whose rows are more than one
    same = F.col(f"`{id_col}`") == F.col(own)
    alone = docs.join(few(odd.select(own)), same, "left_anti")
    repeated = docs.join(few(odd.where("first").select(own)), same, "left_semi")
    one = repeated.groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return alone.unionByName(one.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))


def op4(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


#: Every pair of documents that share a shingle, and components by spreading smaller ids along links.
OP4_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
u AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS x FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_have >= 80 * (na.n + nb.n - both_have)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
