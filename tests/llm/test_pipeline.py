import base64
import hashlib
from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import langid, mixing, quality
from tests.llm.test_jaccard import brute
from tests.llm.test_quality import failed


def test_stages_against_brute_force(spark, tiny):
    """Each stage is run on its predecessor's rows, as run() does, and held against plain Python on the same rows."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "mix_sources", "byte_bpe"]
    outs, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, tiny)
        if name != "byte_bpe":
            assert out.schema == docs.schema
        outs[name] = out.collect()
        now = spark.createDataFrame(outs[name], out.schema)
    rows = docs.collect()

    names, scores = langid.Parser(langid.learn(docs)).predict([r.text for r in rows])
    kept = [r for r, n, s in zip(rows, names, scores, strict=True) if n != "und" and s >= langid.MIN_SCORE]
    assert Counter(r.doc_id for r in outs["language_id"]) == Counter(r.doc_id for r in kept)

    survivors = {r.doc_id for r in outs["quality_rules"]}
    assert survivors and all(not failed(r.text) for r in outs["quality_rules"])
    after = spark.createDataFrame(kept, docs.schema)
    judged = quality.judge(after, quality.fit(after, spark.read.parquet(f"{tiny}/labels.parquet"))).collect()
    assert survivors == {r.doc_id for r in judged if r.kept}

    found = brute([(r.doc_id, r.text) for r in outs["quality_rules"]])
    assert sorted(r.doc_id for r in outs["near_duplicates"]) == sorted(i for i, (_, comp) in found.items() if comp == i)

    shares = {r.doc_id: r.taken // r.size for r in mixing.shares(spark.createDataFrame(outs["near_duplicates"], docs.schema)).collect() if r.taken}
    assert Counter(r.doc_id for r in outs["mix_sources"]) == Counter(shares)

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in rows}
    assert len(outs["byte_bpe"]) == len(outs["mix_sources"])
    for r in outs["byte_bpe"]:
        ids = enc.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())

    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, tiny).collect()) == Counter(tuple(r) for r in outs["byte_bpe"])


def test_clean_labelled_documents_stay(spark, small):
    """Of documents labelled good that pass the counting rules and are no near copies, nearly all reach the mix."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    clean = {r.doc_id for r in docs.collect() if r.doc_id in good and not failed(r.text)}
    out = corpus_pipeline.quality_rules(spark, corpus_pipeline.language_id(spark, docs, small), small)
    assert len(clean & {r.doc_id for r in out.collect()}) > 0.98 * len(clean)


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    extra = {c: F.lit(k) for k, c in enumerate(["_id", "_key", "_size", "_row", "_copy", "_lang", "_t", "first", "n", "cls", "kept", "quality", "comp", "th"])}
    wide = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, wide.limit(0), tiny)
        assert empty.count() == 0
        if name == "byte_bpe":
            continue
        assert empty.columns == wide.columns
        rows = stage(spark, wide, tiny)
        assert rows.columns == wide.columns and rows.select(docs.columns).exceptAll(stage(spark, docs, tiny)).isEmpty()
        assert rows.where(" OR ".join(f"`{c}` <> {k}" for k, c in enumerate(extra))).isEmpty()
