import base64
import hashlib
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tallyforge.llm import bpe

DOCS = "doc_id long, text string, n_tokens string, ids string"


@pytest.fixture(scope="module")
def encoding():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(*bpe.default_vocabulary())


ODD = [
    "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a \n b", "Hello, world!  It's 1234567 o'clock.", "été à l'œuvre", "日本語のテキスト", "😀👩‍👩‍👧 é", "<|endoftext|>", "\x00\x01\x7f", "a b c　d", "A" * 33, "ab" * 400, "z" * 2000,
    "don't DON'T we'LL", "tabs\t\tand\r\nlines\r\n\r\n", "x" * 31 + " " + "y" * 32 + " " + "q" * 65, " line ", "9" * 50, "!?" * 70, "a\u0085b", "   x", "𝒳𝓎 \U0010ffff",
]


def test_odd_texts_encode_as_the_library_does(coder, encoding):
    for t in ODD:
        ids, off = coder.encode([t])
        assert ids.tolist() == encoding.encode_ordinary(t), repr(t)
        assert coder.decode(ids)[0] == t.encode()
    ids, off = coder.encode(ODD)
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [encoding.encode_ordinary(t) for t in ODD]


def test_random_texts(coder, encoding):
    rng = random.Random(4)
    alphabet = "aeinorst  .,'\n\t0çéß日  😀́TH"
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200)))
        assert coder.encode([t])[0].tolist() == encoding.encode_ordinary(t), repr(t)


def test_leftmost_of_equal_ranks_and_both_trees_agree(coder):
    rng = random.Random(6)
    for _ in range(200):
        w = bytes(rng.choice(b"aabbest") for _ in range(rng.randrange(2, 32)))
        many, counts = coder.merge_many([w], 32)
        assert many.tolist() == coder.merge_one(w).tolist() and counts.tolist() == [len(many)]


def test_a_full_cache_starts_anew(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    c = bpe.Coder(*bpe.default_vocabulary())
    for k in range(6):
        t = " ".join(f"word{k}{i}" for i in range(8))
        assert c.encode([t])[0].tolist() == encoding.encode_ordinary(t)


def test_the_cache_is_bounded_by_bytes(encoding, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 200_000)
    c, most = bpe.Coder(*bpe.default_vocabulary()), 0
    for k in range(60):
        t = " ".join(f"{k}{i}" + "qz" * 1000 for i in range(10))
        ids = c.encode([t])[0].tolist()
        most = max(most, c.ids.nbytes + sum(map(len, c.known)))
        if k % 20 == 0:
            assert ids == encoding.encode_ordinary(t)
    assert most < 1_000_000


def sha(data):
    return hashlib.sha256(data).hexdigest()


def row(t, encoding):
    ids = encoding.encode_ordinary(t or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())


def test_documents(spark, tiny, encoding):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = bpe.op7(spark, tiny).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == row(text[r.doc_id], encoding)


def test_odd_rows(spark, encoding):
    rows = [(1, None), (2, ""), (3, "long " * 200_000), (3, "twice"), (3, "twice"), (None, "no id"), (4, "L" * 20_000)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    got = bpe.encode_decode(df, with_ids=True).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((i or 0, *row(t, encoding)) for i, t in rows)
    assert all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_decode(df.limit(0)).count() == 0


def test_a_run_of_texts_takes_little_memory():
    """What is held besides the cache, over 3 MB of texts whose chunks are known."""

    class Docs:
        dtypes = [("doc_id", "bigint")]
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: f

    run = bpe.encode_decode(Docs())
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(["one word after another, 12 of 345 " * 30] * 3000)], names=["doc_id", "text"])
    first = list(run([batch.slice(0, 1)]))
    tracemalloc.start()
    rows = sum(out.num_rows for out in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first[0].num_rows == 1 and rows == 3000
    assert peak < 20 << 20
