import zlib

import numpy as np
import pytest

from tallyforge.llm import langid

DOCS = "doc_id long, text string, lang string, source string, score string, held_out string"


def phrases(text, training):
    """Phrases of the greedy parse of a whole text into longest substrings of the training text."""
    n = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in training:
            end += 1
        at, n = max(end - 1, at + 1), n + 1
    return n


def spaced(text):
    out = []
    for c in text:
        out.append(c.lower()[0] if c.isalpha() else " ")
    return " ".join("".join(out).split())


TRAINING = (("en", "the cat sat on the mat and the dog ran to the house with the red door"), ("fr", "le chat est sur la table et le chien court vers la maison avec la porte rouge"))


@pytest.mark.parametrize("text", ["The cat, the dog!", "la porte rouge", "xyz", "ththth eee", "a", "the red door " * 60, "Maison: la TABLE; zz maison"])
def test_phrase_counts(text):
    p = langid.Parser(TRAINING)
    got = p.phrases([p.symbols(text)])[0]
    assert got.tolist() == [phrases(spaced(text), t) for _, t in TRAINING]


@pytest.mark.parametrize("segment", [1, 2, 3, 7, 64])
def test_segments_do_not_cut_a_parse(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    long = " ".join(TRAINING[0][1] for _ in range(3))
    training = (("en", " ".join([TRAINING[0][1]] * 4)), TRAINING[1])
    p, rng = langid.Parser(training), np.random.default_rng(8)
    texts = [long, long[7:], *("".join(rng.choice(list("thecarmgo nd"), int(n))) for n in rng.integers(1, 300, 40))]
    texts = [spaced(t) for t in texts if spaced(t)]
    got = p.phrases([p.symbols(t) for t in texts])
    assert got.tolist() == [[phrases(t, x) for _, x in training] for t in texts]


def test_many_texts_at_once_count_as_one_by_one():
    p, rng = langid.Parser(TRAINING), np.random.default_rng(5)
    texts = ["".join(rng.choice(list("thecarmgodnuls "), int(n))) for n in rng.integers(1, 900, 60)]
    whole = p.phrases([p.symbols(t) for t in texts if p.symbols(t).size])
    single = np.concatenate([p.phrases([p.symbols(t)]) for t in texts if p.symbols(t).size])
    assert np.array_equal(whole, single)


def test_automaton_accepts_exactly_the_substrings():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 3, 60).tolist()
    go = langid.automaton(text, 3)

    def accepts(x):
        state = 0
        for c in x:
            state = go[state, c]
            if state < 0:
                return False
        return True

    inside = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(61, i + 8))}
    for x in (tuple(rng.integers(0, 3, rng.integers(1, 8)).tolist()) for _ in range(500)):
        assert accepts(x) == (x in inside)


def test_held_out_accuracy(spark, small):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = langid.op2(spark, small).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id]]
    assert sum(right) / len(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_learning_reads_no_held_out_row(spark):
    ids = range(60)
    rows = [(i, "hidden words" if zlib.crc32(str(i).encode()) % 3 == 1 else "open phrase", "en", "s", None, None) for i in ids]
    assert langid.learn(spark.createDataFrame(rows, DOCS)) == (("en", "open phrase"),)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", None, "x", "y"), (2, "", None, None, None, None), (3, "123 !?", "en", None, None, None), (4, "the dog " * 20_000, None, None, None, None), (4, "the dog", None, None, None, None), (None, "le chat", None, None, None, None)], DOCS)
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs, TRAINING).collect()]
    assert [g[:2] for g in got] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "fr")]
    assert [g[2] for g in got[:3]] == [0, 0, 0]
    kept = langid.identify(docs, TRAINING, keep_from=0.3)
    assert kept.schema == docs.schema and kept.count() == 3
    assert {r.lang_pred for r in langid.identify(docs, ()).collect()} == {"und"}
    assert langid.identify(docs.limit(0), TRAINING).count() == 0
    assert langid.learn(docs.limit(0)) == ()


def test_learning_takes_whole_texts_within_its_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "COMMON", 30)
    monkeypatch.setattr(langid, "TRAIN_CHARS", 45)
    ids = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "long " * 40 if i % 2 else f"short text {chr(97 + i % 26)}", "en", "s", None, None) for i in ids] + [(i, "seul " * 40, "fr", "s", None, None) for i in ids[:3]]
    (_, en), (_, fr) = langid.learn(spark.createDataFrame(rows, DOCS))
    assert fr == ("seul " * 40).strip() and "long" not in en and 1 <= en.count("short text ") <= 3
