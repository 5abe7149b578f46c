"""Language ID by cross-parsing entropy.

For each language, a suffix automaton of a bounded piece of labelled text. A text is parsed against it from left to
right into longest matches; the language with the fewest phrases, normalised to bits by the logarithm of its training
length, wins (ties: the smallest code). Texts are lower-cased and every run of non-letters counts as one space. A text is
one parse from its first to its last symbol. To parse many at once in NumPy it is laid out in segments, each first parsed
from a guess, the state after the last WARM symbols before it; where that is not the state in which its predecessor ended,
the segment is parsed anew from there until the two parses meet, or else into the next segment.

Learning reads only text and lang of documents that are not held out: per language at most DOCS whole rows, those with
the smallest id hash among texts of up to COMMON characters (longer ones only if there are too few), as long as they have
TRAIN_CHARS characters together (the first in any case). Everything else covers all rows.

Defined cases: a null text or one without letters gives ``und`` and score 0, as does every text when nothing could be
learned. The score is the best language's share when each further phrase halves the odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import is_held_out, keep, runs_of, table, text_list

DOCS, COMMON, TRAIN_CHARS = 48, 2000, 48_000
#: Symbols of a segment and of a guess; the result does not depend on them.
SEGMENT, WARM = 512, 64
UND = "und"
#: Documents below this score are rejected by the filter.
MIN_SCORE = 0.3

SPACE, FIRST = 0, 1


def lowered() -> np.ndarray:
    """For each code point the lower-case letter it stands for, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def folded(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case letters of a text as code points; each run of others between letters is one 0."""
    cps = letters[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    keep = cps > 0
    keep[1:] |= cps[:-1] > 0
    out = cps[keep]
    return out[:-1] if len(out) and out[-1] == 0 else out


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a text, -1 where there is none; state 0 is the start."""
    size = max(2, 2 * len(symbols))
    go = np.full((size, width), -1, np.int32)
    link, longest, last, n = [-1] * size, [0] * size, 0, 1
    for c in symbols:
        cur, n = n, n + 1
        longest[cur] = longest[last] + 1
        p = last
        while p >= 0 and go[p, c] < 0:
            go[p, c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = int(go[p, c])
            if longest[q] == longest[p] + 1:
                link[cur] = q
            else:
                twin, n = n, n + 1
                longest[twin], link[twin] = longest[p] + 1, link[q]
                go[twin] = go[q]
                while p >= 0 and go[p, c] == q:
                    go[p, c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go[:n]


class Parser:
    """Counts phrases of many texts against the automata of all languages."""

    def __init__(self, training: tuple[tuple[str, str], ...]):
        self.names = [name for name, _ in training]
        letters = lowered()
        texts = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for _, t in training]
        alphabet = np.unique(np.concatenate([t[t != 32] for t in texts])) if texts else np.zeros(0, np.uint32)
        code = np.zeros(0x110000, np.int64)
        code[alphabet] = np.arange(FIRST, FIRST + len(alphabet))
        other, self.pad = FIRST + len(alphabet), FIRST + len(alphabet) + 1
        width = self.pad + 1
        self.codes = np.where(letters > 0, np.where(code[letters] > 0, code[letters], other), SPACE).astype(np.uint8 if width < 256 else np.uint16)
        self.tables, self.bits, self.width = [], [], width
        for t in texts:
            go = automaton(code[t].tolist(), width)
            # An entry is 4 x (next state x width) + the phrases that end with this symbol.
            kind = np.int32 if 4 * width * len(go) < 2**31 else np.int64
            start, go = go[0].copy(), go.astype(kind, copy=False)
            fall = np.where(start >= 0, start * kind(4 * width) + 1, 2).astype(kind)
            step = np.where(go >= 0, go * kind(4 * width), fall[None, :])
            step[0] = np.where(start >= 0, start * kind(4 * width), 1)
            step[:, self.pad] = np.arange(len(go), dtype=kind) * kind(4 * width)
            self.tables.append(step.ravel())
            self.bits.append(np.log2(max(2, len(t))))

    def symbols(self, text: str) -> np.ndarray:
        codes = self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        out = codes[keep]
        return out[:-1] if len(out) and out[-1] == SPACE else out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        counts = np.array([-(-len(t) // SEGMENT) for t in texts])
        lanes = int(counts.sum())
        grid = np.full(lanes * SEGMENT, self.pad, self.codes.dtype)
        at = 0
        for t, k in zip(texts, counts, strict=True):
            grid[at : at + len(t)] = t
            at += int(k) * SEGMENT
        used = np.ascontiguousarray(grid.reshape(lanes, SEGMENT).T)
        of = np.repeat(np.arange(len(texts)), counts)
        ends = np.cumsum(counts) - 1
        first = np.zeros(lanes + 1, bool)
        first[np.append(ends - counts + 1, lanes)] = True
        out = np.zeros((len(texts), len(self.tables)))
        for j, step in enumerate(self.tables):
            ended, state = parsed(step, used, first)
            out[:, j] = np.bincount(of, ended, len(texts)) + (state[ends] > 0)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Names and scores of one run of texts."""
        names, scores = [UND] * len(texts), np.zeros(len(texts))
        held = [(i, s) for i, text in enumerate(texts) if text and len(s := self.symbols(text))]
        if not held or not self.tables:
            return names, scores
        cost = self.phrases([s for _, s in held]) * (np.array(self.bits) / max(self.bits))
        best = cost.argmin(1)
        share = 1 / np.exp2(np.maximum(cost.min(1)[:, None] - cost, -60)).sum(1)
        for (k, _), b, p in zip(held, best, share, strict=True):
            names[k], scores[k] = self.names[b], p
        return names, scores


def parsed(step: np.ndarray, used: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each segment (a column of used), and the state after it; first marks the segments that begin a text."""
    n = used.shape[1]
    path = np.empty(used.shape, step.dtype)
    begun = np.zeros(n, step.dtype)
    for row in used[-WARM:]:
        begun[1:] = step.take(begun[1:] + row[:-1]) >> 2
    begun[first[:n]] = 0
    state, ended = begun.copy(), np.zeros(n, np.int32)
    for t, row in enumerate(used):
        state += row
        got = step.take(state)
        ended += got & 3
        state = got >> 2
        path[t] = state
    end = path[-1]
    todo = np.flatnonzero(~first[:n])
    while len(todo):
        todo = todo[end[todo - 1] != begun[todo]]
        now, then = end[todo - 1], begun[todo]
        begun[todo] = now
        for t, row in enumerate(used):
            if not len(todo):
                break
            symbols = row[todo]
            got, had = step.take(now + symbols), step.take(then + symbols)
            ended[todo] += (got & 3) - (had & 3)
            now, then = got >> 2, had >> 2
            path[t, todo] = now
            apart = now != then
            todo, now, then = todo[apart], now[apart], then[apart]
        todo = todo + 1
        todo = todo[~first[todo]]
    return ended, end


def parser(training: tuple[tuple[str, str], ...]) -> Parser:
    """One parser for each training text and Python worker."""
    return keep(("langid", training), lambda: Parser(training))


def learn(docs: DataFrame, n_docs: int = DOCS, id_col: str = "doc_id") -> tuple[tuple[str, str], ...]:
    """Per language, in the order of codes, its folded training text."""
    docs = docs.select(F.col(id_col).alias("_id"), "lang", "text").where(~is_held_out(F.col("_id")))
    able = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UND) & F.col("text").isNotNull())
    size = F.char_length("text")
    able = able.select("lang", F.xxhash64("text").alias("_t"), F.struct(size > COMMON, F.xxhash64("_id"), F.col("_id"), F.xxhash64("text")).alias("_order"), size.alias("_size"))
    ranked = able.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_order"))).where(F.col("_n") <= n_docs)
    upto = F.sum("_size").over(Window.partitionBy("lang").orderBy("_n"))  # n_docs rows a language
    chosen = ranked.withColumn("_upto", upto).where((F.col("_upto") <= TRAIN_CHARS) | (F.col("_n") == 1)).groupBy("lang", "_t").agg(F.min("_n").alias("_n"))
    chosen = chosen.select(F.col("lang").alias("_lang"), F.col("_t"), F.col("_n"))
    same = (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_t"))
    rows = docs.join(F.broadcast(chosen), same).groupBy("_lang", "_n").agg(F.min("text").alias("text"))
    letters, out = lowered(), {}
    for row in sorted(rows.collect(), key=lambda r: (r["_lang"], r["_n"])):
        s = folded(row["text"], letters)
        if len(s):
            out.setdefault(str(row["_lang"]), []).append(np.where(s == 0, 32, s).astype(np.uint32).tobytes().decode("utf-32-le"))
    return tuple((lang, " ".join(parts)) for lang, parts in sorted(out.items()))


def identify(docs: DataFrame, training: tuple[tuple[str, str], ...], id_col: str = "doc_id", keep_from: float | None = None) -> DataFrame:
    """Language and score of every text; with keep_from, the rows of docs with a language of at least that score, unchanged."""
    source = docs if keep_from is not None else docs.select(F.col(id_col), is_held_out(F.col(id_col)).alias("held_out"), "text")
    at = source.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(training)
        for batch in runs_of(batches, at):
            names, scores = p.predict(text_list(batch.column(at)))
            if keep_from is not None:
                yield batch.filter(pa.array([n != UND and s >= keep_from for n, s in zip(names, scores, strict=True)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "held_out", "lang_pred", "score"])

    kind = dict(source.dtypes)[id_col]
    return source.mapInArrow(run, source.schema if keep_from is not None else f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
