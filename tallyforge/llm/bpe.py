"""Byte-level BPE encoding and decoding with the ranks of a tiktoken vocabulary file.

Each match of the split pattern is a word. Over the byte positions of a word stands a segment tree whose nodes hold the
smallest (pair rank, position) below them, so its root is the leftmost pair of minimum rank; a merge updates the leaves of
the merged pair and of its live left neighbour and their ancestors, which is logarithmic in the word's length. Words of
up to WIDE bytes are merged many at a time, each in a tree of its own with one NumPy step for all of them; longer ones one
by one. A worker keeps the ids of the chunks between spaces it met, up to about CACHE_BYTES, then starts anew; texts are
taken in runs of PIECE_BYTES, so that memory is bounded by these two and the longest text.

Mapping Arrow batches needs no shuffle. Defined cases: a null text is empty and has no ids; texts and words may be of any
length; repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyforge.llm.common import PIECE_BYTES, keep, runs_of, table, text_list

WIDE = 32
CACHE_BYTES = 32 << 20
#: What a chunk takes besides its characters and ids: a string, a number and its place in the table of chunks.
CHUNK_BYTES = 160
NONE = np.int64(1) << np.int64(40)
#: Two white characters in a row, one of them a space perhaps.
double_white = re.compile(r"\s\s").search


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Coder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.n_ids = max(ranks.values()) + 1
        tokens = [b""] * self.n_ids
        for token, i in ranks.items():
            tokens[i] = token
        self.token_bytes = Ragged(tokens)
        self.decimals = Ragged([b",%d" % i for i in range(self.n_ids)])
        self.tokens = tokens
        keys, made = array("q"), array("q")
        for t, i in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a * self.n_ids + b)
                    made.append(i)
        keys, made = np.frombuffer(keys, np.int64), np.frombuffer(made, np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(made[order], 0)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.filled, self.n_known = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), 0, 0
        self.cached = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the two make no token; an id below 0 is none."""
        key = left * self.n_ids + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)

    def merge_many(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has, of words of at most width bytes (a power of two), one tree each."""
        n = len(words)
        length = np.array([len(w) for w in words])
        ids = np.full((n, width + 2), -1, np.int64)  # one empty place on the left and on the right
        grid = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width)[None, :] < length[:, None]
        ids[:, 1:-1][inside] = self.byte_ids[grid[inside]]
        left, right = np.tile(np.arange(-1, width + 1), (n, 1)), np.tile(np.arange(1, width + 3), (n, 1))
        tree = np.full((n, 2 * width), NONE * width, np.int64)
        place = np.arange(width)
        tree[:, width:] = self.rank(ids[:, 1 : width + 1], ids[:, 2 : width + 2]) * width + place
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = np.flatnonzero(tree[:, 1] < NONE * width)
        while len(live):
            at = tree[live, 1] % width + 1
            gone = right[live, at]
            ids[live, at] = tree[live, 1] // width
            after = right[live, gone]
            right[live, at], left[live, np.minimum(after, width + 1)] = after, at
            ids[live, gone] = -1
            before = left[live, at]
            own, follow = ids[live, at], ids[live, np.minimum(after, width + 1)]
            self._put(tree, live, gone, np.full(len(live), NONE), width)
            self._put(tree, live, at, self.rank(own, follow), width)
            some = before > 0
            self._put(tree, live[some], before[some], self.rank(ids[live[some], before[some]], own[some]), width)
            live = live[tree[live, 1] < NONE * width]
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, rank: np.ndarray, width: int) -> None:
        node = at - 1 + width
        tree[rows, node] = rank * width + (at - 1)
        node = node >> 1
        for _ in range(width.bit_length() - 1):
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def merge_one(self, word: bytes) -> np.ndarray:
        """Ids of one long word with the same tree, in plain Python."""
        n, ids, tokens, known = len(word), self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.tokens, self.ranks.get
        width, none = 1 << (n - 1).bit_length(), int(NONE)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        tree = [none * width] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = known(tokens[ids[i]] + tokens[ids[i + 1]], none) * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (top := tree[1]) < none * width:
            rank, at = divmod(top, width)
            gone = right[at]
            after = right[at] = right[gone]
            ids[at], ids[gone] = rank, -1
            if after >= 0:
                left[after] = at
            before = left[at]
            new = [(gone, none), (at, known(tokens[rank] + tokens[ids[after]], none) if after >= 0 else none)]
            if before >= 0:
                new.append((before, known(tokens[ids[before]] + tokens[rank], none)))
            for i, r in new:
                node = width + i
                tree[node] = r * width + i
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    tree[node] = a if a < b else b
                    node >>= 1
        return np.array([i for i in ids if i >= 0], np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Adds the ids of new chunks to what this worker knows."""
        split = [self.split(c) for c in chunks]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
        raw = [w.encode() for w in place]
        by_width: dict[int, list[int]] = {}
        found: list[tuple[list[int], np.ndarray, np.ndarray]] = []  # words, all their ids, how many of each
        whole, long = [], []
        for i, w in enumerate(raw):
            if w in self.ranks:
                whole.append(i)
            elif len(w) > WIDE:
                long.append(i)
            else:
                by_width.setdefault(1 << (len(w) - 1).bit_length(), []).append(i)
        found.append((whole, np.array([self.ranks[raw[i]] for i in whole], np.int64), np.ones(len(whole), np.int64)))
        for i in long:
            ids = self.merge_one(raw[i])
            found.append(([i], ids, np.array([len(ids)])))
        for width, at in by_width.items():
            for lo in range(0, len(at), 4096):
                found.append((at[lo : lo + 4096], *self.merge_many([raw[i] for i in at[lo : lo + 4096]], width)))
        size, start = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        flat, filled = np.concatenate([ids for _, ids, _ in found]), 0
        for at, ids, counts in found:
            size[at], start[at] = counts, filled + np.cumsum(counts) - counts
            filled += len(ids)
        of = np.fromiter((place[w] for words in split for w in words), np.int64)
        new, ends = gather(flat, start[of], size[of])
        ends = ends[np.concatenate([[0], np.cumsum([len(words) for words in split], dtype=np.int64)])]
        while self.filled + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_known + len(chunks) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.filled : self.filled + len(new)] = new
        self.starts[self.n_known + 1 : self.n_known + len(chunks) + 1] = self.filled + ends[1:]
        self.filled, self.n_known = self.filled + len(new), self.n_known + len(chunks)

    def chunked(self, text: str) -> list[str]:
        """Keys of the chunks that a text falls into; the pattern never matches across their borders.

        A single space between two other characters always begins a match. Such a chunk's key lacks its space; the key of
        any other chunk is the chunk and a space more.
        """
        if not text:
            return []
        if text[0] != " " and text[-1] != " " and not double_white(text):
            keys = text.split(" ")
            keys[0] += " "
            return keys
        return [w[1:] if w[0] == " " and " " not in w[1:] else w + " " for w in self.split(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each."""
        if self.cached > CACHE_BYTES:
            self.forget()
        known = self.known
        keys = [self.chunked(t) for t in texts]
        new = {k for of in keys for k in of if k not in known}
        if new:
            listed = sorted(new)
            before, filled = self.n_known, self.filled
            self.learn([k[:-1] if k and k[-1] == " " else " " + k for k in listed])
            known.update(zip(listed, range(before, self.n_known), strict=True))
            self.cached += sum(map(sys.getsizeof, listed)) + CHUNK_BYTES * len(listed) + 8 * (self.filled - filled)
        at = np.array([known[k] for of in keys for k in of], np.int64)
        ids, ends = gather(self.ids, self.starts[at], self.starts[at + 1] - self.starts[at])
        return ids, ends[np.concatenate([[0], np.cumsum([len(of) for of in keys], dtype=np.int64)])]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, and the offset of each id in them."""
        return self.token_bytes.joined(ids)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[start : start + size], joined, and where each begins and the last ends."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)], ends


class Ragged:
    """Byte strings of differing lengths, joined by index in one NumPy step."""

    def __init__(self, items: list[bytes]):
        self.data = np.frombuffer(b"".join(items) or b"\0", np.uint8)
        self.size = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        out, ends = gather(self.data, self.start[at], self.size[at])
        return out.tobytes(), ends


def coder(path: str, pattern: str) -> Coder:
    """One coder for each vocabulary and Python worker."""
    return keep(("bpe", path, pattern), lambda: Coder(path, pattern))


def encode_decode(docs: DataFrame, vocabulary: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token count of every text and the digests of its ids and of the bytes they decode to; with_ids adds the ids."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in runs_of(batches, 1, PIECE_BYTES):
            counts, ids_sha, text_sha, lists = [], [], [], []
            ids, off = c.encode(text_list(batch.column(1)))
            raw, ends = c.decode(ids)
            told, marks = c.decimals.joined(ids)
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                counts.append(b - a)
                ids_sha.append(hashlib.sha256(told[marks[a] + 1 : marks[b]]).hexdigest())
                text_sha.append(hashlib.sha256(raw[ends[a] : ends[b]]).hexdigest())
                if with_ids:
                    lists.append(ids[a:b])
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out, names = [*out, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7(spark, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
