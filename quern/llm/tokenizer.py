"""Byte-level BPE over a whole corpus, with a segment tree over the ranks of adjacent pairs.

The texts of a batch are cut by the vocabulary's pattern, and the distinct cuts that are no token themselves are merged all at once:
each has a segment tree whose leaves are its adjacent pairs (rank, then position), so the root is the leftmost pair of lowest rank;
a merge changes three leaves and the logarithmically many nodes above them. The trees of equally wide cuts are rows of one array.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.arrow import by_length

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Unicode White_Space, as the vocabulary's published splitting pattern means \s (fixed value).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_NONE = np.int64(1) << 60
_SHIFT = 20


def _splitting(letter: str, number: str) -> str:
    """The vocabulary's published splitting pattern (fixed value), for the given classes of letters and numbers."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{_SPACE}{letter}{number}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


class Splitter:
    """Splits by the pattern. Texts without characters beyond U+FFFF take the standard engine, which is over twice as fast."""

    def __init__(self):
        plane = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
        ranges = ["".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(rf"\p{{{kind}}}+", plane)) for kind in "LN"]
        self.plane = re.compile(_splitting(*ranges))
        self.all = regex.compile(_splitting(r"\p{L}", r"\p{N}"))

    def split(self, text: str) -> list[str]:
        plain = text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)
        return (self.plane if plain else self.all).findall(text)


class PairRanks:
    """Ids of single bytes and tokens, and the rank of each pair of ids whose concatenation is a token."""

    def __init__(self, vocabulary: bytes):
        self.token = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.byte = np.array([self.token[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.token.items():
            for i in range(1, len(token)):
                a, b = self.token.get(token[:i]), self.token.get(token[i:])
                if a is not None and b is not None:
                    pairs[(a << _SHIFT) | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where it isn't mergeable or has no right half (-1)."""
        key = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], _NONE)


def merge_block(ids: np.ndarray, sizes: np.ndarray, ranks: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merge rows of byte ids (padded with -1): the remaining ids row by row, and how many each row has."""
    rows, width = ids.shape
    leaves = 1 << max(0, (width - 2).bit_length())
    tree = np.full((rows, 2 * leaves), _NONE, dtype=np.int64)
    place = np.arange(width - 1, dtype=np.int64)
    first = ranks.rank(ids[:, :-1], ids[:, 1:])
    tree[:, leaves : leaves + width - 1] = np.where(first < _NONE, first * leaves + place, _NONE)
    level = leaves
    while level > 1:
        half = level // 2
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
        level = half
    # one column more on either side: column 0 stands for "before the first", the last for "after the last"
    held = np.full((rows, width + 2), -1, dtype=np.int64)
    held[:, 1:-1] = ids
    after = np.broadcast_to(np.arange(1, width + 3, dtype=np.int64), (rows, width + 2)).copy()
    after[:, -1] = width + 1
    before = np.broadcast_to(np.arange(-1, width + 1, dtype=np.int64), (rows, width + 2)).copy()
    before[:, 0] = 0
    live = np.arange(rows)
    while True:
        root = tree[live, 1]
        keep = root < _NONE
        live, root = live[keep], root[keep]
        if not len(live):
            break
        pos = root % leaves + 1
        gone = after[live, pos]
        follow = after[live, gone]
        held[live, pos] = root // leaves
        held[live, gone] = -2
        after[live, pos] = follow
        before[live, follow] = pos
        prior = before[live, pos]
        own = held[live, pos]
        right = ranks.rank(own, np.where(follow <= width, held[live, follow], -1))
        left_id = held[live, prior]
        left = np.where(prior >= 1, ranks.rank(np.maximum(left_id, 0), own), _NONE)
        for where, value in ((pos, right), (gone, None), (prior, left)):
            leaf = where - 1
            new = np.full(len(live), _NONE) if value is None else np.where(value < _NONE, value * leaves + leaf, _NONE)
            fits = (leaf >= 0) & (leaf < leaves)
            r, node = live[fits], leaf[fits] + leaves
            tree[r, node] = new[fits]
        nodes = [(w - 1 + leaves, (w >= 1) & (w - 1 < leaves)) for w in (pos, gone, prior)]
        nodes = [np.where(ok, n, leaves) for n, ok in nodes]
        level = leaves
        while level > 1:
            nodes = [n >> 1 for n in nodes]
            for n in nodes:
                tree[live, n] = np.minimum(tree[live, 2 * n], tree[live, 2 * n + 1])
            level >>= 1
    body = held[:, 1:-1]
    left_over = body >= 0
    return body[left_over], left_over.sum(axis=1)


def merge_long(ids: list[int], ranks: PairRanks) -> list[int]:
    """The same merges for one long cut, on plain lists: whole-array operations don't pay for a single row."""
    count = len(ids)
    none, pairs = 1 << 60, ranks.pairs
    leaves = 1 << max(0, (count - 2).bit_length())
    tree = [none] * (2 * leaves)
    for i in range(count - 1):
        rank = pairs.get((ids[i] << _SHIFT) | ids[i + 1])
        if rank is not None:
            tree[leaves + i] = rank * leaves + i
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, count + 1)), list(range(-1, count - 1))
    while tree[1] < none:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        follow = after[gone]
        ids[at], ids[gone], after[at] = rank, -1, follow
        changed = [(gone, none)]
        if follow < count:
            before[follow] = at
            changed.append((at, pairs.get((rank << _SHIFT) | ids[follow], none)))
        else:
            changed.append((at, none))
        if before[at] >= 0:
            changed.append((before[at], pairs.get((ids[before[at]] << _SHIFT) | rank, none)))
        for leaf, value in changed:
            if leaf < leaves:
                node = leaf + leaves
                tree[node] = value if value == none else value * leaves + leaf
                node >>= 1
                while node:
                    a, b = tree[2 * node], tree[2 * node + 1]
                    least = a if a < b else b
                    if tree[node] == least:
                        break
                    tree[node] = least
                    node >>= 1
    return [i for i in ids if i >= 0]


class Encoder:
    """Encodes lists of texts; remembers the ids of cuts seen before (a cache that is emptied when full)."""

    def __init__(self, vocabulary: bytes, remember: int = 400_000):
        self.ranks = PairRanks(vocabulary)
        self.splitter = Splitter()
        self.known: dict[str, np.ndarray] = {}
        self.remember = remember

    def _learn(self, cuts: list[str]) -> None:
        raw = [c.encode("utf-8", "surrogatepass") for c in cuts]
        open_ = []
        for c, b in zip(cuts, raw):
            whole = self.ranks.token.get(b)
            if whole is None:
                open_.append((len(b), c, b))
            else:
                self.known[c] = np.array([whole], dtype=np.int32)
        open_.sort(key=lambda x: x[0])
        at = 0
        while at < len(open_):
            # rows of a block have widths within the same power of two, and the block a bounded number of cells
            top = 1 << (open_[at][0] - 1).bit_length()
            to = at
            while to < len(open_) and open_[to][0] <= top and (to == at or (to - at) * top < 2_000_000):
                to += 1
            block = open_[at:to]
            if top > 64 and len(block) < 32:
                for _, c, b in block:
                    self.known[c] = np.array(merge_long(self.ranks.byte[np.frombuffer(b, dtype=np.uint8)].tolist(), self.ranks), dtype=np.int32)
                at = to
                continue
            sizes = np.array([n for n, _, _ in block])
            width = int(sizes[-1])
            ids = np.full((len(block), width), -1, dtype=np.int64)
            filled = np.arange(width) < sizes[:, None]
            ids[filled] = self.ranks.byte[np.frombuffer(b"".join(b for _, _, b in block), dtype=np.uint8)]
            flat, counts = merge_block(ids, sizes, self.ranks)
            ends = np.cumsum(counts)
            flat = flat.astype(np.int32)
            for (_, c, _), s, e in zip(block, (ends - counts).tolist(), ends.tolist()):
                self.known[c] = flat[s:e]
            at = to

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]; none for a null or empty text."""
        cuts = [self.splitter.split(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = [c for cut in cuts for c in cut]
        if not flat:
            return np.zeros(len(texts) + 1, np.int32), np.empty(0, np.int32)
        codes, distinct = pd.factorize(np.array(flat, dtype=object))
        if len(self.known) > self.remember:
            self.known.clear()
        new = [c for c in distinct if c not in self.known]
        if new:
            self._learn(new)
        parts = [self.known[c] for c in distinct]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        store, starts = np.concatenate(parts), np.cumsum(sizes) - sizes
        own = sizes[codes]
        ends = np.cumsum(own)
        ids = store[np.arange(ends[-1]) + np.repeat(starts[codes] - (ends - own), own)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return edges.astype(np.int32), ids


_ENCODERS: dict[int, Encoder] = {}


def read_vocabulary(path: str, most_bytes: int = 64 << 20) -> bytes:
    """The file's bytes; they are sent to every executor, so their size is checked."""
    with open(path, "rb") as f:
        data = f.read(most_bytes + 1)
    if len(data) > most_bytes:
        raise ValueError(f"{path} is larger than {most_bytes} bytes")
    return data


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, ids ARRAY<INT>): each text as token ids without special tokens.

    One narrow stage: no shuffle, one row out for each row in, in any order. A null or empty text gives an empty list, special
    tokens' strings are ordinary text, repeated rows and null ids are kept as they are, other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(len(shared.value))
        if encoder is None or encoder.source != shared.value:
            encoder = _ENCODERS[len(shared.value)] = Encoder(shared.value)
            encoder.source = shared.value
        for batch in by_length(batches, "text", 1_000_000):
            offsets, ids = encoder.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
