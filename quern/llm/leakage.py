"""Evaluation texts leaking into training texts: shared-token seeds, then greedy string tiling.

Items and documents become sequences of words. A seed is the Karp-Rabin hash of `min_match` successive words (of all words for
a shorter item). Seeds of documents are joined with seeds of items; every pair that shares one is tiled greedily: longest
non-overlapping common runs first, found by running Karp-Rabin hashing, so passages in another order add up to one coverage.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.arrow import by_length
from quern.session import cut_lineage

#: Bytes of items that are sent to the executors at most: their arrays take about 15 times as much in every Python worker, 120 MB
#: at this limit. The largest filter of seeds has 2 to this power bits, 32 MB.
BROADCAST_BYTES, FILTER_BITS = 8 << 20, 28

_WORD = re.compile("[㐀-鿿]|[^\\W_㐀-鿿]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _dropped() -> re.Pattern:
    chars = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Cf")]
    spans, start, last = [], None, None
    for c in chars:
        if last is None or ord(c) != ord(last) + 1:
            if start:
                spans.append(f"{start}-{last}")
            start = c
        last = c
    return re.compile(f"[{''.join(spans)}{start}-{last}]+")


_DROPPED: list[re.Pattern] = []


def words(text: str) -> list[str]:
    """Words of a text: NFKD, without marks and format characters, lower-cased; each ideograph is a word."""
    if not text.isascii():
        if not _DROPPED:
            _DROPPED.append(_dropped())
        text = _DROPPED[0].sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


def word_codes(found: list[str]) -> np.ndarray:
    """A 64-bit number for every word, the same in every process."""
    return np.fromiter(((zlib.crc32(b) << 32) | zlib.adler32(b) for b in (w.encode("utf-8", "surrogatepass") for w in found)), np.uint64, len(found))


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2^64 of every `size` successive codes, by doubling."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        block, length, power = codes * _BASE + np.uint64(1), 1, _BASE
        out, done = None, 0
        todo = size
        while True:
            if todo & 1:
                if out is None:
                    out, done = block, length
                else:
                    count = len(codes) - done - length + 1
                    out = out[:count] * power + block[done : done + count]
                    done += length
            todo >>= 1
            if not todo:
                return out[: len(codes) - size + 1]
            count = len(codes) - 2 * length + 1
            block = block[:count] * power + block[length : length + count]
            power = power * power
            length *= 2


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in document, length) of greedy tiles of at least `least` words, longest first."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    size = min(len(item), len(doc))
    search = max(least, size)
    while search >= least > 0 and size:
        if len(item) >= search and len(doc) >= search:
            open_item = np.flatnonzero(np.convolve(free_item, np.ones(search, int), "valid") == search)
            starts = defaultdict(list)
            for i, h in zip(open_item.tolist(), rolling(item, search)[open_item].tolist()):
                starts[h].append(i)
            hashes = rolling(doc, search)
            for d in np.flatnonzero(np.isin(hashes, np.fromiter(starts, np.uint64, len(starts)))).tolist() if starts else []:
                if not free_doc[d : d + search].all():
                    continue
                for i in starts[int(hashes[d])]:
                    if free_item[i : i + search].all() and (item[i : i + search] == doc[d : d + search]).all():
                        free_item[i : i + search] = False
                        free_doc[d : d + search] = False
                        out.append((i, d, search))
                        break
        search = search - 1 if search <= 2 * least else max(least, min(search - 1, _longest(item, doc, free_item, free_doc, least, search - 1)))
        if search < least:
            break
    return out


def _longest(item: np.ndarray, doc: np.ndarray, free_item: np.ndarray, free_doc: np.ndarray, least: int, most: int) -> int:
    """A length that no free common run exceeds: found by halving, as runs of a length contain runs of every shorter one."""
    low, high = least - 1, most
    while low < high:
        middle = (low + high + 1) // 2
        a = rolling(item, middle)[np.convolve(free_item, np.ones(middle, int), "valid") == middle] if len(item) >= middle else np.empty(0, np.uint64)
        b = rolling(doc, middle)
        if len(a) and len(b) and np.isin(b, a).any():
            low = middle
        else:
            high = middle - 1
    return low


RESULT = "item_words int, matched_words int, longest int, tiles int, coverage double"


def _tile(item: np.ndarray, doc: np.ndarray, min_match: int) -> tuple[int, int, int, int, float] | None:
    least = min(min_match, len(item))
    found = tiles(item, doc, least) if least else []
    if not found:
        return None
    matched = sum(n for _, _, n in found)
    return len(item), matched, found[0][2], len(found), matched / len(item)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = 12, min_coverage: float = 0.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, longest, tiles, coverage) for every document with a passage of an item.

    A passage is `min_match` successive words of the item, or all words of a shorter one; coverage is the share of the item's
    words in tiles, and pairs below `min_coverage` are left out. If the items' texts together are within `broadcast_bytes` their
    words and seeds are sent to the executors as arrays and each document is tiled where it is read, without a shuffle; beyond that, a
    filter of the items' seeds is sent instead, only documents that pass it are moved, and seeds are joined by hash. Null texts and
    texts without words match nothing; repeated rows count once; rows without an id are left out; empty tables give no rows;
    other columns are ignored.
    """
    words("é")  # the pattern of dropped characters is made here once and travels with the functions, instead of once in each task
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    items = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    weight = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    found = _broadcast_leaks(docs, items, min_match) if weight <= broadcast_bytes else _shuffled_leaks(docs, items, min_match)
    return found.filter(F.col("coverage") >= min_coverage).groupBy("doc_id", "item_id").agg(
        *[F.max_by(c, F.struct("coverage", "longest")).alias(c) for c in ("item_words", "matched_words", "longest", "tiles")], F.max("coverage").alias("coverage")
    ).select("doc_id", "item_id", "item_words", "matched_words", "longest", "tiles", "coverage")


class Items:
    """Items as arrays: numbers of their words, and all their seeds with the items that hold them, sorted by length and hash."""

    def __init__(self, rows: list[tuple[int, str]], min_match: int):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.vocabulary: dict[str, int] = {}
        codes = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)), np.uint32) for _, t in rows]
        self.ends = np.cumsum([len(c) for c in codes]).astype(np.int64)
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.uint32)
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for n, c in enumerate(codes):
            if len(c):
                size = min(min_match, len(c))
                seeds = np.unique(rolling(c.astype(np.uint64), size))
                by_size[size].append((seeds, np.full(len(seeds), n, np.int32)))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, parts in by_size.items():
            seeds, holders = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(seeds, kind="stable")
            self.seeds[size] = seeds[order], holders[order]

    def words_of(self, n: int) -> np.ndarray:
        return self.codes[self.ends[n - 1] if n else 0 : self.ends[n]].astype(np.uint64)

    def holders(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in hashes, item) for every item that holds one of some hashes."""
        seeds, holders = self.seeds[size]
        low, high = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
        times = high - low
        return np.repeat(np.arange(len(hashes)), times), holders[np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())]


def _broadcast_leaks(docs: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(Items([(r["item_id"], r["text"]) for r in items.collect()], min_match)))  # size checked by the caller

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Items.__new__(Items)  # only arrays travel
        vars(known).update(shared.value)
        for batch in by_length(batches, "text", 1_000_000):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            out = [[] for _ in range(7)]
            split = [words(t) for t in texts]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            get = known.vocabulary.get
            flat = np.fromiter((get(w, 0) for s in split for w in s), np.uint64, int(sizes.sum()))
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(split)), sizes)
            unknown = np.concatenate([[0], np.cumsum(flat == 0)])
            for size in known.seeds:
                if len(flat) < size:
                    continue
                at = np.arange(len(flat) - size + 1)
                at = at[(unknown[at + size] == unknown[at]) & (owner[at] == owner[at + size - 1])]
                if not len(at):
                    continue
                place, item = known.holders(size, rolling(flat, size)[at])
                pairs = np.unique(owner[at[place]] * len(known.ids) + item)
                for d, n in zip((pairs // len(known.ids)).tolist(), (pairs % len(known.ids)).tolist()):
                    got = _tile(known.words_of(n), flat[ends[d] - sizes[d] : ends[d]], min_match)
                    if got:
                        for column, value in zip(out, (ids[d], int(known.ids[n]), *got)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    names = ["doc_id", "item_id", "item_words", "matched_words", "longest", "tiles", "coverage"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return docs.mapInArrow(run, f"doc_id bigint, item_id bigint, {RESULT}")


def _bits(seeds: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Five places of every seed in a filter of `bits` bits, a power of two."""
    with np.errstate(over="ignore"):
        mixed = seeds.astype(np.uint64) * _BASE
    return (((mixed >> np.uint64(s)) & np.uint64(bits - 1)).astype(np.int64) for s in (0, 9, 18, 27, 36))


def passing(seeds: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Positions of the seeds that a filter may have; most drop out at the first place."""
    at = np.arange(len(seeds))
    for n in range(5):
        place = next(p for i, p in enumerate(_bits(seeds[at], 64 * len(held))) if i == n)
        at = at[(held[place >> 6] >> (place & 63)) & 1 == 1]
    return at


class _Codes(dict):
    """Words' codes, remembered; emptied when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = int(word_codes([word])[0])
        return code


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A filter with the bits of all seeds: made in tasks, combined by 64-bit word, so at most bits / 64 small rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(list(_bits(batch.column("seed").to_numpy().view(np.uint64), bits))))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array((np.uint64(1) << (place & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

    out = np.zeros(bits // 64, np.int64)
    for r in seeds.select("seed").mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        out[r["word"]] = r["mask"]
    return out


def _shuffled_leaks(docs: DataFrame, items: DataFrame, min_match: int, parts: int = 8) -> DataFrame:
    lengths = sorted({r["n"] for r in items.mapInPandas(_sizes(min_match), "n int").distinct().collect()})  # at most min_match values
    right = cut_lineage(items.mapInPandas(_seeds(min_match), "item_id bigint, size int, seed bigint").distinct())
    # 64 bits a seed, as a document asks for thousands; beyond the largest filter more documents pass, which costs time but no rows
    bits = 1 << min(max(10, (64 * right.count()).bit_length()), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(right, bits))

    def near_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = shared.value, _Codes()
        for batch in by_length(batches, "text", 1_000_000):
            split = [words(t) for t in batch.column("text").to_pylist()]
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), np.uint64, int(sizes.sum()))
            owner = np.repeat(np.arange(len(split)), sizes)
            found: dict[int, list[dict[str, int]]] = defaultdict(list)
            for size in lengths:
                seeds = rolling(flat, size)
                at = passing(seeds, held)
                at = at[owner[at] == owner[at + size - 1]]
                for doc, seed in {(d, x) for d, x in zip(owner[at].tolist(), seeds[at].view(np.int64).tolist())}:
                    found[doc].append({"size": size, "seed": seed})
            kept = sorted(found)
            some = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text"), pa.array([found[d] for d in kept], kind)], names=["doc_id", "text", "seeds"])

    kind = pa.list_(pa.struct([("size", pa.int32()), ("seed", pa.int64())]))
    near = cut_lineage(docs.mapInArrow(near_items, "doc_id bigint, text string, seeds array<struct<size:int,seed:bigint>>"))
    # a seed that very many documents share is joined in several parts, by document; the items' seeds are repeated for each part
    left = near.select("doc_id", F.inline("seeds")).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = left.join(right, ["size", "seed", "part"]).select("doc_id", "item_id").distinct()
    texts = pairs.join(items.withColumnRenamed("text", "item_text"), "item_id").join(near.select("doc_id", "text"), "doc_id").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, item_id, item, text in frame[["doc_id", "item_id", "item_text", "text"]].itertuples(index=False):
                got = _tile(word_codes(words(item)), word_codes(words(text)), min_match)
                if got:
                    rows.append((doc_id, item_id, *got))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "matched_words", "longest", "tiles", "coverage"])

    return texts.mapInPandas(run, f"doc_id bigint, item_id bigint, {RESULT}")


def _sizes(min_match: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = {min(min_match, len(words(t))) for t in frame["text"]} - {0}
            yield pd.DataFrame({"n": sorted(sizes)}, dtype="int32")

    return run


def _seeds(min_match: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, sizes, seeds = [], [], []
            for key, text in zip(frame["item_id"], frame["text"]):
                codes = word_codes(words(text))
                size = min(min_match, len(codes))
                if size:
                    rolled = np.unique(rolling(codes, size)).view(np.int64)
                    ids.append(np.full(len(rolled), key))
                    sizes.append(np.full(len(rolled), size))
                    seeds.append(rolled)
            if ids:
                yield pd.DataFrame({"item_id": np.concatenate(ids), "size": np.concatenate(sizes).astype("int32"), "seed": np.concatenate(seeds)})

    return run
