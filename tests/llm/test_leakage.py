import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.leakage import Items, find_leaks, passing, rolling, seed_filter, tiles, words


def plain_words(text):
    kept = "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf")).lower()
    return re.findall("[㐀-鿿]|[^\\W_㐀-鿿]+", kept)


def test_words():
    for text in ("Élan-vital  ﬁle​ x_y", "测试Test１2", "", "!?", "é­İ"):
        assert words(text) == plain_words(text)


def test_rolling_is_a_hash_of_each_window():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 200).astype(np.uint64)
    for size in (1, 2, 3, 5, 12, 13, 200):
        hashes = rolling(codes, size)
        assert len(hashes) == 201 - size
        same = {}
        for i, h in enumerate(hashes.tolist()):
            assert same.setdefault(h, tuple(codes[i : i + size])) == tuple(codes[i : i + size])
        assert len(set(hashes.tolist())) == len({tuple(codes[i : i + size]) for i in range(201 - size)})
    assert len(rolling(codes[:3], 4)) == 0


def test_tiles_find_reordered_passages():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([np.zeros(5), item[20:40], np.zeros(3), item[0:20], np.zeros(2)]).astype(np.uint64)
    assert sorted(tiles(item, doc, 12)) == [(0, 28, 20), (20, 5, 20)]
    assert tiles(item, np.zeros(50, np.uint64), 12) == [] and tiles(item, doc[:10], 12) == []
    found = tiles(np.array([1, 1, 1, 2], np.uint64), np.array([1, 1, 1, 1, 1, 2], np.uint64), 2)
    assert sum(n for *_, n in found) == 4


def brute(docs, items, least=12):
    out = set()
    for d, text in docs:
        w = plain_words(text or "")
        for i, passage in items:
            p = plain_words(passage or "")
            size = min(least, len(p))
            grams = {tuple(p[j : j + size]) for j in range(len(p) - size + 1)} if size else set()
            if any(tuple(w[j : j + size]) in grams for j in range(len(w) - size + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("limit", [8 << 20, 0])
def test_against_brute_force(spark, limit):
    """Both ways: items sent to the executors, and seeds joined by a shuffle."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["Été", "中", "文"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [some(n) for n in (40, 25, 12, 11, 3, 30)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(90, ""), (91, None), (92, "!!"), (0, " ".join(passages[0]))]
    docs = []
    for d in range(60):
        p = rng.choice(passages)
        at, n = rng.randrange(len(p)), rng.choice((2, 11, 12, 40))
        docs.append((d, " ".join(some(20) + p[at : at + n] + some(20)).upper().replace("W1 ", "w1,​ ")))
    docs += [(100, None), (101, ""), (102, " ".join(passages[0][20:] + ["x"] + passages[0][:20])), (102, "other"), (103, " ".join(passages[1]))]
    left = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    right = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    got = find_leaks(left, right, broadcast_bytes=limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    whole = {r["doc_id"]: (r["coverage"], r["longest"], r["tiles"]) for r in got if (r["doc_id"], r["item_id"]) in {(102, 0), (103, 1)}}
    assert whole == {102: (1.0, 20, 2), 103: (1.0, 25, 1)}
    assert find_leaks(left, right, min_coverage=2.0, broadcast_bytes=limit).count() == 0
    assert find_leaks(left.limit(0), right, broadcast_bytes=limit).count() == 0 and find_leaks(left, right.limit(0), broadcast_bytes=limit).count() == 0


def test_items_take_little_memory():
    """The bound of what is sent is meant for arrays: about 15 bytes for each byte of text."""
    import tracemalloc

    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(20_000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=60))) for i in range(4000)]
    size = sum(len(t) for _, t in rows)
    tracemalloc.start()
    items = Items(rows, 12)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 15 * size and len(items.words_of(3999)) == 60
    seeds = rolling(items.words_of(7), 12)
    place, item = items.holders(12, seeds)
    assert set(item.tolist()) == {7} and len(place) == len(seeds)


def test_seed_filter_has_every_seed(spark):
    rows = [(int(x),) for x in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 500)]
    held = seed_filter(spark.createDataFrame(rows, "seed bigint"), 1 << 15)
    assert len(passing(np.array([r[0] for r in rows], np.int64).view(np.uint64), held)) == 500
    assert len(passing(np.arange(1, 20_000, dtype=np.uint64), held)) < 20


def test_coverage_threshold_takes_reordered_passages_and_leaves_short_ones(spark):
    """Both halves of an item in the other order cover it; twelve words of a long item are a passage but little coverage."""
    item = [f"q{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(item[30:] + ["x", "y"] + item[:30])), (2, " ".join(["z"] * 5 + item[5:17]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id bigint, text string")
    for limit in (8 << 20, 0):
        assert {r["doc_id"]: (round(r["coverage"], 2), r["tiles"]) for r in find_leaks(docs, items, broadcast_bytes=limit).collect()} == {1: (1.0, 2), 2: (0.2, 1)}
        assert [r["doc_id"] for r in find_leaks(docs, items, min_coverage=0.5, broadcast_bytes=limit).collect()] == [1]
