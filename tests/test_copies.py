import random

import pytest
from pyspark.sql import functions as F

from quern.functions.timestamps import instant
from quern.operators import copies

DDL = "source string, chunk_id bigint, page_no int, text string, created_at string, side string, k1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DDL)


def diff(a, b, few=copies.FEW):
    at = instant(F.col("created_at"))
    got = copies.differences(a, b, ["source", "chunk_id"], {"text": F.col("text"), "created_at": at, "page_no": F.col("page_no")}, at, few)
    return sorted((r["source"], r["chunk_id"], r["diff"]) for r in got.collect())


def brute(a, b):
    def stand(rows):
        best = {}
        for s, c, p, t, at in rows:
            if s is not None and c is not None and ((s, c) not in best or (at or "") > (best[s, c][2] or "")):
                best[s, c] = (t, p, at)
        return best

    x, y = stand(a), stand(b)
    out = [(*k, "only_a") for k in x.keys() - y.keys()] + [(*k, "only_b") for k in y.keys() - x.keys()]
    for k in x.keys() & y.keys():
        out += [(*k, n) for n, i in (("text", 0), ("page_no", 1), ("created_at", 2)) if x[k][i] != y[k][i]]
    return sorted(out)


def test_fields_nulls_and_versions(spark):
    at = "2026-01-01T00:00:00Z"
    a = [("s", 1, 1, "t", at), ("s", 1, 1, "t", at), ("s", 2, 1, None, at), ("s", 3, None, "t", None), ("s", 4, 1, "old", "2025-01-01T00:00:00Z"), ("s", 4, 1, "t", at), (None, 1, 1, "t", at), ("s", None, 1, "t", at), ("only", 1, 1, "", at)]
    b = [("s", 1, 1, "t", "2026-01-01T02:00:00+02:00"), ("s", 2, 1, "", at), ("s", 3, 2, "t", at), ("s", 4, 1, "t", at), ("S", 1, 1, "t", at)]
    assert diff(table(spark, a), table(spark, b)) == [("S", 1, "only_b"), ("only", 1, "only_a"), ("s", 2, "text"), ("s", 3, "created_at"), ("s", 3, "page_no")]


def test_empty_and_equal(spark):
    rows = table(spark, [("s", i, 1, "x" * 5000, None) for i in range(5)])
    none = rows.limit(0)
    assert diff(rows, rows) == [] and diff(none, none) == []
    assert diff(rows, none) == [("s", i, "only_a") for i in range(5)]


@pytest.mark.parametrize("aim,part", [(600, 512), (50, 8)])
def test_against_brute_force(spark, monkeypatch, aim, part):
    """The second setting gives tables far too small, so that buckets can't be peeled and are compared plainly."""
    monkeypatch.setattr(copies, "AIM", aim)
    monkeypatch.setattr(copies, "PART", part)
    rng = random.Random(3)
    base = [(f"s{i % 7}", i, i % 5, f"text {i}", f"2026-01-{1 + i % 28:02d}T00:00:00Z") for i in range(3000)]
    a = [r for r in base if rng.random() > 0.02]
    b = [(s, c, p, t + "!" if rng.random() < 0.05 else t, at) for s, c, p, t, at in base if rng.random() > 0.02]
    a += [("s1", 99_999, 1, "hot", "2026-01-01T00:00:00Z")] * 1500
    assert diff(table(spark, a), table(spark, b)) == brute(a, b)


def test_peeling_round_trip():
    rng = random.Random(1)
    cells = {}
    want = set()
    for _ in range(300):
        k1, k2, h, sign = (rng.getrandbits(63) for _ in range(3)), None, None, rng.choice((1, -1))
        k1, k2, h = k1
        want.add((k1, k2, h, sign))
        chk = copies._checksum(k1, k2, h)
        for place in copies._places(chk, 256):
            cell = cells.setdefault(place, [0, 0, 0, 0, 0])
            cell[0] += sign
            for i, v in enumerate((k1, k2, h, copies._signed(chk)), 1):
                cell[i] ^= v
    found, whole = copies.peel([(c, *v) for c, v in cells.items()], 256)
    assert whole and set(found) == want
