"""Differences between two copies of one data set, found with invertible Bloom lookup tables.

Every row's identity and content become hashes. Both copies are poured into one table of cells, one copy with the opposite sign, so
equal rows cancel out whatever their number; what is left is as large as the difference and is peeled into the differing identities.
Only their rows are then fetched and compared field by field. The table is sized from a strata estimate of the difference, and a
bucket that can't be peeled is compared hash by hash, so the result is always whole.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

#: Cells in each of the three parts of a bucket's table, entries aimed at for a bucket, and the same for a stratum of the estimate.
PART, AIM, STRATUM_PART, STRATA = 512, 600, 43, 40

#: Differing identities (two hashes each) that are broadcast at most to fetch their rows; more of them are joined by a shuffle.
FEW = 500_000

_CELL = ["n", "k1", "k2", "h", "chk"]


def _checksum(k1: int, k2: int, h: int) -> int:
    """The engine's xxhash64 of three bigints, as an unsigned number."""
    value = 42
    for part in (k1, k2, h):
        value = xxhash.xxh64_intdigest(struct.pack("<q", part), seed=value)
    return value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _places(chk: int, part: int) -> tuple[int, int, int]:
    """The cells of an entry: one in each part."""
    return tuple(j * part + ((chk >> (20 * j)) & 0xFFFFF) % part for j in range(3))


def _place_columns(chk: Column, part: int) -> Column:
    return F.array(*[F.lit(j * part) + F.pmod(F.shiftright(chk, 20 * j).bitwiseAND(F.lit(0xFFFFF)), F.lit(part)) for j in range(3)])


def peel(cells: Iterable[tuple[int, int, int, int, int, int]], part: int) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Entries (k1, k2, h, sign) left in a table given as rows (cell, n, k1, k2, h, chk), and whether all were found."""
    table = {cell: [n, k1, k2, h, chk] for cell, n, k1, k2, h, chk in cells}
    found, todo = [], list(table)
    while todo:
        at = table.get(todo.pop())
        if at is None or at[0] not in (1, -1):
            continue
        sign, k1, k2, h, chk = at
        if _signed(_checksum(k1, k2, h)) != chk:
            continue
        found.append((k1, k2, h, sign))
        for place in _places(chk & (2**64 - 1), part):
            cell = table.setdefault(place, [0, 0, 0, 0, 0])
            cell[0] -= sign
            for i, value in enumerate((k1, k2, h, chk), 1):
                cell[i] ^= value
            todo.append(place)
    return found, not any(any(c) for c in table.values())


def _cells(entries: DataFrame, group: Column, part: int) -> DataFrame:
    """Cells (grp, cell, n, k1, k2, h, chk) of all entries, without those that cancelled out."""
    chk = F.xxhash64("k1", "k2", "h")
    return (
        entries.select(group.alias("grp"), F.when(F.col("side") == "a", 1).otherwise(-1).alias("n"), "k1", "k2", "h", chk.alias("chk"))
        .withColumn("cell", F.explode(_place_columns(F.col("chk"), part)))
        .groupBy("grp", "cell")
        .agg(F.sum("n").alias("n"), *[F.bit_xor(c).alias(c) for c in _CELL[1:]])
        .filter("n <> 0 or k1 <> 0 or k2 <> 0 or h <> 0 or chk <> 0")
    )


def estimate_difference(entries: DataFrame) -> int:
    """About how many entries only one side has: strata by the key hash's trailing zeros, each with a table of fixed size.

    At most STRATA * 3 * STRATUM_PART small rows come to the driver, whatever the size of the data.
    """
    zeros = F.least(F.lit(STRATA - 1), F.length(F.regexp_extract(F.bin("k1"), "(0*)$", 1)))
    strata: dict[int, list] = {}
    for r in _cells(entries, zeros, STRATUM_PART).collect():
        strata.setdefault(r["grp"], []).append((r["cell"], *(r[c] for c in _CELL)))
    seen = 0
    for level in range(STRATA - 1, -1, -1):
        found, whole = peel(strata.get(level, []), STRATUM_PART)
        if not whole:
            return max(seen, 1) << (level + 1)
        seen += len(found)
    return seen


def _hashed(df: DataFrame, side: str, keys: list[str], fields: dict[str, Column], order: Column) -> DataFrame:
    """Rows with an identity: side, hashes, order, key columns and field columns under names of our own."""
    key_columns = [F.col(k) for k in keys]
    for k in key_columns:
        df = df.filter(k.isNotNull())
    values = [x for c in fields.values() for x in (c.isNull(), c)]
    return df.select(
        F.lit(side).alias("side"),
        F.xxhash64(F.lit(1), *key_columns).alias("k1"),
        F.xxhash64(F.lit(2), *key_columns).alias("k2"),
        F.xxhash64(*values).alias("h"),
        order.alias("ord"),
        *[k.alias(f"key{i}") for i, k in enumerate(key_columns)],
        *[c.alias(f"f{i}") for i, c in enumerate(fields.values())],
    )


def differences(a: DataFrame, b: DataFrame, keys: list[str], fields: dict[str, Column], order: Column, few: int = FEW) -> DataFrame:
    """(keys, diff, value_a, value_b) for every identity that only one copy has and every field whose values differ.

    An identity is the exact values of `keys`, none of them null; on each side the row with the greatest `order` (null is least)
    stands for it, of several such rows the one with the greatest content hash. diff is 'only_a', 'only_b' or the name of a field;
    null equals null and differs from every value. value_a and value_b are the field's values as text. Repeated rows count once,
    rows without an identity are left out, two empty or equal copies give no rows, other columns are ignored. Up to `few` differing
    identities are sent to the rows, so that only the rows that differ are moved; that number is counted first.
    """
    rows = _hashed(a, "a", keys, fields, order).unionByName(_hashed(b, "b", keys, fields, order))
    latest = rows.groupBy("side", "k1", "k2").agg(F.max(F.struct("ord", "h")).alias("top"))
    entries = cut_lineage(latest.select("side", "k1", "k2", F.col("top.h").alias("h")))
    buckets = max(1, -(-estimate_difference(entries) // AIM))
    bucket = F.pmod("k2", F.lit(buckets))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found, whole = peel(frame[["cell", *_CELL]].itertuples(index=False, name=None), PART)
        if whole:
            return pd.DataFrame({"grp": key[0], "k1": [x[0] for x in found], "k2": [x[1] for x in found], "whole": True})
        return pd.DataFrame({"grp": [key[0]], "k1": [0], "k2": [0], "whole": [False]})

    peeled = cut_lineage(_cells(entries, bucket, PART).groupBy("grp").applyInPandas(run, "grp bigint, k1 bigint, k2 bigint, whole boolean"))
    stuck = peeled.filter(~F.col("whole")).select("grp")
    plain = (
        entries.withColumn("grp", bucket)
        .join(stuck, "grp", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.max(F.when(F.col("side") == "a", F.col("h"))).alias("ha"), F.max(F.when(F.col("side") == "b", F.col("h"))).alias("hb"))
        .filter(~F.col("ha").eqNullSafe(F.col("hb")))
    )
    differing = cut_lineage(peeled.filter("whole").select("k1", "k2").unionByName(plain.select("k1", "k2")).distinct())
    return _compare(rows, differing, differing.count() <= few, keys, list(fields))


def _compare(rows: DataFrame, differing: DataFrame, few: bool, keys: list[str], names: list[str], salts: int = 8) -> DataFrame:
    if few:
        fetched = rows.join(F.broadcast(differing), ["k1", "k2"], "left_semi")
    else:
        # one identity may have very many rows: they meet their key in several tasks, then only the latest of each task is moved
        salted = differing.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        fetched = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(salted, ["k1", "k2", "salt"], "left_semi")
    key_names = [f"key{i}" for i in range(len(keys))]
    content = F.struct("ord", "h", *[f"f{i}" for i in range(len(names))])
    both = fetched.groupBy(*key_names).agg(F.max(F.when(F.col("side") == "a", content)).alias("a"), F.max(F.when(F.col("side") == "b", content)).alias("b"))
    text = lambda side, i: F.col(f"{side}.f{i}").cast("string")
    one = lambda name, va, vb: F.struct(F.lit(name).alias("diff"), va.alias("value_a"), vb.alias("value_b"))
    none = F.lit(None).cast("string")
    fields = F.filter(
        F.array(*[F.when(~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), one(n, text("a", i), text("b", i))) for i, n in enumerate(names)]), lambda x: x.isNotNull()
    )
    found = F.when(F.col("b").isNull(), F.array(one("only_a", none, none))).when(F.col("a").isNull(), F.array(one("only_b", none, none))).otherwise(fields)
    return both.select(*[F.col(n).alias(k) for n, k in zip(key_names, keys)], F.inline(found))
