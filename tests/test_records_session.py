import os

import pytest
from pyspark.sql import functions as F

from quern import session
from quern.operators.numbering import numbered_rows
from quern.operators.records import one_each

DDL = "k bigint, text string, v map<string,double>"


@pytest.mark.parametrize("repeated", [1_000_000, 0])
def test_one_row_stands_as_a_whole(spark, repeated):
    """Both ways, few repeated keys and many: rows that differ aren't mixed, equal ones count once, null keys are left out."""
    rows = [(1, "a", {"x": 1.0}), (1, "a", {"x": 1.0}), (2, "z", None), (2, None, {"y": 2.0}), (None, "n", None), (3, "", {}), (4, "long" * 10_000, None)]
    got = one_each(spark.createDataFrame(rows, DDL), "k", repeated).collect()
    assert sorted(r["k"] for r in got) == [1, 2, 3, 4]
    assert all((r["k"], r["text"], r["v"]) in rows for r in got)
    assert one_each(spark.createDataFrame([], DDL), "k", repeated).count() == 0


def test_numbers_without_gaps(spark):
    """One source has most rows; numbers follow the order whatever the partitions."""
    rows = [("hot", i) for i in range(300)] + [(None, 5), ("a", 2), ("a", 1)]
    got = numbered_rows(spark.createDataFrame(rows, "s string, n int").repartition(7), [F.col("s").asc_nulls_first(), F.col("n")], "id", 10).orderBy("id").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r["s"], r["n"]) for r in got] == want and [r["id"] for r in got] == list(range(10, 10 + len(rows)))
    assert numbered_rows(spark.createDataFrame([], "n int"), [F.col("n")], "id").count() == 0


def test_scratch_is_deleted(spark):
    with session.scratch(spark) as path:
        kept = session.cut_lineage(spark.range(3))
        assert kept.count() == 3 and os.path.isdir(path.removeprefix("file:").replace("//", "/"))
    assert not os.path.exists(path.removeprefix("file:").replace("//", "/"))
    assert session.new_folder(spark).startswith(session.shared_dir(spark))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
