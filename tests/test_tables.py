"""Stored tables: merges against a dictionary, lost jobs, repeated batches and two writers."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.sources.tables import Conflict, StoredTable

SCHEMA = "case_id string, n long, title string, status string"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merges_are_a_dictionary_of_dictionaries(spark, tmp_path):
    rng, t, expected = random.Random(4), StoredTable.create(spark, f"{tmp_path}/t", SCHEMA, ["case_id", "n"], 5), {}
    for batch in range(4):
        rows = [(rng.choice([None, "", "a", "b", "hot", "hot", "hot"]), rng.choice([None, 1, 2]), rng.choice([None, f"t{batch}"]), rng.choice([None, "", f"s{k}"]), k) for k in range(rng.choice([1, 30]))]
        t.merge(spark.createDataFrame(rows, SCHEMA + ", seq long").repartition(3), "seq", ("w", batch))
        for c, n, title, status, _ in rows:
            old = expected.get((c, n), (None, None))
            expected[c, n] = (title if title is not None else old[0], status if status is not None else old[1])
        assert _rows(t.read()) == sorted(((*k, *v) for k, v in expected.items()), key=repr)
    for case in (None, "hot", "absent"):
        assert _rows(t.lookup(case)) == sorted(((*k, *v) for k, v in expected.items() if k[0] == case), key=repr)
    assert t.version() == 4 and _rows(t.read(0)) == []


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    t = StoredTable.create(spark, f"{tmp_path}/t", SCHEMA, ["case_id", "n"], 8)
    t.append(spark.range(200).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("case_id"), F.lit(1).cast("long").alias("n"), F.lit("x").alias("title"), F.lit("new").alias("status")))
    (first,) = t.manifest()["writes"]
    t.merge(spark.createDataFrame([("c7", 1, "done")], "case_id string, n long, status string"))
    m = t.manifest()["writes"]
    assert len(m[first]) == 7 and sum(map(len, m.values())) == 8
    assert _rows(t.lookup("c7")) == [("c7", 1, "x", "done")] and t.read().count() == 200
    plan = t.lookup("c7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "case_id" in plan


def test_a_job_that_dies_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    t = StoredTable.create(spark, f"{tmp_path}/t", SCHEMA, ["case_id", "n"], 4)
    rows = spark.createDataFrame([("a", 1, "t", "s"), ("b", 1, "t", "s")], SCHEMA)
    t.merge(rows, batch=("w", 0))

    def lost(self, m):
        raise OSError("executor lost")

    changed = rows.withColumn("status", F.lit("changed"))
    with monkeypatch.context() as patch:
        patch.setattr(StoredTable, "_commit", lost)
        with pytest.raises(OSError):
            t.merge(changed, batch=("w", 1))
    # And one whose task fails while it writes.
    with pytest.raises(Exception, match="boom"):
        t.merge(changed.withColumn("title", F.raise_error(F.lit("boom")).cast("string")), batch=("w", 1))
    assert _rows(t.read()) == _rows(rows) and t.version() == 1
    assert t.merge(changed, batch=("w", 1)) and not t.merge(changed, batch=("w", 1))
    assert _rows(t.read()) == _rows(changed) and t.version() == 2
    assert t.clean() >= 2 and _rows(t.read()) == _rows(changed)


def test_repeated_appends_and_two_writers(spark, tmp_path, monkeypatch):
    t = StoredTable.create(spark, f"{tmp_path}/t", SCHEMA, [], 4)
    rows = spark.createDataFrame([("a", 1, "t", "s")] * 3, SCHEMA)
    assert t.append(rows, ("w", 0)) and not t.append(rows, ("w", 0)) and t.append(rows, ("w", 1))
    assert t.read().count() == 6 and not t.append(rows.limit(0), ("w", 2))
    # Another writer commits between this one's reading of the manifest and its commit.
    other, real, calls = StoredTable(spark, f"{tmp_path}/t"), StoredTable._commit, []

    def late(self, m):
        if self is t and not calls:
            calls.append(1)
            other.append(rows, ("other", 0))
        return real(self, m)

    monkeypatch.setattr(StoredTable, "_commit", late)
    assert t.append(rows, ("w", 3)) and t.read().count() == 12
    with pytest.raises(Conflict):
        real(t, t.manifest())
