"""Best paths against full enumeration, many points in time against comparisons, and the skeleton on a stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import consensus as K
from causeway.operators import graph as G
from causeway.operators import intervals, paths
from causeway.sources.tables import StoredTable
from causeway.streaming import refresh


@pytest.mark.parametrize("seed, n, m, depth, beam", [(1, 8, 30, 6, 2), (2, 30, 60, 4, 5), (3, 5, 20, 6, 256)])
def test_best_paths_are_the_best_of_all(spark, seed, n, m, depth, beam):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice([0.5, 0.98, rng.random()]), rng.choice([1.0, -0.5]), rng.choice(["day", "year"]), 0.1, rng.choice([1, 4])) for _ in range(m)] + [("", "n0", 0.9, 1.0, "day", 0.1, 1)]
    df = spark.createDataFrame(rows, "head string, tail string, strength double, polarity double, granularity string, noise_sigma double, support_count int")
    every = G.root_causes(df, "n0", depth).orderBy(F.desc("influence"), F.array_join("path", ">")).collect()
    for k in (1, 5, 1000):
        got = paths.best_paths(df, "n0", k, depth, beam).collect()
        assert [pytest.approx(r.influence) for r in got] == [r.influence for r in every[:k]]
        assert sorted((tuple(r.path), round(r.influence, 9)) for r in got if r.influence > every[min(k, len(every)) - 1].influence + 1e-9) == sorted(
            (tuple(r.path), round(r.influence, 9)) for r in every[:k] if r.influence > every[min(k, len(every)) - 1].influence + 1e-9)
    (alone,) = paths.best_paths(df, "nowhere", 3).collect()
    assert (alone.path, alone.influence, alone.lower, alone.upper) == (["nowhere"], 1.0, 0.0, 1.0)


def test_intervals_of_supported_paths(spark):
    df = spark.createDataFrame([("a", "b", 0.9, 1.0, "day", 0.1, 4)], "head string, tail string, strength double, polarity double, granularity string, noise_sigma double, support_count int")
    (r,) = paths.best_paths(df, "b", 1).collect()
    decay = spark.range(1).select(S.temporal_decay(F.lit("day"))).first()[0]
    margin = 1.96 * ((0.1 + 0.1) * 0.04 / 4) ** 0.5
    assert (r.influence, r.upper - r.influence) == (pytest.approx(0.9 * decay), pytest.approx(margin))


def test_points_and_intervals(spark):
    rng, day = random.Random(7), datetime(1999, 12, 31, 12)
    when = lambda: rng.choice([None, day + timedelta(hours=rng.randrange(-9000, 9000))])
    edges = [(k, when(), when()) for k in range(300)] + [(300, day - timedelta(days=36500), day + timedelta(days=36500)), (301, None, None)]
    points = [(k, day + timedelta(hours=rng.randrange(-5000, 5000))) for k in range(40)] + [(40, None)]
    e = spark.createDataFrame(edges, "seq long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    p = spark.createDataFrame(points, "point long, at timestamp_ntz")
    joined = intervals.as_of_many(e, p)
    got = [(r.point, r.seq) for r in joined.collect()]
    expected = [(j, k) for j, at in points if at for k, a, b in edges if (a is None or a <= at) and (b is None or b >= at)]
    assert sorted(got) == sorted(expected)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.as_of_many(e, p.where("at is null")).count() == 0


def test_refresh_is_the_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, rng.choice(["Oil", " oil", "Rate"]), rng.choice(["drives", "reduces"]), rng.choice(["Bond", "Turmoil"]), rng.choice(["high", None]), "day", datetime(2000, 1, 1), rng.random(), rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "seq long, head_node string, relation string, tail_node string, confidence string, granularity string, event_time timestamp_ntz, reflection_quality double, temporal_quality double")
    df.repartition(4).write.parquet(f"{tmp_path}/edges")
    table = refresh.state_table(spark, f"{tmp_path}/states", 4)
    run = lambda: refresh.refresh(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/edges"), table, f"{tmp_path}/checkpoint").awaitTermination()
    run()
    assert table.version() == 4
    now = F.lit("2000-06-15").cast("timestamp_ntz")
    links = lambda state: {(r["head"], r.relation, r["tail"]): (pytest.approx(r.strength), r.support_count) for r in K.links(state, now).collect()}
    batch = links(K.states(df))
    assert links(table.read()) == batch
    # New files only touch their own links; a batch that comes again is skipped.
    late = df.limit(1).withColumn("head_node", F.lit("Gold"))
    late.write.mode("append").parquet(f"{tmp_path}/edges")
    run()
    assert not table.merge(K.states(df), batch=("edges", 4), combine=K.merged)
    assert links(StoredTable(spark, f"{tmp_path}/states").read()) == links(K.states(df.unionByName(late)))
