"""Queries over `events` that is repeated with shifted keys: the same results as the SQL, from no more rays and points than there are different ones."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from gridfold.operators import match, traverse
from gridfold.plans import contract

#: A beam's end depends on its key by these two remainders alone.
PERIOD = 401 * 307
#: One query for each step that they share: the walk, the dense map that scores read, and points under candidates.
SHARING = ("likelihood_field", "smear_metrics", "match_best")


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Folders with 700 events over some days, once; three times with keys that are a period apart; three times with keys that aren't."""
    made = {}
    ids = spark.range(700).withColumn("day", F.col("id") % 5)
    events = ids.select(F.col("id").alias("event_id"), F.timestamp_add("DAY", "day", F.lit("2024-01-03").cast("timestamp")).alias("ts"), F.when(F.col("id") % 9 == 4, "error").otherwise("click").alias("event_type"))
    for name, shifts in {"once": [0], "equal": [0, PERIOD, 2 * PERIOD], "shifted": [0, 100_000, 200_000]}.items():
        made[name] = tmp_path_factory.mktemp(name)
        rows = events.crossJoin(spark.createDataFrame([(s,) for s in shifts], "shift long"))
        rows.withColumn("event_id", F.col("event_id") + F.col("shift")).drop("shift").coalesce(1).write.parquet(f"{made[name]}/events.parquet")
    return made


@pytest.mark.parametrize("query", SHARING[::2])
def test_copies_add_no_rays_and_no_points(spark, copies, monkeypatch, query):
    walk, scores, weighed, seen = traverse.walk, match.scores, [], []
    monkeypatch.setattr(traverse, "walk", lambda rays, *a: seen.append(rays.count()) or walk(rays, *a))
    monkeypatch.setattr(match, "scores", lambda points, *a: weighed.append(points.count()) or scores(points, *a))
    for name in ("once", "equal", "shifted"):
        contract.QUERIES[query](spark, str(copies[name]))
    assert seen[0] == seen[1] == 700 and seen[2] == 2100
    if weighed:
        calls = len(weighed) // 3
        assert set(weighed[:calls]) == set(weighed[calls : 2 * calls]) and min(weighed[2 * calls :]) == 3 * weighed[0]


@pytest.mark.parametrize("query", SHARING)
def test_copies_give_what_the_sql_gives(spark, copies, query):
    for name in ("equal", "shifted"):
        db = duckdb.connect()
        db.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{copies[name]}/events.parquet/*.parquet'")
        db.execute("SET TimeZone = 'UTC'")
        found = db.execute(contract.SQL[query])
        columns = [d[0] for d in found.description]
        want = sorted(found.fetchall())
        got = sorted(tuple(r[c] for c in columns) for r in contract.QUERIES[query](spark, str(copies[name])).collect())
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert all(math.isclose(x, y, rel_tol=0, abs_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True)), (a, b)
