"""Auto-flush boundaries of sessions that span many batches."""

import random

from lamina.operators import resolve


def brute(rows, limit):
    out, tables = [], {}
    for session, at, key, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        table = tables.setdefault(session, {})
        table[key] = len(key) + len(value or "")
        if sum(table.values()) >= limit:
            out.append((session, at))
            table.clear()
    return out


def test_flush_points_stream_a_session(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, f"k{rng.randrange(40)}", rng.choice([None, "", "v" * rng.randrange(30)])) for i in range(2000)]
    changes = spark.createDataFrame(rows, "shard long, ord long, key string, value string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        points = resolve.flush_points(changes, 100, "shard")
        plan = points._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan  # no row holds a whole session
        assert points.columns == ["shard", "ord"]
        assert sorted(map(str, map(tuple, points.collect()))) == sorted(map(str, brute(rows, 100)))
        alone = [(0, *r[1:]) for r in rows]
        got = resolve.flush_points(changes.drop("shard"), 100).collect()
        assert sorted(r.ord for r in got) == [at for _, at in brute(alone, 100)]
        assert resolve.flush_points(changes.limit(0), 100, "shard").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
