"""Daily states against direct counts, before and after late rows."""

import datetime as dt
import random
from pathlib import Path

import pytest

from tidemark.operators import analytics, states

T0 = dt.datetime(2024, 1, 1)


def events(spark, n, seed, days=30):
    draw = random.Random(seed)
    users = [None, 0, 1, 32767, 32768, 70000, 2**31, 5, 6, 7]
    return spark.createDataFrame([(T0 + dt.timedelta(hours=draw.randrange(24 * days)), draw.choice(users)) for _ in range(n)], "created_at timestamp_ntz, user_id long").repartition(3)


def rows(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_bitmaps_count_as_sets_do(spark):
    a, b = events(spark, 400, 1), events(spark, 300, 2)
    got = states.user_states(a, b)
    assert rows(states.daily_users(got)) == rows(analytics.dau(a, b))
    assert rows(states.weekly_users(got)) == rows(analytics.wau(a, b))
    assert rows(states.last_days(got, 14)) == rows(analytics.dau_last(a, b, 14))
    assert states.daily_users(states.user_states(a.limit(0))).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Expand" not in plan and "Generate" not in plan


def test_late_rows_touch_only_their_days(spark, tmp_path):
    a, b = events(spark, 400, 3).persist(), events(spark, 300, 4).persist()
    late = spark.createDataFrame([(T0 + dt.timedelta(days=d, hours=3), u) for d, u in ((2, 99), (2, 99), (9, None), (45, 12))], a.schema)
    path = str(tmp_path / "users")
    states.refresh(path, [a, b], [a, b], states.user_states)
    files = lambda: {p.relative_to(path) for p in Path(path).rglob("*.parquet")}
    before = files()
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 10), dt.date(2024, 2, 15)]
    whole = a.unionAll(late)
    for _ in range(2):  # a load that is run again changes nothing
        assert states.refresh(path, [late], [whole, b], states.user_states) == days
        assert rows(states.daily_users(states.read(spark, path, states.USERS))) == rows(analytics.dau(whole, b))
    kept = {p for p in before if p.parent.name not in {f"day={d}" for d in days}}
    assert kept <= files() and len(kept) > 20
    assert states.refresh(path, [late.limit(0)], [whole, b], states.user_states) == []


@pytest.mark.parametrize("n", [1, 2, 301])
def test_medians_from_counts(spark, n):
    draw = random.Random(n)
    wait = lambda t: None if draw.random() < 0.3 else t + dt.timedelta(minutes=draw.choice([0, 1, 1, 5, 7, 90, 4000]))
    times = [T0 + dt.timedelta(hours=draw.randrange(24 * 20)) for _ in range(n)]
    pulls = spark.createDataFrame([(t, wait(t), wait(t), f"r{i % 3}") for i, t in enumerate(times)], "created_at timestamp_ntz, first_review_at timestamp_ntz, merged_at timestamp_ntz, repo_full_name string")
    direct = analytics.pr_throughput_weekly(pulls).collect()
    want = {(r["week"], r["repo_full_name"], k): r[f"median_{k}_minutes"] for r in direct for k in ("review", "merge") if r[f"median_{k}_minutes"] is not None}
    got = states.weekly_medians(states.wait_states(pulls))
    assert {(r["week"], r["repo_full_name"], r["kind"]): r["median_minutes"] for r in got.collect()} == want
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
