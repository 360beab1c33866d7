"""The keyset source over SQLite: ranges, pages, filters that reach the database, and streams that start again."""

import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sources import keyset

SCHEMA = "id long, name string, at timestamp_ntz, n double"
T0 = dt.datetime(2024, 1, 1)


def moment(i):
    """Times with many ties, a third of the rows at one time, some null."""
    return None if i % 97 == 0 else T0 + dt.timedelta(hours=0 if i % 3 == 0 else i // 5)


def insert(path, ids):
    with sqlite3.connect(path) as con:
        con.execute("create table if not exists events (id integer, name text, at text, n real, prompt_text text)")
        rows = [(i, None if i % 11 == 0 else f"n{i}", moment(i) and moment(i).isoformat(" "), i / 4, "secret") for i in ids]
        con.executemany("insert into events values (?, ?, ?, ?, ?)", rows)


def expected(ids):
    return sorted((i, None if i % 11 == 0 else f"n{i}", moment(i), i / 4) for i in ids)


@pytest.fixture
def options(spark, tmp_path):
    keyset.register(spark)
    path = str(tmp_path / "events.db")
    ids = list(range(-40, 1000))
    random.Random(1).shuffle(ids)
    insert(path, ids)
    return {"connect": "sqlite3:connect", "arg.database": path, "table": "events", "time": "at", "times": "text", "partitions": "5", "page": "37"}


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "name", "at", "n").collect())


def test_full_and_incremental(spark, options):
    read = spark.read.format("keyset").schema(SCHEMA).options(**options)
    full, timed = read.load(), read.option("order", "time").load()
    assert rows(full) == expected(range(-40, 1000)) and full.rdd.getNumPartitions() == 5
    assert rows(timed) == [r for r in expected(range(-40, 1000)) if r[2]]
    since = T0 + dt.timedelta(days=4)
    late = timed.filter(F.col("at") >= F.lit(since))
    assert rows(late) == [r for r in expected(range(-40, 1000)) if r[2] and r[2] >= since]
    assert spark.read.format("keyset").schema("n double").options(**options).load().agg(F.sum("n")).first()[0] == sum(i / 4 for i in range(-40, 1000))


def test_filters_reach_the_database(spark, options):
    database = keyset.Database(keyset.T.StructType.fromDDL(SCHEMA), options)
    reader = keyset.KeysetReader(database)
    filters = [
        keyset.GreaterThanOrEqual(("id",), 10), keyset.LessThan(("at",), T0 + dt.timedelta(hours=9)), keyset.In(("id",), (11, 12, 13, 46, 999)), keyset.IsNotNull(("name",)), keyset.EqualTo(("name",), "n13"),
    ]
    assert list(reader.pushFilters(filters)) == filters and len(reader.clauses) == 4
    got = sorted(i for part in reader.partitions() for batch in reader.read(part) for i in batch.column("id").to_pylist())
    assert got == [12, 13, 999]  # 999 has the hot time; the text is left to Spark
    df = spark.read.format("keyset").schema(SCHEMA).options(**options).load()
    assert [r[0] for r in rows(df.filter("id >= 10 and name = 'n13' and n is not null and id in (11, 13)"))] == [13]
    assert rows(df.filter("name is null and id > 900")) == [r for r in expected(range(901, 1000)) if r[1] is None]


def test_what_is_refused(spark, options):
    read = lambda schema, **more: spark.read.format("keyset").schema(schema).options(**options | more).load().collect()
    for schema, more in (("id long, prompt_text string", {}), ("id long", {"table": "events; drop"}), ("id long", {"order": "name"}), ("at timestamp", {})):
        with pytest.raises(Exception, match="private columns|not a name|order is|without a zone"):
            read(schema, **more)
    with pytest.raises(Exception, match="schema"):
        spark.read.format("keyset").options(**options).load()


def test_empty_and_one_row(spark, options):
    with sqlite3.connect(options["arg.database"]) as con:
        con.execute("delete from events")
    for order in ("id", "time"):
        df = spark.read.format("keyset").schema(SCHEMA).options(**options | {"order": order}).load()
        assert rows(df) == []
    insert(options["arg.database"], [5])
    assert rows(spark.read.format("keyset").schema(SCHEMA).options(**options).load()) == expected([5])


def drained(spark, options, out, mark):
    stream = spark.readStream.format("keyset").schema(SCHEMA).options(**options).load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return rows(spark.read.schema(SCHEMA).parquet(out))


def test_stream_starts_again_where_it_was(spark, options, tmp_path):
    out, mark, timed = str(tmp_path / "out"), str(tmp_path / "mark"), lambda ids: [r for r in expected(ids) if r[2]]
    assert drained(spark, options, out, mark) == timed(range(-40, 1000))
    assert drained(spark, options, out, mark) == timed(range(-40, 1000))  # nothing new
    new = [i for i in range(1000, 1400) if i % 3]
    insert(options["arg.database"], new)
    assert drained(spark, options, out, mark) == timed([*range(-40, 1000), *new])


def test_late_rows_with_an_overlap(spark, options, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    options = options | {"overlap": str(2 * 86400), "start": (T0 + dt.timedelta(hours=50)).isoformat()}
    first = drained(spark, options, out, mark)
    begin = T0 + dt.timedelta(hours=2)
    assert first == [r for r in expected(range(-40, 1000)) if r[2] and r[2] >= begin]
    insert(options["arg.database"], [100999])  # a newer row
    with sqlite3.connect(options["arg.database"]) as con:
        con.execute("insert into events values (5000, 'late', ?, 1, 'x')", ((T0 + dt.timedelta(hours=180)).isoformat(" "),))
        con.execute("insert into events values (5001, 'too late', ?, 1, 'x')", ((T0 + dt.timedelta(hours=100)).isoformat(" "),))
    seen = {r[0] for r in drained(spark, options, out, mark)}
    assert {5000, 100999} <= seen and 5001 not in seen
