from __future__ import annotations

from datetime import date, datetime

from tapelens.operators import states as st
from tapelens.streaming import jobs

SCHEMA = "ticker string, as_of date, state string"


def test_stream_transitions_equal_batch_over_batches(spark, tmp_path):
    first = [("A", date(2024, 1, 5), "HOLD"), ("B", date(2024, 1, 5), "EXIT"), ("A", date(2024, 1, 12), "EXIT")]
    second = [("A", date(2024, 1, 19), "EXIT"), ("B", date(2024, 1, 12), "HOLD"), ("A", date(2024, 1, 26), "HOLD")]
    folder = str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in (first, second):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        with jobs.rocksdb(spark):
            q = (
                jobs.transitions(jobs.read_folder(spark, folder, SCHEMA))
                .writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
            )
        q.awaitTermination()
    key = lambda r: (r.ticker, r.date, r.from_state, r.to_state)
    got = sorted(map(key, spark.read.parquet(out).collect()))
    want = sorted(map(key, st.transitions(spark.createDataFrame(first + second, SCHEMA)).collect()))
    assert got == want and len(got) == 3


def test_journal_sink_adds_nothing_twice(spark, tmp_path):
    df = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "k string, v int")
    write = jobs.journal_sink(str(tmp_path / "j"), ["k"])
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "j")).count() == 2


def test_late_prints_are_dropped(spark, tmp_path):
    schema = "ticker string, ts timestamp, seq int, price double, size double"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [("A", datetime(2024, 1, 1, 10, 5), 1, 1.0, 1.0), ("A", datetime(2024, 1, 1, 13, 0), 2, 2.0, 1.0)],
        [("A", datetime(2024, 1, 1, 10, 30), 3, 9.0, 1.0), ("A", datetime(2024, 1, 1, 16, 0), 4, 3.0, 1.0)],
    ]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        q = jobs.bars(jobs.read_folder(spark, folder, schema)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    rows = {r.start.hour: (r.high, r.prints) for r in spark.read.parquet(out).collect()}
    assert rows == {10: (1.0, 1), 13: (2.0, 1)}


def drain_in_parts(spark, tmp_path, make, schema, parts):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        with jobs.rocksdb(spark):
            q = make(jobs.read_folder(spark, folder, schema)).writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
        q.awaitTermination()
    return spark.read.parquet(out)


def test_dedupe_does_not_depend_on_batches(spark, tmp_path):
    day = lambda d, h: datetime(2024, 1, d, h)
    rows = [("A", day(1, 1)), ("A", day(1, 2)), ("B", day(1, 3)), ("A", day(2, 1)), ("A", day(2, 5)), ("B", day(3, 1)), ("A", day(3, 2))]
    make = lambda s: jobs.dedupe(s, ["k"])
    whole = drain_in_parts(spark, tmp_path / "one", make, "k string, ts timestamp", [rows])
    three = drain_in_parts(spark, tmp_path / "three", make, "k string, ts timestamp", [rows[:2], rows[2:5], rows[5:]])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, three.collect())) and whole.count() == 5


def test_older_rows_make_no_transition(spark, tmp_path):
    parts = [[("A", date(2024, 1, 19), "HOLD")], [("A", date(2024, 1, 5), "EXIT")], [("A", date(2024, 1, 26), "EXIT")]]
    got = drain_in_parts(spark, tmp_path, jobs.transitions, SCHEMA, parts).collect()
    assert [(r.from_state, r.to_state, r.date) for r in got] == [("HOLD", "EXIT", date(2024, 1, 26))]


def test_journal_by_day(spark, tmp_path):
    write = jobs.journal_sink(str(tmp_path / "j"), ["k", "day"], "day")
    one = spark.createDataFrame([("A", date(2024, 1, 1)), ("B", date(2024, 1, 2))], "k string, day date")
    write(one, 0)
    write(one.union(spark.createDataFrame([("A", date(2024, 1, 2))], one.schema)), 1)
    write(one, 1)
    assert spark.read.parquet(str(tmp_path / "j")).count() == 3


def test_detector_starts_from_stored_states_and_forgets_silent_tickers(spark, tmp_path):
    stored = spark.createDataFrame([("A", date(2024, 1, 5), "EXIT"), ("B", date(2024, 1, 5), "HOLD"), ("B", date(2023, 1, 6), "EXIT")], SCHEMA)
    parts = [
        [("A", date(2024, 1, 12), "HOLD"), ("B", date(2024, 1, 12), "HOLD")],
        [("C", date(2024, 8, 2), "HOLD")],  # the watermark passes the end of A's and B's states
        [("C", date(2024, 8, 9), "EXIT"), ("A", date(2024, 8, 9), "EXIT"), ("B", date(2024, 8, 9), "EXIT")],
    ]
    got = drain_in_parts(spark, tmp_path, lambda s: jobs.transitions(s, stored, quiet_days=60), SCHEMA, parts).collect()
    assert sorted((r.ticker, r.from_state, r.to_state, r.date) for r in got) == [
        ("A", "EXIT", "HOLD", date(2024, 1, 12)), ("C", "HOLD", "EXIT", date(2024, 8, 9))
    ]


def test_new_transitions_in_one_job(spark, tmp_path):
    parts = [
        [(" a", date(2024, 1, 5), "HOLD"), (" a", date(2024, 1, 12), "EXIT"), (" a", date(2024, 1, 12), "EXIT")],
        [("A", date(2024, 1, 5), "HOLD"), ("A", date(2024, 1, 12), "EXIT")],  # another spelling of the same ticker
        [(" a", date(2024, 1, 19), "HOLD")],
    ]
    journal = spark.createDataFrame([("a", "EXIT", "HOLD", date(2024, 1, 19))], jobs.TRANSITION)
    got = drain_in_parts(spark, tmp_path, lambda s: jobs.new_transitions(s, journal), SCHEMA, parts).collect()
    assert [tuple(r) for r in got] == [("A", "HOLD", "EXIT", date(2024, 1, 12))]


def test_dedupe_of_moves_over_batches(spark, tmp_path):
    one, two = ("A", "HOLD", "EXIT", date(2024, 1, 12)), ("A", "EXIT", "HOLD", date(2024, 1, 19))
    got = drain_in_parts(spark, tmp_path, jobs.dedupe_transitions, jobs.TRANSITION, [[one, one], [two, one]]).collect()
    assert sorted(tuple(r) for r in got) == sorted([one, two])
