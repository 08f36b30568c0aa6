"""Stored bars: pruned reads, merges that rewrite only what they touch."""
from __future__ import annotations

from datetime import date
from pathlib import Path

from tapelens.sources import bars

SCHEMA = "ticker string, `interval` string, date date, close double"


def rows(spark, *items):
    return spark.createDataFrame([(t, "1d", date(*d), c) for t, d, c in items], SCHEMA)


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "store")
    first = rows(spark, ("A", (2019, 5, 1), 1.0), ("A", (2020, 5, 1), 2.0), ("A", (2021, 5, 3), 3.0), ("B", (2020, 6, 1), 9.0), ("A", (2022, 5, 2), 4.0))
    bars.write_bars(first, path)
    files = lambda year: {f.name for f in Path(path, "interval=1d", f"year={year}").glob("*.parquet")}
    before = {y: files(y) for y in (2019, 2020, 2021, 2022)}
    touched = bars.merge_bars(rows(spark, ("A", (2020, 3, 2), 7.0), ("A", (2022, 1, 3), 8.0)), path)
    assert touched == [("1d", 2020), ("1d", 2021), ("1d", 2022)]
    got = sorted((r.ticker, r.date, r.close) for r in bars.open_store(spark, path, first.schema).collect())
    # The range of A runs from March 2020 to January 2022: two of its bars go, 2021 is left empty.
    assert got == [("A", date(2019, 5, 1), 1.0), ("A", date(2020, 3, 2), 7.0), ("A", date(2022, 1, 3), 8.0), ("A", date(2022, 5, 2), 4.0), ("B", date(2020, 6, 1), 9.0)]
    assert files(2019) == before[2019] and all(files(y) != before[y] for y in (2020, 2021, 2022))
    again = bars.merge_bars(rows(spark, ("A", (2020, 3, 2), 7.0), ("A", (2022, 1, 3), 8.0)), path)
    assert again == touched and sorted((r.ticker, r.date, r.close) for r in bars.open_store(spark, path, first.schema).collect()) == got
    assert bars.merge_bars(rows(spark), path) == []


def test_read_is_pruned(spark, tmp_path):
    path = str(tmp_path / "store")
    first = rows(spark, *[(t, (y, 1, 4), float(y)) for t in "ABC" for y in range(2010, 2020)])
    bars.write_bars(first, path)
    got = bars.read_bars(bars.open_store(spark, path, first.schema), ["A"], "1d", "3y", date(2019, 6, 1))
    assert sorted(r.close for r in got.collect()) == [2017.0, 2018.0, 2019.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "year#" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "EqualTo(ticker,A)" in plan.split("PushedFilters:")[1] or "In(ticker" in plan.split("PushedFilters:")[1]
