from __future__ import annotations

from datetime import datetime

from tapelens.sources import snapshots as sn

ROW = "ticker string, as_of string, captured_at timestamp, payload string"


def test_upsert_keeps_one_newest_row_per_key_without_sorting(spark):
    at = lambda d: datetime(2024, 1, d)
    store = spark.createDataFrame([("A", "d1", at(9), "old"), ("B", "d1", at(1), "stays"), ("A", "d2", at(1), "stays")], ROW)
    new = [("A", "d1", at(2), "first"), ("A", "d1", at(3), "last"), ("A", "d1", at(3), "last"), ("C", "d1", None, "x"), ("C", "d1", at(1), "y"), ("D", "d1", at(1), "p"), ("D", "d1", at(1), "q")]
    answers = set()
    for n in (1, 3, 7):
        out = sn.upsert(store, spark.createDataFrame(new, ROW).repartition(n), ["ticker", "as_of"], "captured_at")
        answers.add(tuple(sorted((r.ticker, r.as_of, r.payload) for r in out.collect())))
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(answers) == 1
    got = dict(((t, d), p) for t, d, p in answers.pop())
    assert got.pop(("D", "d1")) in ("p", "q")
    assert got == {("A", "d1"): "last", ("B", "d1"): "stays", ("A", "d2"): "stays", ("C", "d1"): "y"}
