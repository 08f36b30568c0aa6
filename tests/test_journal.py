from __future__ import annotations

import json

import pytest

from tapelens.sources import journal, ledger
from tapelens.streaming import jobs

RUN = "run_id string, started_at_utc string, git_sha string, app_version string, provider string, metadata map<string,string>"
SCORED = "run_id string, ticker string, class string, state string, S_score double, F_score double, mom_12_1 double, stage int"


def tables(spark, run="r1", note="weak", meta="x", order=1):
    runs = spark.createDataFrame([(run, "2024-01-05T10:00:00+00:00", None, "1", "p", {"k": meta, "a": "1"})], RUN)
    rows = [(run, "xlk", "Tech", "HOLD", 1.0, None, 0.2, 2), (run, "xlf", "Fin", "EXIT", -1.0, 0.5, None, 4)][::order]
    bluf = json.dumps({"actions": [{"kind": "exit", "label": "Out", "tickers": [{"t": "xlf", "note": note}]}]})
    docs = spark.createDataFrame([(run, bluf)], "run_id string, bluf string")
    return runs, journal.score_records(spark.createDataFrame(rows, SCORED)), journal.decision_records(docs)


def test_decisions_of_odd_lists(spark):
    groups = [
        {"kind": " Exit ", "tickers": [{"t": "a", "note": "n"}, {"ticker": "b"}, {"t": "", "ticker": "c"}, "loose", {"note": "x"}]},
        {"tickers": [{"t": "d"}]},
        {"kind": "trim", "eta": "soon", "tickers": [{"t": "e"}]},
        "stray",
        {"kind": "buy"},
    ]
    docs = [("1", json.dumps({"actions": groups})), ("2", '{"actions": [{'), ("3", "{}"), ("4", None), ("5", '{"actions": "none"}')]
    got = journal.decision_records(spark.createDataFrame(docs, "run_id string, bluf string")).collect()
    assert sorted((r.run_id, r.ticker, r.action, r.rationale or "") for r in got) == [
        ("1", "A", "EXIT", "n"), ("1", "B", "EXIT", ""), ("1", "C", "EXIT", ""), ("1", "D", "REVIEW", ""), ("1", "E", "TRIM", ""),
    ]
    assert {r.ticker: r.payload for r in got}["E"] == {"kind": "trim", "eta": "soon"}


def test_digest_covers_scores_decisions_and_metadata(spark):
    digest = lambda **k: journal.run_records(*tables(spark, **k)).first().digest
    base = digest()
    assert digest(order=-1) == base and digest(run="r2") == base
    assert len({base, digest(note="strong"), digest(meta="y")}) == 3


def test_append_runs_skips_content_and_tokens(spark, tmp_path):
    path = str(tmp_path / "j")
    assert journal.append_runs(*tables(spark), path, "one")
    assert not journal.append_runs(*tables(spark), path, "one")
    assert journal.append_runs(*tables(spark, run="r2"), path, "two")  # same content: nothing new
    assert journal.append_runs(*tables(spark, run="r3", note="strong"), path, "three")
    runs, scores, decisions = tables(spark)
    read = lambda name, df: ledger.read(spark, path, df.schema, name)
    got = read("runs", journal.run_records(runs, scores, decisions)).orderBy("run_id").collect()
    assert [r.run_id for r in got] == ["r1", "r3"]
    assert got[0].journal_id == f"dashboard-20240105T100000Z-{got[0].digest}" and got[0].universe_count == 2
    assert read("scores", scores).count() == 4 and read("decisions", decisions).count() == 2


@pytest.mark.parametrize("when", ["before", "after"])
def test_replayed_batch_leaves_each_row_once(spark, tmp_path, monkeypatch, when):
    path, df = str(tmp_path / "j"), spark.createDataFrame([("A", 1), ("A", 1), ("B", 2)], "k string, v int")
    write, publish = jobs.journal_sink(path, ["k"]), ledger.publish

    def fails(*args):
        if when == "after":
            publish(*args)
        raise OSError("lost")

    monkeypatch.setattr(ledger, "publish", fails)
    with pytest.raises(OSError):
        write(df, 0)
    monkeypatch.setattr(ledger, "publish", publish)
    read = lambda: sorted(map(tuple, ledger.read(spark, path, df.schema).collect()))
    assert len(read()) == (2 if when == "after" else 0)
    write(df, 0)
    write(df.where("false"), 1)
    write(df.union(spark.createDataFrame([("C", 3)], df.schema)), 0)  # another stream with the same batch number
    assert read() == [("A", 1), ("B", 2), ("C", 3)]
