from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", cpus="8")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def weekdays(start: date, n: int) -> list[date]:
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def growth_rows(ticker: str, base: float, rate: float, n: int = 900):
    """Steady growth on business days: open at the previous close, 1 % ranges."""
    rows, prev = [], None
    for i, d in enumerate(weekdays(date(2020, 1, 1), n)):
        close = base * (1 + rate) ** i
        open_ = close * 0.999 if prev is None else prev
        high, low = max(open_, close) * 1.01, min(open_, close) * 0.99
        rows.append((ticker, d, open_, high, low, close, close * 0.995, 1e6 + (i % 20) * 1000.0))
        prev = close
    return rows


BAR_SCHEMA = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"


@pytest.fixture(scope="session")
def market(spark):
    spec = {"XLK": (100, 0.0014), "XLF": (80, 0.0007), "SOXX": (120, 0.0018), "SPY": (100, 0.0010), "BIL": (90, 0.0001), "^TNX": (40, 0.0002)}
    rows = [r for t, (p, g) in spec.items() for r in growth_rows(t, p, g)]
    return spark.createDataFrame(rows, BAR_SCHEMA).cache()
