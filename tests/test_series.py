"""Indicators over several blocks against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from figcorpus.operators import series as se


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(1)
    frames = []
    for symbol, n in (("hot", 1700), ("cold", 40)):
        close = np.round(100 + rng.normal(size=n).cumsum(), 2)
        if n > 220:
            close[200:220] = close[200]
        frames.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "trade_date": pd.date_range("2000-01-01", periods=n).date,
                    "open": close + rng.normal(size=n).round(2),
                    "high": close + 2.0,
                    "low": np.where(np.arange(n) % 50 < 12, close + 2.0, close - 2.0),
                    "close": close,
                    "vol": rng.integers(1, 99, n).astype(float),
                }
            )
        )
    return pd.concat(frames)


@pytest.fixture(scope="module")
def bars(spark, prices):
    return spark.createDataFrame(prices)


def collect(df, cols):
    return df.select("symbol", "trade_date", *cols).toPandas().sort_values(["symbol", "trade_date"]).reset_index(drop=True)


def expect(prices, fn):
    return pd.concat([fn(g) for _, g in prices.groupby("symbol")]).reset_index(drop=True)


def close_to(got, want, cols):
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-8, atol=1e-8, err_msg=c)


def test_averages_and_bands(spark, bars, prices):
    rows = se.with_history(se.blocked(bars))
    cols = ["ma5", "ma250", "vol_ma10", "upper_band", "lower_band"]
    got = collect(se.own_rows(se.bollinger(se.moving_averages(rows))), cols)

    def want(g):
        r = g.close.rolling
        m, s = r(20).mean(), r(20).std()
        return pd.DataFrame({"ma5": r(5).mean(), "ma250": r(250).mean(), "vol_ma10": g.vol.rolling(10).mean(), "upper_band": m + 2 * s, "lower_band": m - 2 * s})

    np.testing.assert_allclose(got["ma250"].astype(float), expect(prices, want)["ma250"], rtol=1e-9)
    close = expect(prices, want)
    for c in ("ma5", "vol_ma10"):
        np.testing.assert_allclose(got[c].astype(float), close[c], rtol=1e-9)
    for c in ("upper_band", "lower_band"):
        np.testing.assert_allclose(got[c].astype(float), close[c], rtol=1e-5)


def test_macd(bars, prices):
    got = collect(se.macd(se.blocked(bars)), ["macd", "signal", "hist"])

    def want(g):
        e = lambda s, n: s.ewm(span=n, adjust=False).mean()
        m = e(g.close, 12) - e(g.close, 26)
        return pd.DataFrame({"macd": m, "signal": e(m, 9), "hist": m - e(m, 9)})

    close_to(got, expect(prices, want), ["macd", "signal", "hist"])


def test_rsi(bars, prices):
    got = collect(se.own_rows(se.rsi(se.with_history(se.blocked(bars)))), ["rsi14"])

    def want(g):
        d = g.close.diff()
        up, down = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
        return pd.DataFrame({"rsi14": 100 - 100 / (1 + up / down), "flat": (up.abs() < 1e-9) & (down.abs() < 1e-9)})

    w = expect(prices, want)
    known = ~w["flat"]
    np.testing.assert_allclose(got["rsi14"].astype(float)[known], w["rsi14"][known], rtol=1e-6)
    assert got["rsi14"][w["flat"]].isna().all()


def test_kdj(bars, prices):
    rows = se.own_rows(se.raw_stochastic(se.with_history(se.blocked(bars))))
    got = collect(se.kdj(rows), ["k", "d", "j"])

    def want(g):
        lo, hi = g.low.rolling(9).min(), g.high.rolling(9).max()
        rsv = (g.close - lo) / (hi - lo).where(hi > lo) * 100
        k = rsv.ewm(com=2).mean()
        d = k.ewm(com=2).mean()
        return pd.DataFrame({"k": k, "d": d, "j": 3 * k - 2 * d})

    close_to(got, expect(prices, want), ["k", "d", "j"])


def test_forward_returns(spark):
    day = lambda s: pd.Timestamp(s).date()
    bars = spark.createDataFrame(pd.DataFrame({"symbol": "s", "trade_date": [day("2020-01-02"), day("2020-01-05"), day("2020-12-30")], "close": [11.0, 12.0, 30.0]}))
    anchor = spark.createDataFrame([("s", day("2020-01-01"), 10.0), ("t", day("2020-01-01"), 1.0)], "symbol string, end_date date, last_close double")
    rows = {r["symbol"]: r for r in se.forward_returns(anchor, bars).collect()}
    s = rows["s"]
    assert (s["close_1d"], s["close_3d"], s["close_4d"], s["close_360d"]) == (11.0, 11.0, 12.0, 12.0)
    assert s["pct_change_1d"] == pytest.approx(10.0) and rows["t"]["close_360d"] is None


def test_patterns(spark):
    def run(*ohlc):
        rows = [("s", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).date(), *map(float, x), 1.0) for i, x in enumerate(ohlc)]
        df = spark.createDataFrame(rows, "symbol string, trade_date date, open double, high double, low double, close double, vol double")
        last = se.candlestick_patterns(se.with_history(se.blocked(df))).orderBy(F.desc("n")).first()
        return {p for p in se.PATTERNS if last[p]}

    assert "bullish_engulfing" in run((10, 10, 8, 9), (8, 12, 8, 12))
    assert "bearish_engulfing" in run((9, 10, 9, 10), (11, 11, 8, 8))
    assert "three_white_soldiers" in run((1, 2, 1, 2), (2, 3, 1.5, 3), (3, 4, 2.5, 4))
    assert "three_black_crows" in run((4, 4, 3, 3), (3, 3.5, 2, 2), (2, 2.5, 1, 1))
    assert {"harami", "harami_cross"} <= run((10, 20, 10, 20), (15, 16, 14, 15))
    assert "morning_star" in run((20, 20, 10, 10), (10, 11, 9, 10.2), (11, 19, 11, 19))
    assert run((1, 1, 1, 1)) == set()


def test_random_period(spark):
    rows = se.random_period(spark.range(300).withColumnRenamed("id", "k"), "k", "2026-01-01").select(F.datediff("end_date", "start_date")).collect()
    assert 60 <= min(r[0] for r in rows) and max(r[0] for r in rows) <= 250


@pytest.mark.parametrize("span", [1, 3, 60, 250, 3000])
def test_long_and_short_averages(bars, prices, span):
    got = se.ema(se.blocked(bars), {"e": ("close", span)}).toPandas().sort_values(["symbol", "n"])
    for symbol, part in got.groupby("symbol"):
        want = prices[prices.symbol == symbol].sort_values("trade_date").close.ewm(span=span, adjust=False).mean()
        assert np.allclose(part.e, want, rtol=1e-12)


@pytest.mark.parametrize("com", [0.01, 0.2, 300.0])
def test_weighted_averages_of_any_weight(bars, prices, com):
    got = se.weighted_ema(se.blocked(bars), "e", "close", com).toPandas().sort_values(["symbol", "n"])
    for symbol, part in got.groupby("symbol"):
        want = prices[prices.symbol == symbol].sort_values("trade_date").close.ewm(com=com, ignore_na=False).mean()
        assert np.allclose(part.e, want, rtol=1e-10)


def test_windows_beyond_the_history(bars, prices):
    with pytest.raises(ValueError):
        se.bollinger(se.with_history(se.blocked(bars)), 400)
    rows = se.own_rows(se.bollinger(se.with_history(se.blocked(bars), history=400), 400, history=400)).toPandas()
    for symbol, part in rows.sort_values(["symbol", "n"]).groupby("symbol"):
        close = prices[prices.symbol == symbol].sort_values("trade_date").close
        want = close.rolling(400).mean() + 2 * close.rolling(400).std()
        assert np.allclose(part.upper_band.astype(float), want, equal_nan=True)
