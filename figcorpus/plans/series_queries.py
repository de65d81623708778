"""Queries over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions.draws import draw_sql
from figcorpus.operators import series as se
from figcorpus.plans import fixtures as fx
from figcorpus.plans.registry import query, table

B = f"bars AS ({fx.BARS_SQL}), nb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) n FROM bars)"


def _rows(spark, sf):
    return se.with_history(se.blocked(fx.bars(spark, sf)))


def _rounded(df, cols, digits=4):
    return df.select("symbol", "trade_date", *[F.round(c, digits).alias(c) for c in cols])


def _avg(col, k):
    return f"CASE WHEN n>={k} THEN round(avg({col}) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW),6) END"


@query(
    "e01_moving_averages",
    f"WITH {B} SELECT symbol, trade_date, "
    + ", ".join([f"{_avg('close', k)} ma{k}" for k in se.AVERAGES] + [f"{_avg('vol', k)} vol_ma{k}" for k in se.VOLUME_AVERAGES])
    + " FROM nb",
)
def e01(spark, sf):
    out = se.own_rows(se.moving_averages(_rows(spark, sf)))
    return _rounded(out, [f"ma{k}" for k in se.AVERAGES] + [f"vol_ma{k}" for k in se.VOLUME_AVERAGES], 6)


@query(
    "e02_macd",
    f"""WITH RECURSIVE {B}, r AS (
      SELECT symbol, trade_date, n, close e12, close e26, 0.0::DOUBLE sig FROM nb WHERE n=1
      UNION ALL
      SELECT b.symbol, b.trade_date, b.n, r.e12*(1-2/13.0::DOUBLE)+b.close*2/13.0::DOUBLE, r.e26*(1-2/27.0::DOUBLE)+b.close*2/27.0::DOUBLE,
        r.sig*(1-2/10.0::DOUBLE)+(r.e12*(1-2/13.0::DOUBLE)+b.close*2/13.0::DOUBLE-r.e26*(1-2/27.0::DOUBLE)-b.close*2/27.0::DOUBLE)*2/10.0::DOUBLE
      FROM r JOIN nb b ON b.symbol=r.symbol AND b.n=r.n+1)
    SELECT symbol, trade_date, round(e12-e26,4)+0 macd, round(sig,4)+0 signal, round(e12-e26-sig,4)+0 hist FROM r""",
)
def e02(spark, sf):
    return _rounded(se.macd(se.blocked(fx.bars(spark, sf))), ["macd", "signal", "hist"])


@query(
    "e03_rsi14",
    f"""WITH {B}, d AS (SELECT *, coalesce(close-lag(close) OVER (PARTITION BY symbol ORDER BY n),0) d FROM nb),
    g AS (SELECT symbol, trade_date, n, avg(greatest(d,0)) OVER w g, avg(greatest(-d,0)) OVER w l FROM d WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT symbol, trade_date, round(CASE WHEN n<14 OR (g=0 AND l=0) THEN NULL WHEN l=0 THEN 100 ELSE 100-100/(1+g/l) END,4) rsi14 FROM g""",
)
def e03(spark, sf):
    return _rounded(se.own_rows(se.rsi(_rows(spark, sf))), ["rsi14"])


@query(
    "e04_bollinger",
    f"""WITH {B}, m AS (SELECT symbol, trade_date, n, avg(close) OVER w a, stddev_samp(close) OVER w s FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT symbol, trade_date, round(CASE WHEN n>=20 THEN a+2*s END,4) upper_band, round(CASE WHEN n>=20 THEN a-2*s END,4) lower_band FROM m""",
)
def e04(spark, sf):
    return _rounded(se.own_rows(se.bollinger(_rows(spark, sf))), ["upper_band", "lower_band"])


@query(
    "e05_kdj",
    f"""WITH RECURSIVE {B}, v AS (SELECT symbol, trade_date, n, CASE WHEN n>=9 AND max(high) OVER w>min(low) OVER w THEN (close-min(low) OVER w)/(max(high) OVER w-min(low) OVER w)*100 END rsv
        FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
    r AS (SELECT symbol, trade_date, n, 0.0::DOUBLE kn, 0.0::DOUBLE kd, 0.0::DOUBLE dn, 0.0::DOUBLE dd FROM v WHERE n=1
      UNION ALL
      SELECT x.symbol, x.trade_date, x.n, r.kn*2/3+coalesce(x.rsv,0), r.kd*2/3+(x.rsv IS NOT NULL)::INT,
        r.dn*2/3+CASE WHEN r.kd*2/3+(x.rsv IS NOT NULL)::INT>0 THEN (r.kn*2/3+coalesce(x.rsv,0))/(r.kd*2/3+(x.rsv IS NOT NULL)::INT) ELSE 0 END,
        r.dd*2/3+(r.kd*2/3+(x.rsv IS NOT NULL)::INT>0)::INT
      FROM r JOIN v x ON x.symbol=r.symbol AND x.n=r.n+1)
    SELECT symbol, trade_date, round(CASE WHEN kd>0 THEN kn/kd END,4) k, round(CASE WHEN dd>0 THEN dn/dd END,4) d,
      round(CASE WHEN dd>0 THEN 3*kn/kd-2*dn/dd END,4)+0 j FROM r""",
)
def e05(spark, sf):
    rows = se.own_rows(se.raw_stochastic(_rows(spark, sf)))
    return _rounded(se.kdj(rows), ["k", "d", "j"])


LAGS = ", ".join(
    f"lag({c},{k}) OVER w {c[0]}{k}" for c in ("open", "high", "low", "close") for k in range(1, 8 if c == "close" else 5)
)


def _pattern_sql() -> str:
    def body(k):
        return f"abs(c{k}-o{k})"

    def span(k):
        return f"(h{k}-l{k})"

    def long(k):
        return f"({body(k)}>=0.6::DOUBLE*{span(k)} AND {span(k)}>0)"

    def small(k):
        return f"({body(k)}<=0.3::DOUBLE*{span(k)})"

    inside = "(greatest(o0,c0)<greatest(o1,c1) AND least(o0,c0)>least(o1,c1))"
    rules = {
        "dark_cloud_cover": f"c1>c4 AND c1>o1 AND {long(1)} AND c0<o0 AND o0>c1 AND c0<(o1+c1)/2 AND c0>o1",
        "evening_star": f"c2>o2 AND {long(2)} AND {small(1)} AND c0<o0 AND {long(0)} AND c0<(o2+c2)/2",
        "shooting_star": f"c1>c4 AND {small(0)} AND h0-greatest(o0,c0)>=2*{body(0)} AND least(o0,c0)-l0<=0.1::DOUBLE*{span(0)} AND {span(0)}>0",
        "bearish_engulfing": f"c1>o1 AND c0<o0 AND o0>=c1 AND c0<=o1 AND {body(0)}>{body(1)}",
        "morning_star": f"c2<o2 AND {long(2)} AND {small(1)} AND c0>o0 AND {long(0)} AND c0>(o2+c2)/2",
        "piercing_line": f"c1<c4 AND c1<o1 AND {long(1)} AND c0>o0 AND o0<c1 AND c0>(o1+c1)/2 AND c0<o1",
        "hammer": f"c1<c4 AND {small(0)} AND least(o0,c0)-l0>=2*{body(0)} AND h0-greatest(o0,c0)<=0.1::DOUBLE*{span(0)} AND {span(0)}>0",
        "bullish_engulfing": f"c1<o1 AND c0>o0 AND o0<=c1 AND c0>=o1 AND {body(0)}>{body(1)}",
        "rising_three": f"c4>o4 AND {long(4)} AND c3<o3 AND c2<o2 AND c1<o1 AND least(l3,l2,l1)>=l4 AND c0>o0 AND {long(0)} AND c0>c4",
        "falling_three": f"c4<o4 AND {long(4)} AND c3>o3 AND c2>o2 AND c1>o1 AND greatest(h3,h2,h1)<=h4 AND c0<o0 AND {long(0)} AND c0<c4",
        "three_black_crows": f"c2<o2 AND {long(2)} AND c1<o1 AND {long(1)} AND c0<o0 AND {long(0)} AND c1<c2 AND c0<c1 AND h1<h2 AND h0<h1",
        "three_white_soldiers": f"c2>o2 AND {long(2)} AND c1>o1 AND {long(1)} AND c0>o0 AND {long(0)} AND c1>c2 AND c0>c1 AND l1>l2 AND l0>l1",
        "harami": f"{long(1)} AND {small(0)} AND {inside}",
        "harami_cross": f"{long(1)} AND {body(0)}<=0.05::DOUBLE*{span(0)} AND {inside}",
        "counterattack_top": "c1>c4 AND c1>o1 AND o0>c1 AND c0<o0 AND c0<h1",
    }
    return ", ".join(f"coalesce({v}, false) {k}" for k, v in rules.items())


@query(
    "e16_candlestick_patterns",
    f"""WITH {B}, x AS (SELECT symbol, trade_date, open o0, high h0, low l0, close c0, {LAGS} FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY n))
    SELECT symbol, trade_date, {_pattern_sql()} FROM x""",
)
def e16(spark, sf):
    return se.own_rows(se.candlestick_patterns(_rows(spark, sf))).select("symbol", "trade_date", *se.PATTERNS)


@query(
    "b35_chart_color",
    f"WITH {B} SELECT symbol, trade_date, close>=open rising FROM bars",
)
def b35(spark, sf):
    return fx.bars(spark, sf).select("symbol", "trade_date", se.rising().alias("rising"))


def _anchors(spark, sf):
    bars = fx.bars(spark, sf)
    return bars.groupBy("symbol", F.year("trade_date").alias("y")).agg(
        F.max("trade_date").alias("end_date"), F.max_by("close", "trade_date").alias("last_close")
    ).drop("y")


@query(
    "c19_asof_forward",
    f"""WITH {B}, a AS (SELECT symbol, max(trade_date) end_date, arg_max(close, trade_date) last_close FROM bars GROUP BY symbol, year(trade_date))
    , g AS (SELECT a.symbol, a.end_date, a.last_close, """
    + ", ".join(f"arg_max(b.close, b.trade_date) FILTER (b.trade_date<=a.end_date+{d}) close_{d}d" for d in se.HORIZONS)
    + """ FROM a LEFT JOIN bars b ON b.symbol=a.symbol AND b.trade_date>a.end_date AND b.trade_date<=a.end_date+360 GROUP BY a.symbol, a.end_date, a.last_close)
    SELECT *, """
    + ", ".join(f"round((close_{d}d-last_close)/last_close*100,6) pct_change_{d}d" for d in se.HORIZONS)
    + " FROM g",
)
def c19(spark, sf):
    out = se.forward_returns(_anchors(spark, sf), fx.bars(spark, sf))
    return out.withColumns({f"pct_change_{d}d": F.round(f"pct_change_{d}d", 6) for d in se.HORIZONS})


@query(
    "d15_period_summary",
    f"""WITH {B} SELECT symbol, year(trade_date)::BIGINT period, count(*) period_days, arg_min(close, trade_date) start_price, arg_max(close, trade_date) end_price,
    max(high) max_price, min(low) min_price, round(avg(vol),6) avg_volume, round((arg_max(close, trade_date)-arg_min(close, trade_date))/arg_min(close, trade_date)*100,6) period_pct_change
    FROM bars GROUP BY 1,2 HAVING count(*)>=30""",
)
def d15(spark, sf):
    out = se.period_summary(fx.bars(spark, sf), F.year("trade_date"))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_volume", "period_pct_change")})


@query(
    "c21_join_symbol_info",
    f"""WITH {B}, i AS (SELECT o_orderpriority symbol, max(o_orderstatus) market, avg(o_totalprice) pe FROM orders WHERE o_orderpriority<'4' GROUP BY 1)
    SELECT b.symbol, b.trade_date, coalesce(i.market,'Unknown') market, round(i.pe,4) pe FROM bars b LEFT JOIN i USING (symbol)""",
)
def c21(spark, sf):
    info = (
        table(spark, sf, "orders")
        .where("o_orderpriority < '4'")
        .groupBy(F.col("o_orderpriority").alias("symbol"))
        .agg(F.max("o_orderstatus").alias("market"), F.avg("o_totalprice").alias("pe"))
    )
    out = se.join_symbol_info(fx.bars(spark, sf).select("symbol", "trade_date"), info, ["market"])
    return out.withColumn("pe", F.round("pe", 4))


@query(
    "f08_random_period",
    f"""SELECT c_custkey, DATE '2026-01-01' - 365 end_date,
    DATE '2026-01-01' - 365 - ({draw_sql("c_custkey")} % 191 + 60)::INT start_date FROM customer""",
)
def f08(spark, sf):
    return se.random_period(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "2026-01-01")
