"""Indicators, patterns and forward returns on daily bars.

bars(symbol, trade_date, open, high, low, close, vol), one row per symbol and day.
A symbol's series is cut into blocks of rows with enough history repeated in front of
each, so rolling windows of a long series run in many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from figcorpus.functions.draws import draw
from figcorpus.operators.ranking import with_position

# fixed values
AVERAGES = (5, 10, 20, 30, 60, 120, 250)
VOLUME_AVERAGES = (5, 10)
HORIZONS = (1, 2, 3, 4, 5, 10, 20, 30, 60, 90, 180, 360)
BLOCK = 512
HISTORY = 256
MIN_PERIOD_DAYS = 30


def blocked(bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds the row number ``n`` of each bar in its series and its block."""
    placed = with_position(bars, ["trade_date"], ("symbol",), "n")
    return placed.withColumn("block", F.floor((F.col("n") - 1) / block))


def with_history(rows: DataFrame, block: int = BLOCK, history: int = HISTORY) -> DataFrame:
    """Repeats the last rows of a block in front of the next one, marked by ``warm``.

    A window of k rows needs k - 1 of them; give the operators the same ``history``.
    """
    if history > block:
        raise ValueError("the history cannot be longer than a block")
    late = F.pmod(F.col("n") - 1, F.lit(block)) >= block - history
    homes = F.when(late, F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("w")), F.struct((F.col("block") + 1).alias("b"), F.lit(True).alias("w")))).otherwise(
        F.array(F.struct(F.col("block").alias("b"), F.lit(False).alias("w")))
    )
    return (
        rows.withColumn("_h", F.explode(homes))
        .withColumn("block", F.col("_h.b"))
        .withColumn("warm", F.col("_h.w"))
        .drop("_h")
    )


def own_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("warm")).drop("warm")


def _frame(k: int, history: int = HISTORY):
    if k - 1 > history:
        raise ValueError(f"a window of {k} rows needs a history of {k - 1}, not {history}")
    return W.partitionBy("symbol", "block").orderBy("n").rowsBetween(-(k - 1), 0)


def _back():
    return W.partitionBy("symbol", "block").orderBy("n")


def _full(value: Column, k: int) -> Column:
    """NULL until the window holds k rows."""
    return F.when(F.col("n") >= k, value)


def moving_averages(rows: DataFrame) -> DataFrame:
    """Simple averages of close and volume."""
    return rows.select(
        "*",
        *[_full(F.avg("close").over(_frame(k)), k).alias(f"ma{k}") for k in AVERAGES],
        *[_full(F.avg("vol").over(_frame(k)), k).alias(f"vol_ma{k}") for k in VOLUME_AVERAGES],
    )


def rsi(rows: DataFrame, k: int = 14, history: int = HISTORY) -> DataFrame:
    """Relative strength from plain means of gains and losses; the first change counts as 0."""
    delta = F.coalesce(F.col("close") - F.lag("close").over(_back()), F.lit(0.0))
    with_delta = rows.withColumn("_d", delta)
    gain = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(_frame(k, history))
    loss = F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(_frame(k, history))
    value = (
        F.when((F.col("_g") == 0) & (F.col("_l") == 0), F.lit(None).cast("double"))
        .when(F.col("_l") == 0, F.lit(100.0))
        .otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))
    )
    return (
        with_delta.withColumn("_g", gain)
        .withColumn("_l", loss)
        .withColumn(f"rsi{k}", _full(value, k))
        .drop("_d", "_g", "_l")
    )


def bollinger(rows: DataFrame, k: int = 20, width: float = 2.0, history: int = HISTORY) -> DataFrame:
    mean, std = F.avg("close").over(_frame(k, history)), F.stddev_samp("close").over(_frame(k, history))
    return rows.select(
        "*",
        _full(mean + width * std, k).alias("upper_band"),
        _full(mean - width * std, k).alias("lower_band"),
    )


def raw_stochastic(rows: DataFrame, k: int = 9, history: int = HISTORY) -> DataFrame:
    """Place of the close between the lowest low and highest high; NULL when they are equal."""
    low, high = F.min("low").over(_frame(k, history)), F.max("high").over(_frame(k, history))
    spread = F.nullif(high - low, F.lit(0.0))
    return rows.withColumn("rsv", _full((F.col("close") - low) / spread * 100, k))


def _folded(ends: Column, step: float) -> Column:
    """The last of s_i = step * s_(i-1) + e_i."""
    return F.aggregate(ends, F.lit(0.0), lambda s, e: s * step + e)


def _decayed_sums(rows: DataFrame, sums: dict[str, tuple[Column, float]]) -> DataFrame:
    """Adds s_t = decay * s_(t-1) + v_t for each name -> (v, decay), over the whole series.

    In a piece of rows this is a running sum of v / decay^i scaled back by
    decay^i; pieces are short enough that the powers stay finite. What came
    before enters through the ends of the pieces in front, one row each, as far
    back as a double can tell; a decay of 0 keeps the value itself.
    """
    least = min((d for _, d in sums.values() if d > 0), default=1.0)
    size = BLOCK if least == 1.0 else max(1, min(BLOCK, int(250 * math.log(10) / -math.log(least))))
    piece = F.floor((F.col("n") - 1) / size)
    i = F.pmod(F.col("n") - 1, F.lit(size)).cast("double")
    live = {name: (v, d) for name, (v, d) in sums.items() if d > 0}
    rows = rows.withColumns({name: v for name, (v, d) in sums.items() if d <= 0}).withColumn("_piece", piece)
    running = W.partitionBy("symbol", "_piece").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select(
        "*",
        *[
            (F.sum(v * F.pow(F.lit(d), -i)).over(running) * F.pow(F.lit(d), i)).alias(f"_{name}")
            for name, (v, d) in live.items()
        ],
    )
    if not live:
        return local.drop("_piece")
    ends = local.groupBy("symbol", "_piece").agg(*[F.max_by(f"_{name}", "n").alias(f"_e_{name}") for name in live])
    carried = []
    for name, (_, d) in live.items():
        far = 1 if d >= 1 else math.ceil(18 * math.log(10) / (size * -math.log(d)))
        before = F.collect_list(f"_e_{name}").over(W.partitionBy("symbol").orderBy("_piece").rowsBetween(-far, 0))
        carried.append(_folded(before, float(d**size)).alias(f"_e_{name}"))
    ends = ends.select("symbol", (F.col("_piece") + 1).alias("_piece"), *carried)
    joined = local.join(ends, ["symbol", "_piece"], "left")
    for name, (_, d) in live.items():
        joined = joined.withColumn(
            name, F.col(f"_{name}") + F.coalesce(f"_e_{name}", F.lit(0.0)) * F.pow(F.lit(d), i + 1)
        )
    return joined.drop("_piece", *[f"_{n}" for n in live], *[f"_e_{n}" for n in live])


def ema(rows: DataFrame, spans: dict[str, tuple[str, int]]) -> DataFrame:
    """Exponential averages name -> (column, span), started with the first value."""
    sums = {}
    for name, (col, span) in spans.items():
        a = 2.0 / (span + 1)
        sums[name] = (F.when(F.col("n") == 1, F.col(col)).otherwise(a * F.col(col)), 1 - a)
    return _decayed_sums(rows, sums)


def weighted_ema(rows: DataFrame, name: str, col: str, com: float) -> DataFrame:
    """Exponential average with normalised weights; missing values only let the weights decay."""
    d = com / (com + 1.0)
    summed = _decayed_sums(
        rows,
        {
            "_num": (F.coalesce(F.col(col), F.lit(0.0)), d),
            "_den": (F.col(col).isNotNull().cast("double"), d),
        },
    )
    return summed.withColumn(name, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_num", "_den")


def macd(rows: DataFrame) -> DataFrame:
    """Difference of the 12 and 26 day averages, its 9 day average, and their difference."""
    fast_slow = ema(rows, {"_e12": ("close", 12), "_e26": ("close", 26)})
    line = fast_slow.withColumn("macd", F.col("_e12") - F.col("_e26")).drop("_e12", "_e26")
    return ema(line, {"signal": ("macd", 9)}).withColumn("hist", F.col("macd") - F.col("signal"))


def kdj(rows_with_rsv: DataFrame) -> DataFrame:
    k = weighted_ema(rows_with_rsv, "k", "rsv", 2.0)
    d = weighted_ema(k, "d", "k", 2.0)
    return d.withColumn("j", 3 * F.col("k") - 2 * F.col("d"))


def rising(open_col="open", close_col="close") -> Column:
    """Colour flag of a bar: up when it does not close below its open."""
    return F.col(close_col) >= F.col(open_col)


def candlestick_patterns(rows: DataFrame) -> DataFrame:
    """Fifteen patterns of one to five bars as boolean columns.

    A body is long from 60 percent of its bar's range, small up to 30 percent, a cross up
    to 5 percent. The trend before bar k compares its close with the one three bars earlier.
    """
    back = _back()
    wide = rows.select(
        "*",
        *[
            F.lag(c, k).over(back).alias(f"_{c[0]}{k}")
            for c in ("open", "high", "low", "close")
            for k in range(1, 8 if c == "close" else 5)
        ],
    )
    o, h, lo, c = ([F.col(x)] + [F.col(f"_{x[0]}{k}") for k in range(1, 5)] for x in ("open", "high", "low", "close"))
    close = [F.col("close")] + [F.col(f"_c{k}") for k in range(1, 8)]

    def body(k):
        return F.abs(c[k] - o[k])

    def span(k):
        return h[k] - lo[k]

    def up(k):
        return c[k] > o[k]

    def down(k):
        return c[k] < o[k]

    def long(k):
        return (body(k) >= 0.6 * span(k)) & (span(k) > 0)

    def small(k):
        return body(k) <= 0.3 * span(k)

    def cross(k):
        return body(k) <= 0.05 * span(k)

    def uptrend(k):
        return close[k] > close[k + 3]

    def downtrend(k):
        return close[k] < close[k + 3]

    top = F.greatest(o[0], c[0])
    bottom = F.least(o[0], c[0])
    middle1 = (o[1] + c[1]) / 2
    middle2 = (o[2] + c[2]) / 2
    inside = (top < F.greatest(o[1], c[1])) & (bottom > F.least(o[1], c[1]))
    shadows = (h[0] - top, bottom - lo[0])
    patterns = {
        "dark_cloud_cover": uptrend(1) & up(1) & long(1) & down(0) & (o[0] > c[1]) & (c[0] < middle1) & (c[0] > o[1]),
        "evening_star": up(2) & long(2) & small(1) & down(0) & long(0) & (c[0] < middle2),
        "shooting_star": uptrend(1) & small(0) & (shadows[0] >= 2 * body(0)) & (shadows[1] <= 0.1 * span(0)) & (span(0) > 0),
        "bearish_engulfing": up(1) & down(0) & (o[0] >= c[1]) & (c[0] <= o[1]) & (body(0) > body(1)),
        "morning_star": down(2) & long(2) & small(1) & up(0) & long(0) & (c[0] > middle2),
        "piercing_line": downtrend(1) & down(1) & long(1) & up(0) & (o[0] < c[1]) & (c[0] > middle1) & (c[0] < o[1]),
        "hammer": downtrend(1) & small(0) & (shadows[1] >= 2 * body(0)) & (shadows[0] <= 0.1 * span(0)) & (span(0) > 0),
        "bullish_engulfing": down(1) & up(0) & (o[0] <= c[1]) & (c[0] >= o[1]) & (body(0) > body(1)),
        "rising_three": up(4) & long(4) & down(3) & down(2) & down(1) & (F.least(lo[3], lo[2], lo[1]) >= lo[4]) & up(0) & long(0) & (c[0] > c[4]),
        "falling_three": down(4) & long(4) & up(3) & up(2) & up(1) & (F.greatest(h[3], h[2], h[1]) <= h[4]) & down(0) & long(0) & (c[0] < c[4]),
        "three_black_crows": down(2) & long(2) & down(1) & long(1) & down(0) & long(0) & (c[1] < c[2]) & (c[0] < c[1]) & (h[1] < h[2]) & (h[0] < h[1]),
        "three_white_soldiers": up(2) & long(2) & up(1) & long(1) & up(0) & long(0) & (c[1] > c[2]) & (c[0] > c[1]) & (lo[1] > lo[2]) & (lo[0] > lo[1]),
        "harami": long(1) & small(0) & inside,
        "harami_cross": long(1) & cross(0) & inside,
        "counterattack_top": uptrend(1) & up(1) & (o[0] > c[1]) & down(0) & (c[0] < h[1]),
    }
    marked = wide.select("*", *[F.coalesce(v, F.lit(False)).alias(k) for k, v in patterns.items()])
    return marked.drop(*[x for x in wide.columns if x.startswith("_")])


PATTERNS = (
    "dark_cloud_cover evening_star shooting_star bearish_engulfing morning_star piercing_line hammer bullish_engulfing "
    "rising_three falling_three three_black_crows three_white_soldiers harami harami_cross counterattack_top"
).split()


def forward_returns(anchors: DataFrame, bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Close d days after each anchor and its change in percent: that very day, else the
    latest day in between; NULL without any.

    anchors(symbol, end_date, last_close). Both sides are filed by symbol and a span of
    days as long as the longest horizon, an anchor under its own span and the next, so a
    join key never holds more than two spans of a series.
    """
    width = max(horizons)
    day = F.datediff("trade_date", F.lit("1970-01-01").cast("date"))
    a = anchors.withColumn(
        "_span",
        F.explode(
            F.array(*[F.floor(F.datediff("end_date", F.lit("1970-01-01").cast("date")) / width) + k for k in (0, 1)])
        ),
    )
    b = bars.select("symbol", F.col("trade_date").alias("_date"), F.col("close").alias("_close"), F.floor(day / width).alias("_span"))
    ahead = F.datediff("_date", "end_date")
    hits = a.join(b, ["symbol", "_span"], "left").withColumn("_ahead", F.when(ahead.between(1, width), ahead))
    # max_by skips rows without an order value
    out = hits.groupBy("symbol", "end_date").agg(
        F.first("last_close").alias("last_close"),
        *[F.max_by("_close", F.when(F.col("_ahead") <= d, F.col("_ahead"))).alias(f"close_{d}d") for d in horizons],
    )
    return out.select(
        "*",
        *[
            ((F.col(f"close_{d}d") - F.col("last_close")) / F.col("last_close") * 100).alias(f"pct_change_{d}d")
            for d in horizons
        ],
    )


def period_summary(bars: DataFrame, period: Column, least_days: int = MIN_PERIOD_DAYS) -> DataFrame:
    """First and last price, change, extremes and mean volume per symbol and period."""
    return (
        bars.groupBy("symbol", period.alias("period"))
        .agg(
            F.count("*").alias("period_days"),
            F.min_by("close", "trade_date").alias("start_price"),
            F.max_by("close", "trade_date").alias("end_price"),
            F.max("high").alias("max_price"),
            F.min("low").alias("min_price"),
            F.avg("vol").alias("avg_volume"),
        )
        .where(F.col("period_days") >= least_days)
        .withColumn(
            "period_pct_change", (F.col("end_price") - F.col("start_price")) / F.col("start_price") * 100
        )
    )


def join_symbol_info(bars: DataFrame, info: DataFrame, text_cols: list[str]) -> DataFrame:
    """Bars with their symbol's attributes; missing texts read "Unknown", missing numbers stay NULL."""
    joined = bars.join(info, "symbol", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in text_cols})


def random_period(keys: DataFrame, key: str, as_of: str, seed: int = 0) -> DataFrame:
    """A period of 60 to 250 days that ends a year before ``as_of``, drawn by a seeded hash."""
    end = F.date_sub(F.lit(as_of).cast("date"), 365)
    length = (draw(key, seed=seed) % 191 + 60).cast("int")
    return keys.withColumn("end_date", end).withColumn("start_date", F.date_sub(F.col("end_date"), length))
