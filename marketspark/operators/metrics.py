"""Performance of return series, per (symbol, model): one window pass and grouped aggregates. Only finite returns count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.windows import finite, ratio, roll

KEYS = ("symbol", "model")
YEAR = 252


def rate_per_period(annual: float, periods: int = YEAR) -> float:
    if periods <= 0:
        raise ValueError("periods must be positive")
    return (1.0 + annual) ** (1.0 / periods) - 1.0


def annualized_return(r: Column, periods: int = YEAR, log: bool = False) -> Column:
    growth = F.exp(F.sum(r)) if log else F.product(1 + r)
    return F.when(growth > 0, F.pow(growth, periods / F.count(r))) - 1


def annualized_volatility(r: Column, periods: int = YEAR) -> Column:
    return F.stddev_pop(r) * periods**0.5


def downside_std(r: Column, mar: float = 0.0, periods: int = YEAR) -> Column:
    return F.sqrt(F.avg(F.pow(F.when(r.isNotNull(), F.least(r - mar, F.lit(0.0))), 2))) * periods**0.5


def sharpe(r: Column, rf: float = 0.0, periods: int = YEAR) -> Column:
    return ratio(F.avg(r) - rate_per_period(rf, periods), F.stddev_pop(r)) * periods**0.5


def sortino(r: Column, mar: float = 0.0, periods: int = YEAR) -> Column:
    return ratio((F.avg(r) - mar) * periods, downside_std(r, mar, periods))


def hit_rate(r: Column) -> Column:
    return F.avg((r > 0).cast("double"))


def wealth(r: Column, over, start: float = 1.0, log: bool = False) -> Column:
    """Running wealth over an ordered window; a missing return leaves it as it is."""
    if start <= 0:
        raise ValueError("start must be positive")
    run = over.rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(r).over(run)) if log else F.product(1 + r).over(run)
    return start * F.coalesce(grown, F.lit(1.0))


def with_wealth(frame: DataFrame, keys: tuple[str, ...] = KEYS, returns: str = "net_return", start: float = 1.0, log: bool = False, gaps: bool = False) -> DataFrame:
    """Finite returns with wealth, its running peak, the peak's date (the earliest of equal ones) and drawdown; with ``gaps`` the other rows, too, without these."""
    w = Window.partitionBy(*keys).orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = frame.withColumn("_r", finite(F.col(returns).cast("double")))
    seen = F.col("_r").isNotNull()
    df = df.withColumn("wealth", F.when(seen, wealth(F.col("_r"), w, start, log))) if gaps else df.filter(seen).withColumn("wealth", wealth(F.col("_r"), w, start, log))
    top = F.max(F.when(seen, F.struct(F.col("wealth").alias("w"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")))).over(run)
    df = df.withColumn("_top", top)
    return df.withColumns({"peak": F.col("_top.w"), "peak_ts": F.timestamp_micros(-F.col("_top.t")), "drawdown": F.col("wealth") / F.col("_top.w") - 1}).drop("_top")


def worst(of: str = "drawdown") -> dict[str, Column]:
    """Max drawdown with its peak and trough dates; the first of equal troughs."""
    key = F.struct(of, "ts")
    return {"MaxDD": F.min(of), "peak": F.min_by("peak_ts", key), "trough": F.min_by("ts", key)}


def max_drawdown(frame: DataFrame, keys: tuple[str, ...] = KEYS, returns: str = "net_return") -> DataFrame:
    return with_wealth(frame, keys, returns).groupBy(*keys).agg(*(c.alias(n) for n, c in worst().items()))


def summary(frame: DataFrame, start: float = 1000.0, rf: float = 0.0, mar: float = 0.0, periods: int = YEAR, fold: str | None = None) -> DataFrame:
    lacking = {"net_return", "turnover", "transaction_cost"} - set(frame.columns)
    if lacking:
        raise ValueError(f"missing columns: {sorted(lacking)}")
    r = F.col("_r")
    out = with_wealth(frame, start=start, gaps=True).groupBy(*KEYS).agg(
        F.avg("turnover").alias("AvgTurnover"), (F.avg("turnover") * periods).alias("AnnTurnover"), F.sum("transaction_cost").alias("TotalCost"), F.count(r).alias("n_periods"), annualized_return(r, periods).alias("CAGR"), annualized_volatility(r, periods).alias("AnnVol"), sharpe(r, rf, periods).alias("Sharpe"), sortino(r, mar, periods).alias("Sortino"),
        F.min("drawdown").alias("MaxDD"), hit_rate(r).alias("HitRate"), F.max_by("wealth", F.when(r.isNotNull(), F.col("ts"))).alias("FinalWealth"),
    )
    return out.withColumn("fold", F.lit(fold)) if fold is not None else out


def _by_trade(frame: DataFrame, weight: str = "weight", returns: str = "net_return", least: float = 1e-6) -> DataFrame:
    """A row for each run of one non-zero side, and one without number for all other rows of a series. A weight of exactly ``least`` is a side."""
    w = Window.partitionBy(*KEYS).orderBy("ts")
    x = F.col(weight)
    df = frame.withColumn("side", F.when(F.abs(x) >= least, F.signum(x)).otherwise(0).cast("int"))
    df = df.withColumn("_new", ((F.col("side") != 0) & (F.col("side") != F.coalesce(F.lag("side").over(w), F.lit(0)))).cast("long"))
    df = df.withColumn("trade_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return of_trades(df, returns)


def of_trades(df: DataFrame, returns: str) -> DataFrame:
    """Rows with a side and a running number of trades, by trade."""
    df = df.withColumn("trade_id", F.when(F.col("side") != 0, F.col("trade_id")))
    r = finite(F.col(returns))
    return df.groupBy(*KEYS, "trade_id").agg(F.first("side").alias("side"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(r).alias("n_days"), F.sum(r).alias("pnl"))


def trades(frame: DataFrame, weight: str = "weight", returns: str = "net_return", least: float = 1e-6) -> DataFrame:
    """Runs of one non-zero side. A run without any return is left out, and its number stays unused."""
    return _with_results(_by_trade(frame, weight, returns, least))


def finish_trades(df: DataFrame, returns: str = "net_return") -> DataFrame:
    """Trades of rows with ``side`` and ``trade_id``, the number of trades begun so far."""
    return _with_results(of_trades(df, returns))


def _with_results(by_trade: DataFrame) -> DataFrame:
    out = by_trade.filter("trade_id is not null and n_days > 0")
    return out.withColumns({"pnl_per_day": F.col("pnl") / F.col("n_days"), "hit": (F.col("pnl") > 0).cast("int")})


def trade_summary(frame: DataFrame, weight: str = "weight", returns: str = "net_return", least: float = 1e-6) -> DataFrame:
    """Count, hit rate, mean and median result and length of the trades of every series, also of one without trades."""
    pnl = _of_trade(F.col("pnl"))
    return _by_trade(frame, weight, returns, least).groupBy(*KEYS).agg(*trade_results(), F.percentile(pnl, F.lit(0.5)).alias("MedianPnL_per_trade"))


def _of_trade(x: Column) -> Column:
    return F.when(F.col("trade_id").isNotNull() & (F.col("n_days") > 0), x)


def trade_results() -> list[Column]:
    """Aggregates of rows by trade, but for the median."""
    pnl = F.col("pnl")
    return [F.count(_of_trade(F.lit(1))).alias("Trades"), F.avg(_of_trade((pnl > 0).cast("int"))).alias("HitRate_trades"), F.avg(_of_trade(pnl)).alias("MeanPnL_per_trade"), F.avg(_of_trade(F.col("n_days"))).alias("AvgDays_per_trade")]


def attribution(frame: DataFrame, weight: str = "weight", returns: str = "net_return", least: float = 1e-6) -> DataFrame:
    x, r = F.col(weight), finite(F.col(returns))
    long, short = (x >= least) & r.isNotNull(), (x <= -least) & r.isNotNull()
    pnl = lambda side: F.coalesce(F.sum(F.when(side, r)), F.lit(0.0))
    out = frame.groupBy(*KEYS).agg(pnl(long).alias("PnL_long"), pnl(short).alias("PnL_short"), F.count_if(long).alias("Days_long"), F.count_if(short).alias("Days_short"))
    return out.withColumns({f"AvgPnL_day_{s}": ratio(F.col(f"PnL_{s}"), F.col(f"Days_{s}")) for s in ("long", "short")})


def _grouped(frame: DataFrame, keys: tuple[str, ...], periods: int) -> DataFrame:
    r = F.col("_r")
    return with_wealth(frame, keys).groupBy(*keys).agg(annualized_return(r, periods).alias("CAGR"), sharpe(r, 0.0, periods).alias("Sharpe"), F.min("drawdown").alias("MaxDD"), F.count(r).alias("Count"))


def yearly(frame: DataFrame, periods: int = YEAR) -> DataFrame:
    """Per calendar year (UTC session); wealth starts anew each year."""
    return _grouped(frame.withColumn("Year", F.year("ts")), (*KEYS, "Year"), periods).drop("Count")


def regimes(frame: DataFrame, window: int = 20, cuts: tuple[float, float] | None = None, periods: int = YEAR) -> DataFrame:
    """By realised volatility of earlier returns: low, mid, high at the given cut-offs or the sample's thirds. Empty ones have Count 0."""
    # rows without a return are set apart: the earlier returns of a row are those that exist
    w = Window.partitionBy(*KEYS, "_seen").orderBy("ts")
    df = frame.withColumn("_seen", finite(F.col("net_return")).isNotNull()).withColumn("_p", F.lag(finite(F.col("net_return"))).over(w))
    df = df.withColumn("_v", F.when(F.count("_p").over(roll(w, window)) == window, F.stddev_samp("_p").over(roll(w, window))))
    if cuts is None:
        df = df.withColumn("_c", F.percentile("_v", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy(*KEYS)))
    else:
        df = df.withColumn("_c", F.array(*map(F.lit, cuts)))
    v, lo, hi = F.col("_v"), F.col("_c")[0], F.col("_c")[1]
    df = df.withColumn("Regime", F.when(v <= lo, "low").when(v <= hi, "mid").when(v > hi, "high"))
    r, values = F.col("_r"), ["CAGR", "Sharpe", "MaxDD", "Count"]
    got = with_wealth(df, (*KEYS, "Regime"), gaps=True).groupBy(*KEYS, "Regime").agg(annualized_return(r, periods).alias("CAGR"), sharpe(r, 0.0, periods).alias("Sharpe"), F.min("drawdown").alias("MaxDD"), F.count(r).alias("Count"))
    # all regimes of a series in one row (at most four), so that those without rows appear, too
    found = F.map_from_entries(F.collect_list(F.struct(F.coalesce("Regime", F.lit("none")), F.struct(*values))))
    rows = got.groupBy(*KEYS).agg(found.alias("_found")).select(*KEYS, "_found", F.explode(F.array(*map(F.lit, ("low", "mid", "high")))).alias("Regime"))
    at = F.try_element_at("_found", "Regime")
    return rows.select(*KEYS, "Regime", *(F.coalesce(at[c], F.lit(0).cast("long")).alias(c) if c == "Count" else at[c].alias(c) for c in values))


def wealth_table(frame: DataFrame, models: list[str] | None = None, start: float = 1.0) -> DataFrame:
    """Wealth curves side by side: a column per model; give ``models`` to save a pass."""
    df = with_wealth(frame, start=start)
    return df.groupBy("symbol", "ts").pivot("model", models).agg(F.first("wealth"))


def infer_periods(frame: DataFrame, default: int = YEAR) -> DataFrame:
    """periods_per_year of each series from its median gap; the default for fewer than three dates."""
    w = Window.partitionBy(*KEYS).orderBy("ts")
    gap = frame.withColumn("_g", F.datediff("ts", F.lag("ts").over(w))).groupBy(*KEYS).agg(F.percentile("_g", F.lit(0.5)).alias("g"), F.count("_g").alias("n"))
    g = F.col("g")
    per = F.when(F.col("n") < 2, default).when(g <= 4, default).when(g <= 10, 52).when(g <= 45, 12).when(g <= 135, 4).otherwise(1)
    return gap.select(*KEYS, per.alias("periods_per_year"))
