"""Named queries over the derived daily panel, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.columns import SIC_SECTORS, by_symbol, code_sector, cost_fraction, rounded
from barloom.operators import checks, membership, metrics, portfolio
from barloom.operators.factors import LOOK_BACK, RANKS, factors, scored
from barloom.plans import backfill, expressions, ingest, jobs, mining, outputs, reports, signals, walk_forward
from barloom.sources import html as html_source
from barloom.sources import files, panel, report, sessions, settings, vendor, warehouse
from barloom.sources.session import shared_folder
from barloom.sources.store import Store
from barloom.streaming import live

MIN_ADV, TOP_K, MAX_W, SECTOR_CAP = 1000.0, 10, 0.15, 0.35

#: Trading days among which the last two with weights are looked for first.
RECENT = 20

BARS = """
lines AS (SELECT CAST(l_shipdate AS DATE) AS date, upper(s_name) AS symbol, lineitem.* FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 0),
day AS (SELECT date, symbol, min({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_quantity, 'e': l_extendedprice}) AS f,
  max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS dollar_volume,
  CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS disc FROM lines GROUP BY date, symbol),
bars AS (SELECT date, symbol, f.e / f.d AS open, high, low, dollar_volume / volume AS close, dollar_volume / volume * (1 - disc) AS adj_close, volume, dollar_volume FROM day)
"""
SECTORS = """
sectors AS (SELECT symbol, f.b AS sector FROM (SELECT upper(s_name) AS symbol, min({'a': s_suppkey, 'b': r_name}) AS f
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1))
"""
CALENDAR = "calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_shipdate IS NOT NULL))"
CONSTITUENTS = """
constituents AS (SELECT upper(s_name) AS code, min(CAST(l_shipdate AS DATE)) AS start_date, CASE WHEN s_suppkey % 7 <> 0 THEN least(max(CAST(l_shipdate AS DATE)), CASE WHEN s_suppkey % 5 = 0 THEN DATE '2000-12-31' ELSE DATE '9999-12-31' END) END AS end_date, s_suppkey AS permno
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name)
"""
MEMBERS = f"{CONSTITUENTS}, {CALENDAR}, members AS (SELECT c.date, code AS symbol, max(permno) AS permno FROM constituents JOIN calendar c ON c.date >= start_date AND c.date <= coalesce(end_date, DATE '2001-12-31') GROUP BY 1, 2)"
_w = lambda n: f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_ret = lambda k: f"CASE WHEN lag(adj_close, {k}) OVER s <> 0 THEN adj_close / lag(adj_close, {k}) OVER s END - 1"
FACTORS = f"""
{BARS},
rets AS (SELECT *, {_ret(1)} AS ret_1d, {_ret(5)} AS mom_5d, {_ret(21)} AS mom_21d, {_ret(252)} AS mom_252d FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)),
rolled AS (SELECT *,
  CASE WHEN count(ret_1d) {_w(21)} >= 10 THEN stddev_samp(ret_1d) {_w(21)} END AS vol_21d,
  CASE WHEN count(ret_1d) {_w(63)} >= 20 THEN stddev_samp(ret_1d) {_w(63)} END AS vol_63d,
  CASE WHEN count(*) {_w(5)} >= 3 THEN CAST(sum(CAST(dollar_volume AS DECIMAL(18,2))) {_w(5)} AS DOUBLE) / count(*) {_w(5)} END AS adv5,
  CASE WHEN count(*) {_w(20)} >= 10 THEN CAST(sum(CAST(dollar_volume AS DECIMAL(18,2))) {_w(20)} AS DOUBLE) / count(*) {_w(20)} END AS adv20 FROM rets),
factors AS (SELECT *, -mom_5d AS rev_5d, vol_21d / nullif(vol_63d, 0) AS vol_ratio, adv5 / nullif(adv20, 0) AS volume_accel, (high - low) / nullif(close, 0) AS range FROM rolled)
"""


def _rank_sql(name: str, factor: str, up: bool) -> str:
    o = f"PARTITION BY date ORDER BY round({factor}, 9) {'ASC' if up else 'DESC'} NULLS LAST"
    peers = f"count(*) OVER ({o} RANGE BETWEEN CURRENT ROW AND CURRENT ROW)"
    return f"CASE WHEN {factor} IS NOT NULL THEN (rank() OVER ({o}) + ({peers} - 1) / 2.0::DOUBLE) / count({factor}) OVER (PARTITION BY date) END AS {name}"


SCORED = f"""
{FACTORS},
ranked AS (SELECT *, {', '.join(_rank_sql(*r) for r in RANKS)} FROM factors),
scored AS (SELECT *, ({' + '.join(f'coalesce({n}, 0)' for n, _, _ in RANKS)}) / nullif({' + '.join(f'({n} IS NOT NULL)::INT' for n, _, _ in RANKS)}, 0) AS score FROM ranked),
{MEMBERS},
eligible AS (SELECT * FROM scored SEMI JOIN members USING (date, symbol) WHERE coalesce(adv20, 0) >= {MIN_ADV} AND score IS NOT NULL)
"""
_o = "ORDER BY round(score, 9) DESC, symbol"
_prev = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _weights_sql(capped: bool) -> str:
    tw = min(1 / TOP_K, MAX_W)
    a = f"greatest(0, least({tw}::DOUBLE, {SECTOR_CAP}::DOUBLE - (row_number() OVER (PARTITION BY date, sector {_o}) - 1) * {tw}::DOUBLE))" if capped else f"{tw}::DOUBLE"
    b = f"greatest(0, least(room, {SECTOR_CAP}::DOUBLE - used - coalesce(sum(room) OVER (PARTITION BY date, sector {_o} {_prev}), 0)))" if capped else "room"
    used = "sum(a) OVER (PARTITION BY date, sector)" if capped else "0"
    return f"""
{SCORED}, {SECTORS},
w0 AS (SELECT date, symbol, score, coalesce(sector, 'Unknown') AS sector FROM eligible LEFT JOIN sectors USING (symbol)),
w1 AS (SELECT *, {a} AS a FROM w0),
w2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date {_o}) AS rn FROM w1 WHERE a > 1e-10) WHERE rn <= {TOP_K}),
w3 AS (SELECT *, {used} AS used, greatest(1 - sum(a) OVER (PARTITION BY date), 0) AS rest, {MAX_W}::DOUBLE - a AS room FROM w2),
w4 AS (SELECT *, {b} AS b FROM w3),
w5 AS (SELECT *, a + CASE WHEN rest > 1e-10 THEN greatest(0, least(b, rest - coalesce(sum(b) OVER (PARTITION BY date {_o} {_prev}), 0))) ELSE 0 END AS w FROM w4),
w6 AS (SELECT *, sum(w) OVER (PARTITION BY date) AS total FROM w5),
weights AS (SELECT date, symbol, CASE WHEN total > 1 + 1e-10 THEN w / total ELSE w END AS weight FROM w6 WHERE w > 1e-8)
"""


DAILY = f"{FACTORS}, daily AS (SELECT date, round(avg(ret_1d) / 100, 10) AS r FROM factors WHERE ret_1d IS NOT NULL GROUP BY date)"

Q: dict = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = (f, sql)
        return f

    return put


def _round(x, digits: int):
    return rounded(F.col(x) if isinstance(x, str) else x, digits)


def _factors(spark, d, read: panel.Read = panel.table) -> DataFrame:
    return factors(panel.bars(spark, d, read))


def _scored(spark, d) -> DataFrame:
    return scored(_factors(spark, d), ("date", "symbol"))


def _eligible(spark, d, rows: DataFrame | None = None) -> DataFrame:
    """Members with enough volume and a score, of scored rows; by default all, with their sectors.

    By default members and sectors are looked up while rows still lie by symbol, before they are ranked by date.
    """
    if rows is None:
        return _eligible_of(_factors(spark, d), spark, d)
    return _while_members(portfolio.eligible(rows, MIN_ADV), spark, d).withColumn("score", _round("score", 9))


def _eligible_of(rows: DataFrame, spark, d, keep: tuple[str, ...] = ()) -> DataFrame:
    """_eligible() of rows with factors, which have all names of their dates; keep names columns that stay."""
    rows = scored(_with_sectors(_with_universe(rows, spark, d), spark, d), ("date", "symbol", "adv20", "active", "sector", *keep))
    return portfolio.eligible(rows.where("active"), MIN_ADV).withColumn("score", _round("score", 9))


def _with_sectors(rows: DataFrame, spark, d, read: panel.Read = panel.table) -> DataFrame:
    return rows.join(panel.sectors(spark, d, read).select("symbol", "sector"), "symbol", "left").fillna("Unknown", ["sector"])


def _while_members(rows: DataFrame, spark, d) -> DataFrame:
    return membership.while_members(rows, panel.constituents(spark, d), F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))


def _weights(spark, d, capped: bool = True, rows: DataFrame | None = None) -> DataFrame:
    rows = (_eligible(spark, d) if rows is None else rows).select("date", "symbol", "score", "sector")
    return portfolio.desired_weights(rows, TOP_K, MAX_W, SECTOR_CAP if capped else None)


def _kept_weights(spark, d, capped: bool = True, rows: DataFrame | None = None) -> DataFrame:
    """Weights as a stored table, which is small, for those who go over them more than once."""
    return _stored(_weights(spark, d, capped, rows), "weights")


def _recent_eligible(spark, d, until: str | None = None) -> DataFrame:
    """The last two dates of _eligible(), up to a date, as a stored table.

    All bars are made, and of each symbol the last rows go on, as many as scores of the last RECENT trading days look back on; prices
    are filled forward before that. Where these days have fewer than two dates of eligible names, all dates are ranked.
    """
    days = panel.calendar(spark, d).where(F.lit(True) if until is None else F.col("date") <= F.lit(until).cast("date"))
    days = [r["date"] for r in days.orderBy(F.desc("date")).limit(RECENT).collect()]
    names = ("date", "symbol", "score", "sector")
    dates = []
    if days:
        bars = panel.bars(spark, d).where(F.col("date") <= F.lit(days[0]))
        bars = bars.withColumns({"adj_close": F.last("adj_close", ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)), "barloom_later": F.lead("date", LOOK_BACK + RECENT).over(by_symbol())})
        rows = factors(bars.where("barloom_later is null").drop("barloom_later")).where(F.col("date") >= F.lit(days[-1]))
        rows = _stored(_eligible_of(rows, spark, d).select(*names), "eligible")
        dates = _last_dates(rows, 2)
    if len(dates) < 2:
        rows = _eligible(spark, d).select(*names)
        rows = _stored(rows if until is None else rows.where(F.col("date") <= F.lit(until).cast("date")), "eligible")
        dates = _last_dates(rows, 2)
    return rows.where(F.col("date").isin(dates))


def _last_dates(rows: DataFrame, n: int) -> list:
    return [r["date"] for r in rows.select("date").distinct().orderBy(F.desc("date")).limit(n).collect()]


def _daily(spark, d) -> DataFrame:
    return _factors(spark, d).where("ret_1d is not null").groupBy("date").agg(_round(F.avg("ret_1d") / 100, 10).alias("r"))


def _rounded(df: DataFrame, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *(_round(v, digits).alias(v) for v in values))


def _rounds(values: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({v}, {digits}) AS {v}" for v in values)


@query(f"WITH {BARS} SELECT date, symbol, {_rounds(['open', 'high', 'low', 'close', 'adj_close'])}, {_rounds(['volume', 'dollar_volume'], 2)} FROM bars")
def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    b = panel.bars(spark, d)
    return b.select("date", "symbol", *(_round(c, 6).alias(c) for c in ("open", "high", "low", "close", "adj_close")), *(_round(c, 2).alias(c) for c in ("volume", "dollar_volume")))


def _factor_query(name: str, values: list[str], digits: int = 6) -> None:
    def run(spark, d):
        return _rounded(_factors(spark, d), ["date", "symbol"], values, digits)

    Q[name] = (run, f"WITH {FACTORS} SELECT date, symbol, {_rounds(values, digits)} FROM factors")


_factor_query("factor_momentum", ["ret_1d", "mom_5d", "mom_21d", "mom_252d", "rev_5d"])
_factor_query("factor_volatility", ["vol_21d", "vol_63d", "vol_ratio"])
_factor_query("factor_liquidity", ["adv5", "adv20", "volume_accel"], 4)
_factor_query("factor_range", ["range"])


@query(f"WITH {SCORED} SELECT date, symbol, {_rounds([n for n, _, _ in RANKS])} FROM ranked")
def cs_rank(spark, d):
    return _rounded(_scored(spark, d), ["date", "symbol"], [n for n, _, _ in RANKS])


@query(f"WITH {SCORED} SELECT date, symbol, round(score, 6) AS score FROM scored")
def score(spark, d):
    return _rounded(_scored(spark, d), ["date", "symbol"], ["score"])


@query(f"WITH {SCORED}, latest AS (SELECT max(date) AS date FROM bars) SELECT date, symbol, round(score, 6) AS score, row_number() OVER ({_o}) AS rank FROM eligible JOIN latest USING (date) QUALIFY rank <= {TOP_K}")
def topk_signals(spark, d):
    """Of the latest day alone: its symbols' last rows, as many as a score looks back on, are all that factors are made of."""
    bars = panel.bars(spark, d)
    day = panel.table(spark, d, "lineitem").where("l_quantity > 0").agg(F.max(F.to_date("l_shipdate"))).first()[0]
    today = bars.where(F.col("date") == F.lit(day)).select("symbol")
    recent = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))) <= LOOK_BACK
    rows = factors(bars.join(today, "symbol", "left_semi").where(F.col("date") <= F.lit(day)).withColumn("recent", recent).where("recent").drop("recent"))
    top = _eligible(spark, d, scored(rows.where(F.col("date") == F.lit(day)))).orderBy(F.desc("score"), "symbol").limit(TOP_K)
    return top.select("date", "symbol", _round("score", 6).alias("score"), F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "symbol")).cast("long").alias("rank"))


@query(f"WITH {_weights_sql(False)} SELECT date, symbol, round(weight, 6) AS weight FROM weights")
def weights_equal(spark, d):
    return _rounded(_weights(spark, d, False), ["date", "symbol"], ["weight"])


@query(f"WITH {_weights_sql(True)} SELECT date, symbol, round(weight, 6) AS weight FROM weights")
def weights_sector_cap(spark, d):
    return _rounded(_weights(spark, d), ["date", "symbol"], ["weight"])


TURN = f"""
{_weights_sql(False)},
p AS (SELECT c2.date, symbol, weight AS p FROM weights JOIN calendar c1 USING (date) JOIN calendar c2 ON c2.idx = c1.idx + 1),
b AS (SELECT date, symbol, coalesce(weight, 0) AS d, coalesce(p, 0) AS p, count(p) OVER (PARTITION BY date) = 0 AS fresh FROM weights FULL JOIN p USING (date, symbol)),
t AS (SELECT *, 0.5::DOUBLE * sum(abs(d - p)) OVER (PARTITION BY date) AS turn FROM b),
m AS (SELECT *, fresh OR turn <= 0.2 AS free, CASE WHEN fresh OR turn <= 0.2 THEN d ELSE least(greatest(p + 0.2::DOUBLE / turn * (d - p), 0), {MAX_W}::DOUBLE) END AS w FROM t),
n AS (SELECT *, sum(w) OVER (PARTITION BY date) AS total FROM m)
SELECT date, symbol, round(CASE WHEN NOT free AND total > 1 THEN w / total ELSE w END, 6) AS weight FROM n WHERE CASE WHEN NOT free AND total > 1 THEN w / total ELSE w END > 1e-8
"""


@query("WITH " + TURN)
def turnover_step(spark, d):
    following = membership.shifted(panel.calendar(spark, d), 1)
    return _rounded(portfolio.turnover_steps(_weights(spark, d, False), following, 0.2, MAX_W), ["date", "symbol"], ["weight"])


@query(f"WITH {FACTORS} SELECT date, symbol, round(CASE WHEN dollar_volume * 0.01 > 0 THEN 0.00025::DOUBLE + CASE WHEN adv20 > 0 AND vol_21d > 0 THEN 0.1::DOUBLE * vol_21d * sqrt(dollar_volume * 0.01::DOUBLE / adv20) ELSE 0 END ELSE 0 END, 8) AS cost FROM factors")
def cost_estimate(spark, d):
    f = _factors(spark, d)
    return f.select("date", "symbol", _round(cost_fraction(F.col("dollar_volume") * 0.01, F.col("adv20"), F.col("vol_21d")), 8).alias("cost"))


#: The symbol that stands for the index fund.
BENCHMARK = "SUPPLIER#000000001"
OPENS = f"""{BARS}, {MEMBERS}, oo AS (SELECT a.date, a.symbol, CASE WHEN e.open > 0 AND x.open > 0 THEN x.open / e.open - 1 END AS ret, a.mom AS mom, m.symbol IS NOT NULL AS active FROM
  (SELECT bars.*, idx, adj_close / nullif(lag(adj_close, 252) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS mom FROM bars JOIN calendar USING (date)) a
  LEFT JOIN calendar ce ON ce.idx = a.idx + 1 LEFT JOIN calendar cx ON cx.idx = a.idx + 2 LEFT JOIN members m ON m.date = a.date AND m.symbol = a.symbol
  LEFT JOIN bars e ON e.symbol = a.symbol AND e.date = ce.date LEFT JOIN bars x ON x.symbol = a.symbol AND x.date = cx.date),
r AS (SELECT *, mom IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY round(mom, 9) DESC NULLS LAST, symbol) <= {TOP_K} AS top FROM oo),
base AS (SELECT date, round(max(ret) FILTER (symbol = '{BENCHMARK}') * 0.98::DOUBLE, 6) AS baseline_spy, round(avg(ret) FILTER (active) * 0.98::DOUBLE, 6) AS baseline_equal_weight,
  round(avg(ret) FILTER (top) * 0.98::DOUBLE, 6) AS baseline_momentum FROM r GROUP BY date)"""


def _with_universe(rows: DataFrame, spark, d, read: panel.Read = panel.table) -> DataFrame:
    """rows with active: whether the symbol is a member on that date."""
    return membership.flagged(rows, panel.constituents(spark, d, read), F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date"))


def _baselines(spark, d, rows: DataFrame | None = None) -> DataFrame:
    rows = _with_universe(_factors(spark, d), spark, d) if rows is None else rows
    calendar = None if "entry" in rows.columns else panel.calendar(spark, d)
    base = walk_forward.baselines(rows.withColumn("mom_252d", _round("mom_252d", 9)), calendar, TOP_K, BENCHMARK)
    return _rounded(base, ["date"], ["baseline_spy", "baseline_equal_weight", "baseline_momentum"])


@query(f"WITH {OPENS} SELECT date, symbol, round(ret, 6) AS ret FROM oo WHERE ret IS NOT NULL")
def open_to_open(spark, d):
    bars = panel.bars(spark, d).select("date", "symbol", "open")
    rows = walk_forward.with_opens(bars.select("date", "symbol").join(F.broadcast(walk_forward.dated(panel.calendar(spark, d))), "date"), bars)
    return _rounded(rows.where("entry > 0 and exit > 0").withColumn("ret", F.col("exit") / F.col("entry") - 1), ["date", "symbol"], ["ret"])


@query(f"WITH {OPENS} SELECT date, baseline_equal_weight FROM base WHERE baseline_equal_weight IS NOT NULL")
def baseline_ew(spark, d):
    ahead = walk_forward.opened_ahead(panel.bars(spark, d).select("date", "symbol", "open"), panel.calendar(spark, d))
    return _rounded(walk_forward.equal_weight(_while_members(ahead, spark, d)), ["date"], ["baseline_equal_weight"]).where("baseline_equal_weight is not null")


@query(f"WITH {OPENS} SELECT date, baseline_momentum FROM base WHERE baseline_momentum IS NOT NULL")
def baseline_mom(spark, d):
    return _baselines(spark, d).select("date", "baseline_momentum").where("baseline_momentum is not null")


@query(f"WITH {OPENS} SELECT date, baseline_spy FROM base WHERE baseline_spy IS NOT NULL")
def baseline_spy(spark, d):
    return _baselines(spark, d).select("date", "baseline_spy").where("baseline_spy is not null")


@query(f"WITH {FACTORS} SELECT symbol, round(CASE WHEN count(ret_1d) = 0 THEN 0 WHEN stddev_samp(ret_1d) <= 0 THEN 0 ELSE avg(ret_1d) / nullif(stddev_samp(ret_1d), 0) * sqrt(252) END, 6) AS sharpe FROM factors GROUP BY symbol")
def sharpe(spark, d):
    return _factors(spark, d).groupBy("symbol").agg(_round(metrics.sharpe(F.col("ret_1d")), 6).alias("sharpe"))


YEARS = f"{DAILY}, y AS (SELECT *, year(date) AS y FROM daily)"


@query(f"WITH {YEARS}, e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY y ORDER BY date)) AS equity FROM y), p AS (SELECT *, max(equity) OVER (PARTITION BY y ORDER BY date) AS peak FROM e) SELECT CAST(y AS BIGINT) AS y, round(max(1 - equity / peak), 6) AS worst FROM p GROUP BY y")
def drawdown(spark, d):
    rows = metrics.drawdowns(_daily(spark, d).withColumn("y", F.year("date").cast("long")), "r", ["y"], ["date"])
    return rows.groupBy("y").agg(_round(F.max("drawdown"), 6).alias("worst"))


@query(f"WITH {YEARS} SELECT CAST(y AS BIGINT) AS y, round(product(1 + coalesce(r, 0)) - 1, 6) AS total FROM y GROUP BY y")
def compound_return(spark, d):
    return _daily(spark, d).groupBy(F.year("date").cast("long").alias("y")).agg(_round(metrics.compounded(F.col("r")), 6).alias("total"))


@query(f"WITH {YEARS}, n AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY date) - 1 AS p, count(*) OVER (PARTITION BY y) AS n FROM y), b AS (SELECT *, CASE WHEN n > 1 THEN greatest(ceil(p * least(8, n)::DOUBLE / (n - 1)) - 1, 0) ELSE 0 END::BIGINT AS bin FROM n) SELECT CAST(y AS BIGINT) AS y, bin, count(*) AS n, round(avg(r), 8) AS mean FROM b GROUP BY y, bin")
def subperiods(spark, d):
    rows = metrics.bins(_daily(spark, d).withColumn("y", F.year("date").cast("long")), ["y"], ["date"])
    return rows.groupBy("y", "bin").agg(F.count("*").alias("n"), _round(F.avg("r"), 8).alias("mean"))


@query(f"WITH {FACTORS}, {SECTORS}, s AS (SELECT coalesce(sector, 'Unknown') AS sector, sum(abs(ret_1d)) AS pnl FROM factors LEFT JOIN sectors USING (symbol) GROUP BY 1) SELECT sector, round(pnl / nullif(sum(pnl) OVER (), 0), 6) AS share FROM s")
def sector_pnl_share(spark, d):
    rows = _factors(spark, d).join(F.broadcast(panel.sectors(spark, d)), "symbol", "left")
    by = rows.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.sum(F.abs("ret_1d")).alias("pnl"))
    return by.select("sector", _round(F.try_divide("pnl", F.sum("pnl").over(Window.partitionBy())), 6).alias("share"))




def _members(spark, d, day=None) -> DataFrame:
    """Members by date; with a day, that day's alone (where intervals overlap, permno is then the greatest)."""
    start, end = F.lit("1995-01-01").cast("date"), F.lit("2001-12-31").cast("date")
    if day is not None:
        start, end = F.greatest(start, F.lit(day).cast("date")), F.least(end, F.lit(day).cast("date"))
    return membership.expanded(panel.constituents(spark, d), panel.calendar(spark, d), start, end)


@query(f"WITH {MEMBERS} SELECT date, symbol, permno, true AS active FROM members")
def membership_expand(spark, d):
    return _members(spark, d)


@query(f"WITH {MEMBERS}, n AS (SELECT date, count(DISTINCT symbol) AS n FROM members GROUP BY date) SELECT count(*) AS days, min(n) AS least, max(n) AS most, count(*) FILTER (WHERE NOT n BETWEEN 5 AND 1000) AS violations FROM n")
def universe_validate(spark, d):
    return membership.validated(_members(spark, d), 5, 1000)


@query(f"WITH {MEMBERS}, s AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM members)) SELECT date, bool_or(k = 1) AS first, bool_or(k = 2) AS second FROM members JOIN s USING (symbol) WHERE k <= 2 GROUP BY date")
def membership_mask(spark, d):
    two = [r[0] for r in panel.constituents(spark, d).select("code").distinct().orderBy("code").limit(2).collect()]
    wide = membership.mask(_members(spark, d), two)
    return wide.select("date", F.col(f"`{two[0]}`").alias("first"), F.col(f"`{two[1]}`").alias("second"))


NAMES = """names AS (SELECT s_suppkey AS permno, upper(s_name) || CASE WHEN k = 0 THEN '' ELSE '.B' END AS name, CASE WHEN k = 0 THEN DATE '1990-01-01' ELSE DATE '1998-01-01' END AS start, CASE WHEN k = 0 THEN DATE '1997-12-31' END AS "end" FROM supplier, (VALUES (0), (1)) v(k))"""


def _names(spark, d) -> DataFrame:
    s = panel.table(spark, d, "supplier").select(F.col("s_suppkey").alias("permno"), F.upper("s_name").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    first = F.col("k") == 0
    day = lambda x: F.lit(x).cast("date")
    return s.select("permno", F.concat("n", F.when(first, "").otherwise(".B")).alias("name"), F.when(first, day("1990-01-01")).otherwise(day("1998-01-01")).alias("start"), F.when(first, day("1997-12-31")).alias("end"))


@query(f"WITH {NAMES}, f AS (SELECT l_orderkey, l_linenumber, l_suppkey AS permno, CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT name, year(date)::BIGINT AS y, count(*) AS n FROM f LEFT JOIN names ON f.permno = names.permno AND date BETWEEN start AND coalesce(\"end\", DATE '9999-12-31') GROUP BY 1, 2")
def interval_join_names(spark, d):
    facts = panel.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("permno"), F.to_date("l_shipdate").alias("date"))
    rows = membership.point_in_interval(facts, _names(spark, d), "permno")
    return rows.groupBy("name", F.year("date").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query(f"WITH {NAMES}, {CONSTITUENTS} SELECT c.permno, name AS other_name, greatest(c.start_date, n.start) AS common_start, least(coalesce(c.end_date, DATE '9999-12-31'), coalesce(n.\"end\", DATE '9999-12-31')) AS common_end FROM constituents c JOIN names n ON c.permno = n.permno WHERE greatest(c.start_date, n.start) <= least(coalesce(c.end_date, DATE '9999-12-31'), coalesce(n.\"end\", DATE '9999-12-31'))")
def interval_overlap(spark, d):
    c = panel.constituents(spark, d).select("permno", F.col("start_date").alias("start"), F.col("end_date").alias("end"))
    return membership.overlaps(c, _names(spark, d), "permno").select("permno", "other_name", "common_start", "common_end")


@query(f"WITH {NAMES} SELECT permno, old_symbol, name AS new_symbol, start AS effective_date FROM (SELECT *, lag(name) OVER (PARTITION BY permno ORDER BY start) AS old_symbol FROM names) WHERE old_symbol <> name")
def ticker_changes(spark, d):
    return membership.ticker_changes(_names(spark, d).withColumnRenamed("name", "symbol"))


@query(f"WITH {BARS}, {MEMBERS}, c AS (SELECT m.date, count(*) AS members, count(b.symbol) AS covered FROM members m LEFT JOIN bars b ON m.date = b.date AND m.symbol = b.symbol GROUP BY 1) SELECT count(*) AS days, sum(members)::BIGINT AS members, sum(covered)::BIGINT AS covered, round(sum(covered) / sum(members)::DOUBLE, 6) AS ratio, round(min(covered / members::DOUBLE), 6) AS least, round(median(covered / members::DOUBLE), 6) AS middle FROM c")
def coverage_report(spark, d):
    c = membership.coverage(_members(spark, d), panel.bars(spark, d))
    return c.agg(F.count("*").alias("days"), F.sum("members").alias("members"), F.sum("covered").alias("covered"), _round(F.try_divide(F.sum("covered"), F.sum("members")), 6).alias("ratio"), _round(F.min("ratio"), 6).alias("least"), _round(F.median("ratio"), 6).alias("middle"))


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def coverage_anti(spark, d):
    return panel.table(spark, d, "customer").join(panel.table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("custkey"))


def _ordered_days(spark, d) -> DataFrame:
    """symbol and date of its orders, once each; they lie by symbol, as bars do, so that both meet without a further shuffle."""
    lines = panel.table(spark, d, "lineitem").join(panel.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(panel.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.upper("s_name").alias("symbol"), F.to_date("o_orderdate").alias("date")).repartition("symbol").distinct()


@query(f"WITH {BARS}, o AS (SELECT DISTINCT upper(s_name) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey) SELECT o.symbol, o.date, round(b.close, 6) AS close FROM o ASOF LEFT JOIN bars b ON o.symbol = b.symbol AND o.date >= b.date")
def asof_nearest(spark, d):
    asked = _ordered_days(spark, d)
    found = membership.as_of(asked, panel.bars(spark, d).select("symbol", "date", "close"), ["symbol"], "date", "close")
    return _rounded(found, ["symbol", "date"], ["close"])


@query(f"WITH {BARS}, o AS (SELECT DISTINCT upper(s_name) AS symbol, CAST(o_orderdate AS DATE) AS date FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey) SELECT o.symbol, o.date, round(b.close, 6) AS close FROM o ASOF LEFT JOIN bars b ON o.symbol = b.symbol AND o.date <= b.date")
def asof_after(spark, d):
    asked = _ordered_days(spark, d)
    return _rounded(membership.nearest_after(asked, panel.bars(spark, d).select("symbol", "date", "close"), ["symbol"], "date", "close"), ["symbol", "date"], ["close"])


@query(f"WITH {MEMBERS}, m AS (SELECT DISTINCT date, CASE WHEN s_suppkey IS NULL THEN symbol ELSE symbol || '.B' END AS symbol FROM members LEFT JOIN (SELECT s_suppkey, upper(s_name) AS s FROM supplier WHERE s_suppkey % 3 = 0) ON s = symbol) SELECT date, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS members FROM m WHERE date BETWEEN DATE '2000-12-01' AND DATE '2001-01-31' GROUP BY date")
def members_list(spark, d):
    """Members by date over two months, every third symbol under its later name."""
    mapping = membership.ticker_mapping(panel.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_name").alias("from_symbol"), F.concat("s_name", F.lit(".b")).alias("to_symbol")))
    rows = membership.listed(membership.renamed(_members(spark, d), mapping), "2000-12-01", "2001-01-31")
    return rows.select("date", F.size("members").cast("long").alias("n"), F.array_join("members", ",").alias("members"))


WAREHOUSE = f"""{BARS}, {NAMES}, raw AS (SELECT s_suppkey AS permno, bars.*, CASE WHEN day(date) % 3 = 0 THEN -close ELSE close END AS price, s_suppkey % 4 AS factor FROM bars JOIN supplier ON upper(s_name) = symbol),
j AS (SELECT raw.date, upper(coalesce(nullif(trim(name), ''), 'X' || raw.permno)) AS symbol, open, high, low, abs(price) AS close, CASE WHEN factor = 0 THEN abs(price) ELSE abs(price) / factor END AS adj_close, volume, raw.permno
  FROM raw LEFT JOIN names ON names.permno = raw.permno AND raw.date BETWEEN start AND coalesce("end", DATE '9999-12-31') WHERE raw.date BETWEEN DATE '1997-06-01' AND DATE '1998-06-30')"""


def _securities(spark, d) -> DataFrame:
    """Prices by security number, as a warehouse has them: quotes' middles below 0, split factors, null for every fourth."""
    b = panel.bars(spark, d).join(panel.table(spark, d, "supplier").select("s_suppkey", F.upper("s_name").alias("symbol")), "symbol")
    price = F.when(F.dayofmonth("date") % 3 == 0, -F.col("close")).otherwise(F.col("close"))
    return b.select(F.col("s_suppkey").alias("permno"), "date", "open", "high", "low", price.alias("price"), "volume", (F.col("s_suppkey") % 4).alias("factor"))


@query(f"WITH {WAREHOUSE} SELECT date, symbol, {_rounds(['open', 'high', 'low', 'close', 'adj_close'], 4)}, round(volume, 2) AS volume, permno FROM j")
def warehouse_history(spark, d):
    return _history(warehouse.history(_securities(spark, d), _names(spark, d), "1997-06-01", "1998-06-30", fallback=F.concat(F.lit("X"), F.col("permno").cast("string"))))


def _history(rows: DataFrame) -> DataFrame:
    return rows.select("date", "symbol", *(_round(c, 4).alias(c) for c in ("open", "high", "low", "close", "adj_close")), _round("volume", 2).alias("volume"), "permno")


def _by_security(spark, d) -> tuple[DataFrame, DataFrame]:
    """Prices and names in buckets by security number, blank and missing names as text among them."""
    odd = F.when(F.col("permno") % 10 == 3, "nan").when(F.col("permno") % 10 == 4, " ").otherwise(F.col("name"))
    name = lambda kind: f"barloom_{kind}_{uuid.uuid4().hex}"
    return tuple(warehouse.laid_out(df, name(kind), shared_folder(spark, kind), 8, order) for df, kind, order in ((_securities(spark, d), "prices", "date"), (_names(spark, d).withColumn("name", odd), "names", "start")))


SECURITIES = WAREHOUSE.replace("nullif(trim(name), '')", "CASE WHEN names.permno % 10 NOT IN (3, 4) THEN name END").replace("'X' ||", "'' ||")
_PRICES = f"date, symbol, {_rounds(['open', 'high', 'low', 'close', 'adj_close'], 4)}, round(volume, 2) AS volume, permno"


@query(f"WITH {SECURITIES} SELECT {_PRICES} FROM j WHERE permno % 5 IN (0, 3)")
def warehouse_batch(spark, d):
    """Histories of some security numbers; what other requests name counts for nothing then."""
    asked = panel.table(spark, d, "supplier").where("s_suppkey % 5 in (0, 3) or s_suppkey % 7 = 1").select(F.upper("s_name").alias("symbol"), F.when(F.col("s_suppkey") % 5 % 3 == 0, F.col("s_suppkey")).alias("permno"))
    daily, names = _by_security(spark, d)
    return _history(warehouse.batch(daily, names, asked, "1997-06-01", "1998-06-30"))


@query(f"WITH {SECURITIES} SELECT {_PRICES} FROM j WHERE symbol IN (SELECT upper(s_name) || '.B' FROM supplier WHERE s_suppkey % 4 = 1)")
def warehouse_by_name(spark, d):
    """Histories asked for by name: securities that ever had one of the names, while they had it."""
    asked = panel.table(spark, d, "supplier").where("s_suppkey % 4 = 1").select(F.concat(F.lower("s_name"), F.lit(".b ")).alias("symbol"), F.lit(None).cast("long").alias("permno"))
    daily, names = _by_security(spark, d)
    return _history(warehouse.batch(daily, names, asked, "1997-06-01", "1998-06-30"))


@query(f"WITH {SECURITIES} SELECT {_PRICES} FROM j WHERE date = DATE '1998-01-05'")
def warehouse_day(spark, d):
    daily, names = _by_security(spark, d)
    return _history(warehouse.one_day(daily, names, "1998-01-05"))


@query(f"""WITH {NAMES}, {CONSTITUENTS}, c AS (SELECT name AS code, 'US' AS exchange, coalesce(CASE WHEN k = 1 THEN 'Company ' || names.permno END, name) AS name, CASE WHEN names.permno % 11 = 0 THEN NULL ELSE (names.permno * 37) % 10000 END AS code_,
  greatest(c.start_date, start) AS start_date, least(coalesce(c.end_date, DATE '9999-12-31'), coalesce("end", DATE '9999-12-31')) AS end_date, names.permno AS permno FROM constituents c JOIN (SELECT *, CASE WHEN name LIKE '%.B' THEN 1 ELSE 0 END AS k FROM names) names USING (permno))
SELECT code, exchange, name, CASE WHEN code_ IS NULL THEN 'Unknown' ELSE (SELECT CASE CASES ELSE 'Unknown' END FROM (SELECT code_ AS code)) END AS sector, coalesce('SIC ' || code_, 'Unknown') AS industry, start_date, end_date, end_date >= DATE '2001-06-30' AS active, permno FROM c WHERE start_date <= end_date""".replace("CASES", " ".join(f"WHEN code BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in SIC_SECTORS)))
def warehouse_constituents(spark, d):
    c = panel.constituents(spark, d).select("permno", F.col("start_date").alias("start"), F.col("end_date").alias("end"))
    later = F.col("name").endswith(".B")
    names = _names(spark, d).withColumn("company", F.when(later, F.concat(F.lit("Company "), F.col("permno").cast("string")))).withColumn("sic", F.when(F.col("permno") % 11 != 0, (F.col("permno") * 37 % 10000).cast("string")))
    return warehouse.constituents(c, names, "2001-06-30")


@query("SELECT r_name AS region, upper(n_name) AS \"Symbol\", 'S' || (n_nationkey % 3) AS \"Sector\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def html_tables(spark, d):
    """A page for each region, whose second table lists its nations; parsed and scanned for the columns that are asked for."""
    n = panel.table(spark, d, "nation").join(panel.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td><a href=x>"), F.upper("n_name"), F.lit("</a>\n</td><td> S"), (F.col("n_nationkey") % 3).cast("string"), F.lit(" </td></tr>"))
    pages = n.groupBy("r_name").agg(F.array_join(F.collect_list(cells), "").alias("rows"))
    html = F.concat(F.lit("<html><table><tr><th>Symbol<td>Other</table><p>Members</p><table class=wikitable><tbody><tr><th>No<th>Symbol</th><th>GICS Sector</th></tr>"), "rows", F.lit("</tbody></table>"))
    return html_source.scan(pages.select(F.col("r_name").alias("region"), html.alias("html")), "region", "html", [("Symbol",), ("Sector", "GICS Sector")])


def _snapshot(spark, d) -> DataFrame:
    """Constituents from a page for each region, whose table has the region in one cell over all rows and two titles over two columns each."""
    n = panel.table(spark, d, "nation").join(panel.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("nations"))
    cells = lambda x: F.concat(F.lit("<td> "), F.replace(F.initcap(x["n_name"]), F.lit(" "), F.lit(".")), F.lit("<td colspan=2>"), x["n_name"], F.lit("</tr>"))
    rows = F.array_join(F.transform("nations", lambda x, i: F.concat(F.when(i == 0, F.concat(F.lit("<tr><td rowspan=0>"), "r_name")).otherwise("<tr>"), cells(x))), "\n")
    again = F.concat(F.lit("<tr><td>"), "r_name", F.lit("<td>"), F.replace(F.get("nations", F.lit(0))["n_name"], F.lit(" "), F.lit(".")), F.lit("<td>twice<td>no"))
    html = F.concat(F.lit("<table><tr><th colspan=3>Symbol</table><table><thead><tr><th>GICS Sector<th>Symbol<th colspan=2>Security</tr></thead><tbody>"), rows, F.lit("</tbody><tbody>"), again, F.lit("</table>"))
    return html_source.scan(lines.select("r_name", html.alias("html")), "r_name", "html", [("Symbol",), ("Security",), ("GICS Sector", "Sector")], position="place")


SNAPSHOT = "snap AS (SELECT replace(upper(n_name), ' ', '-') AS code, 'US' AS exchange, n_name AS name, r_name AS sector, NULL::VARCHAR AS industry FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {SNAPSHOT} SELECT * FROM snap")
def html_snapshot(spark, d):
    return membership.snapshot(_snapshot(spark, d), F.struct("r_name", "place"))


@query(f"WITH {SNAPSHOT}, {CALENDAR} SELECT date, code AS symbol, true AS active FROM snap, calendar")
def membership_approx(spark, d):
    """Every constituent of a snapshot on every trading day."""
    current = membership.snapshot(_snapshot(spark, d), F.struct("r_name", "place"))
    return membership.constant_membership(current.select(F.col("code").alias("symbol")), panel.calendar(spark, d))


@query("""SELECT page_id, (k - 1)::INT AS place, CAST(page_id AS VARCHAR) AS page, trim(l[k]) AS "Symbol" FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS l FROM pages))""")
def html_pages(spark, d):
    """The links of every page, from pages whose lists are written as tables with one cell beside all of their rows."""
    p = panel.table(spark, d, "pages")
    head = F.concat(F.lit("<table><thead><tr><th>Page<th>Symbol</tr></thead><tbody><tr><td rowspan=0>"), F.col("page_id").cast("string"), F.lit("<td>"))
    text = F.replace(F.replace(F.replace(F.replace("html", F.lit("<ul><li>"), head), F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("</td></tr>")), F.lit("</ul>"), F.lit("</tbody></table>"))
    rows = html_source.scan(p.select("page_id", text.alias("html")), "page_id", "html", [("Page",), ("Symbol",)], position="place")
    return rows.select("page_id", "place", F.col("Page").alias("page"), "Symbol")


NTH = "(make_date(y, {m}, 1) + INTERVAL 1 DAY * (({w} - isodow(make_date(y, {m}, 1)) + 7) % 7 + {days}))::DATE"
HOLIDAYS = f"""years AS (SELECT unnest(range(1995, 2003)) AS y), h AS (
SELECT d + CASE isodow(d) WHEN 7 THEN 1 WHEN 6 THEN shift ELSE 0 END AS d FROM (SELECT make_date(y, 1, 1) AS d, 0 AS shift FROM years UNION ALL SELECT make_date(y, 7, 4), -1 FROM years UNION ALL SELECT make_date(y, 12, 25), -1 FROM years)
UNION SELECT {NTH.format(m=1, w=1, days=14)} FROM years WHERE y >= 1998 UNION SELECT {NTH.format(m=2, w=1, days=14)} FROM years UNION SELECT {NTH.format(m=9, w=1, days=0)} FROM years UNION SELECT {NTH.format(m=11, w=4, days=21)} FROM years
UNION SELECT (make_date(y, 5, 31) - INTERVAL 1 DAY * (isodow(make_date(y, 5, 31)) - 1))::DATE FROM years
UNION SELECT unnest(['1995-04-14', '1996-04-05', '1997-03-28', '1998-04-10', '1999-04-02', '2000-04-21', '2001-04-13', '2002-03-29', '2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14'])::DATE)"""


@query(f"WITH {CALENDAR}, {HOLIDAYS}, x AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM calendar), s AS (SELECT date FROM x WHERE isodow(date) < 6 AND date NOT IN (SELECT d FROM h)) SELECT s.date, row_number() OVER (ORDER BY s.date) - 1 AS idx, calendar.date IS NOT NULL AS traded FROM s LEFT JOIN calendar USING (date)")
def calendar_sessions(spark, d):
    """The exchange's sessions over the panel's dates, and whether the panel has bars of each."""
    days = panel.calendar(spark, d)
    lo, hi = days.agg(F.min("date"), F.max("date")).first()
    all_of = sessions.sessions(spark, str(lo), str(hi))
    return all_of.join(days.select("date", F.lit(True).alias("traded")), "date", "left").withColumn("traded", F.coalesce("traded", F.lit(False)))


@query(f"WITH {CALENDAR} SELECT date, lead(date, 3) OVER (ORDER BY date) AS shifted FROM calendar")
def calendar_shift(spark, d):
    return membership.shifted(panel.calendar(spark, d), 3)


_CASES = " ".join(f"WHEN code BETWEEN {lo} AND {hi} THEN '{name}'" for lo, hi, name in SIC_SECTORS)


@query(f"WITH c AS (SELECT p_partkey, (p_partkey * 37) % 10000 AS code FROM part) SELECT p_partkey AS partkey, CASE {_CASES} ELSE 'Unknown' END AS sector FROM c")
def sic_sector(spark, d):
    rows = panel.table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), ((F.col("p_partkey") * 37) % 10000).cast("string").alias("code"))
    return rows.select("partkey", code_sector(F.col("code"), SIC_SECTORS).alias("sector"))


@query(f"WITH {BARS} SELECT date, symbol, round(CASE WHEN date >= DATE '2000-01-01' THEN close * 2 ELSE close END, 6) AS close FROM bars WHERE date < DATE '2001-01-01' OR date >= DATE '2000-01-01'")
def ingest_upsert(spark, d):
    b = panel.bars(spark, d).select("date", "symbol", "close")
    old, new = b.where("date < '2001-01-01'"), b.where("date >= '2000-01-01'").withColumn("close", F.col("close") * 2)
    return _rounded(panel.upserted(old, new), ["date", "symbol"], ["close"])


def _dq_sql(day: str, least: int, warn: int, faulty: str = "SELECT * FROM bars", explained: str = "") -> str:
    """The suite over bars that `faulty` makes of the panel, check by check."""
    return f"""
WITH {BARS}, {MEMBERS}, fb AS ({faulty}), g AS (SELECT DATE '{day}' AS d0, {least} AS least, {warn} AS warn),
prev AS (SELECT *, adj_close / nullif(lag(adj_close) OVER s, 0) - 1 AS ret, CASE WHEN close > 0 AND adj_close > 0 THEN adj_close / close END AS ratio,
  lag(CASE WHEN close > 0 AND adj_close > 0 THEN adj_close / close END) OVER s AS last_ratio FROM fb WINDOW s AS (PARTITION BY symbol ORDER BY date)),
late AS (SELECT max(date) AS latest FROM fb), t AS (SELECT * FROM prev, g WHERE date = d0),
dup AS (SELECT coalesce(sum(n), 0) AS twice FROM (SELECT count(*) AS n FROM t GROUP BY symbol HAVING count(*) > 1)),
one AS (SELECT count(DISTINCT symbol) AS symbols, count(*) AS n_rows, count(*) FILTER (WHERE low > least(open, close) OR high < greatest(open, close) OR low > high OR close <= 0 OR volume < 0) AS bad,
  count(*) FILTER (WHERE abs(ret) > 0.25 AND symbol NOT IN ('', '{explained}')) AS outliers, count(ratio) AS ratios, count(*) FILTER (WHERE abs(ratio / last_ratio - 1) > 0.5) AS jumps FROM t),
miss AS (SELECT count(*) AS expected, count(*) FILTER (WHERE symbol NOT IN (SELECT symbol FROM t)) AS missing FROM (SELECT DISTINCT symbol FROM members, g WHERE date = d0)),
gap AS (SELECT count(*) FILTER (WHERE isodow(x) < 6) AS gap FROM (SELECT unnest(generate_series(latest + INTERVAL 1 DAY, d0::TIMESTAMP, INTERVAL 1 DAY)) AS x FROM late, g)),
a AS (SELECT * FROM one, miss, late, g, dup, gap), c AS (
SELECT 'freshness' AS check, latest >= d0 AS passed, CASE WHEN latest >= d0 THEN 'info' ELSE 'critical' END AS severity, (d0 - latest)::DOUBLE AS value FROM a
UNION ALL SELECT 'completeness', symbols >= least, CASE WHEN symbols < least THEN 'critical' WHEN symbols < warn THEN 'warning' ELSE 'info' END, symbols::DOUBLE FROM a
UNION ALL SELECT 'ohlc_validity', n_rows > 0 AND bad = 0, CASE WHEN n_rows = 0 OR bad > 10 THEN 'critical' WHEN bad > 0 THEN 'warning' ELSE 'info' END, bad::DOUBLE FROM a
UNION ALL SELECT 'return_outliers', outliers = 0, CASE WHEN outliers > 0 THEN 'warning' ELSE 'info' END, outliers::DOUBLE FROM a
UNION ALL SELECT 'duplicates', twice = 0, CASE WHEN twice > 0 THEN 'critical' ELSE 'info' END, twice::DOUBLE FROM a
UNION ALL SELECT 'gaps', missing <= greatest(0, expected - least), CASE WHEN missing > greatest(0, expected - least) THEN 'critical' WHEN missing > 0 THEN 'warning' ELSE 'info' END, missing::DOUBLE FROM a
UNION ALL SELECT 'adjusted_consistency', ratios > 0 AND jumps = 0, CASE WHEN ratios = 0 THEN 'critical' WHEN jumps > 0 THEN 'warning' ELSE 'info' END, jumps::DOUBLE FROM a
UNION ALL SELECT 'gap_backfill', gap <= 1, CASE WHEN gap <= 1 THEN 'info' WHEN gap <= 5 THEN 'warning' ELSE 'critical' END, gap::DOUBLE FROM a)
SELECT 'quality' AS suite, * FROM c"""


SIGNALS = signals.Settings(TOP_K, MAX_W, SECTOR_CAP, 0.2, MIN_ADV, 420)


@query("WITH " + _weights_sql(True).replace("FROM day),", "FROM day WHERE date BETWEEN DATE '2000-01-20' AND DATE '2001-03-15'),", 1).replace("FROM day)\n", "FROM day WHERE date BETWEEN DATE '2000-01-20' AND DATE '2001-03-15')\n", 1) + " SELECT date, symbol, round(weight, 6) AS weight FROM weights WHERE date = DATE '2001-03-15'")
def signals_universe(spark, d):
    """Signals of one day as a daily run makes them: 420 days of history, members only."""
    return _rounded(signals.generate(panel.bars(spark, d), _members(spark, d), panel.sectors(spark, d), "2001-03-15", SIGNALS), ["date", "symbol"], ["weight"])


@query(f"WITH {BARS}, {MEMBERS} SELECT date, symbol, round(close * CASE WHEN date = DATE '2001-03-15' THEN 1.01::DOUBLE ELSE 1 END, 6) AS close FROM bars WHERE date BETWEEN DATE '2001-03-01' AND DATE '2001-03-12' OR (date BETWEEN DATE '2001-03-13' AND DATE '2001-03-15' AND (date, symbol) IN (SELECT date, symbol FROM members))")
def ingest_gated(spark, d):
    """A day's bars and those of two missing days, members only, merged behind the checks."""
    b = panel.bars(spark, d).where("date between '2000-12-01' and '2001-03-15'")
    day = lambda df, lo, hi: df.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    new = day(b, "2001-03-15", "2001-03-15").withColumns({c: F.col(c) * 1.01 for c in ("open", "high", "low", "close", "adj_close")})
    done = ingest.ingested(day(b, "2000-12-01", "2001-03-12"), _members(spark, d), "2001-03-15", new, fetch=lambda days: day(b, days[0], days[-1]), least=1, strict=False)
    return _rounded(done.bars.where("date >= '2001-03-01'"), ["date", "symbol"], ["close"])


DQ_DAY = "2000-06-15"
DQ = _dq_sql(DQ_DAY, 5, 490)


@query(DQ)
def dq_suite(spark, d):
    return checks.quality(panel.bars(spark, d), _members(spark, d, DQ_DAY), DQ_DAY, 5, warn=490)


#: The panel with faults on the day: two rows for symbols that end in 3, doubled and reversed prices for those in 1, none for those in 2.
FAULTY = f"""SELECT date, symbol, open, CASE WHEN f AND symbol LIKE '%1' THEN low ELSE high END AS high, CASE WHEN f AND symbol LIKE '%1' THEN high * 3 ELSE low END AS low, close,
  CASE WHEN f AND symbol LIKE '%1' THEN adj_close * 2 ELSE adj_close END AS adj_close, volume, dollar_volume FROM (SELECT *, date = DATE '{DQ_DAY}' AS f FROM bars), (VALUES (1), (2)) v(k)
  WHERE (k = 1 OR (f AND symbol LIKE '%3')) AND NOT (f AND symbol LIKE '%2')"""


def _faulty(spark, d) -> DataFrame:
    f, ends = F.col("date") == F.lit(DQ_DAY).cast("date"), F.col("symbol").endswith
    odd = f & ends("1")
    rows = panel.bars(spark, d).withColumns({"high": F.when(odd, F.col("low")).otherwise(F.col("high")), "low": F.when(odd, F.col("high") * 3).otherwise(F.col("low")), "adj_close": F.when(odd, F.col("adj_close") * 2).otherwise(F.col("adj_close"))})
    return rows.where(~(f & ends("2"))).withColumn("k", F.explode(F.when(f & ends("3"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("k")


@query(_dq_sql(DQ_DAY, 90, 490, FAULTY, "SUPPLIER#000000011"))
def dq_faults(spark, d):
    return checks.quality(_faulty(spark, d), _members(spark, d, DQ_DAY), DQ_DAY, 90, warn=490, explained=("SUPPLIER#000000011",))


@query(_dq_sql("2001-11-12", 5, 5))
def dq_late(spark, d):
    """A day that the bars don't reach: eight days after the last one."""
    return checks.quality(panel.bars(spark, d), _members(spark, d, "2001-11-12"), "2001-11-12", 5)


def _carried_checks(rows: DataFrame, members: DataFrame, *options, **named) -> DataFrame:
    """The suite from the day's bars and what the days before it left, by symbol."""
    state = _stored(checks.carried(rows, before=DQ_DAY), "carried")
    return checks.quality_of_day(rows.where(F.col("date") == F.lit(DQ_DAY).cast("date")), state, members, DQ_DAY, *options, **named)


@query(DQ)
def dq_carried(spark, d):
    return _carried_checks(panel.bars(spark, d), _members(spark, d), 5, warn=490)


@query(_dq_sql(DQ_DAY, 90, 490, FAULTY, "SUPPLIER#000000011"))
def dq_carried_faults(spark, d):
    return _carried_checks(_faulty(spark, d), _members(spark, d), 90, warn=490, explained=("SUPPLIER#000000011",))


def _store(spark, bars: DataFrame) -> Store:
    store = Store(spark, shared_folder(spark, "panel"), bars.schema)
    ingest.load(store, bars)
    return store


INGESTED = f"""WITH {BARS}, {MEMBERS}, late AS (SELECT DISTINCT symbol FROM members WHERE date IN (DATE '2001-03-13', DATE '2001-03-14')), m AS (SELECT symbol FROM members WHERE date = DATE '2001-03-15'),
s AS (SELECT date, symbol, close * CASE WHEN date = DATE '2001-03-15' THEN 1.01::DOUBLE ELSE 1 END AS close, volume FROM bars
  WHERE date BETWEEN DATE '2000-12-01' AND DATE '2001-03-12' OR (date IN (DATE '2001-03-13', DATE '2001-03-14') AND symbol IN (FROM late)) OR (date = DATE '2001-03-15' AND symbol IN (FROM m)))"""


@query(f"{INGESTED} SELECT date, symbol, round(close, 6) AS close, round(volume, 2) AS volume FROM s")
def ingest_store(spark, d):
    """A day and two missing ones ingested into a store by date; all that readers then see."""
    b = panel.bars(spark, d).where("date between '2000-12-01' and '2001-03-15'")
    day = lambda lo, hi: b.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    store = _store(spark, day("2000-12-01", "2001-03-12"))
    new = day("2001-03-15", "2001-03-15").withColumns({c: F.col(c) * 1.01 for c in ("open", "high", "low", "close", "adj_close")})
    ingest.ingest_day(store, _members(spark, d), "2001-03-15", new, fetch=lambda days, symbols: day(days[0], days[-1]).join(symbols, "symbol", "left_semi"), least=1, strict=False)
    return store.read().select("date", "symbol", _round("close", 6).alias("close"), _round("volume", 2).alias("volume"))


@query(f"{INGESTED}, t AS (SELECT * FROM s WHERE date BETWEEN DATE '2001-03-01' AND DATE '2001-03-15') SELECT date, count(*) AS n, round(sum(close), 4) AS total FROM t GROUP BY date")
def ingest_again(spark, d):
    """A day ingested twice, first with wrong prices, and an earlier one once more: a range of dates as read afterwards."""
    b = panel.bars(spark, d).where("date between '2000-12-01' and '2001-03-15'")
    day = lambda lo, hi: b.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    prices = lambda rows, by: rows.withColumns({c: F.col(c) * by for c in ("open", "high", "low", "close", "adj_close")})
    store, members = _store(spark, day("2000-12-01", "2001-03-12")), _members(spark, d)
    fetch = lambda days, symbols: day(days[0], days[-1]).join(symbols, "symbol", "left_semi")
    for at, by in (("2001-03-15", 1.2), ("2001-03-15", 1.01)):
        ingest.ingest_day(store, members, at, prices(day(at, at), by), fetch=fetch, least=1, strict=False)
    ingest.ingest_day(store, members, "2001-03-07", day("2001-03-07", "2001-03-07"), least=1, strict=False)
    return store.read("2001-03-01", "2001-03-15").groupBy("date").agg(F.count("*").alias("n"), _round(F.sum("close"), 4).alias("total"))


def _two_days(spark, d, w: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Targets of the latest day with weights, and positions that the day before left; w: stored weights."""
    w = _kept_weights(spark, d, False, _recent_eligible(spark, d)) if w is None else w
    last = _last_dates(w, 2)
    price = panel.bars(spark, d).select("date", "symbol", "close")
    of = lambda day: w.where(F.col("date") == day).select("symbol", "weight")
    held = of(last[1]).join(price.where(F.col("date") == last[1]), "symbol").select("symbol", (F.col("weight") * 100000.0).alias("market_value"), (F.col("weight") * 100000.0 / F.col("close")).alias("qty"), F.col("close").alias("current_price"))
    return of(last[0]).withColumn("day", F.lit(last[0])), held


INTENTS = f"""
{_weights_sql(False)}, days AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM weights)),
t AS (SELECT symbol, weight FROM weights JOIN days USING (date) WHERE k = 1),
h AS (SELECT w.symbol, weight * 100000::DOUBLE AS market_value, weight * 100000::DOUBLE / close AS qty, close AS price FROM weights w JOIN days USING (date) JOIN bars b ON b.date = w.date AND b.symbol = w.symbol WHERE k = 2),
j AS (SELECT symbol, coalesce(weight, 0) * 110000::DOUBLE - coalesce(market_value, 0) AS delta, coalesce(qty, 0) AS held, coalesce(price, 0) AS price FROM t FULL JOIN h USING (symbol)),
intents AS (SELECT symbol, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, delta AS delta_value, CASE WHEN NOT (delta < 0 AND price > 0) THEN abs(delta) END AS notional, CASE WHEN delta < 0 AND price > 0 THEN least(abs(delta) / price, held) END AS qty, price FROM j WHERE abs(delta) >= 25)
"""


@query(f"WITH {INTENTS} SELECT symbol, side, {_rounds(["delta_value", "notional", "qty", "price"], 1)} FROM intents")
def order_intents(spark, d):
    t, h = _two_days(spark, d)
    return _rounded(portfolio.order_intents(t, h, 110000.0), ["symbol", "side"], ["delta_value", "notional", "qty", "price"], 1)


def _checks_sql(suite: str, rows: list[tuple[str, str, str]], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{suite}' AS suite, '{name}' AS check, coalesce({ok}, false) AS passed, CASE WHEN {ok} THEN 'info' ELSE 'critical' END AS severity, round(({value})::DOUBLE, 4) AS value FROM {source}" for name, ok, value in rows)


RISK_PRE = f"""WITH {INTENTS}, {SECTORS}, i AS (SELECT coalesce(sum(size), 0) AS total, coalesce(max(size), 0) AS largest, coalesce(sum(size) FILTER (side = 'buy'), 0) AS buys
  FROM (SELECT *, coalesce(abs(delta_value), abs(notional), abs(qty * price), 0) AS size FROM intents)),
o AS (SELECT count(*) AS outside FROM t WHERE symbol NOT IN (SELECT symbol FROM members WHERE date = (SELECT max(date) FROM bars))),
q AS (SELECT count(*) AS n, coalesce(max(weight), 0) AS heaviest, coalesce(sum(weight), 0) AS s, (SELECT max(date) FROM weights) - (SELECT max(date) FROM bars) AS age FROM t), a AS (SELECT * FROM i, o, q)
""".replace(f", {SECTORS}, i AS", ", i AS") + _checks_sql("pre_trade", [
    ("turnover", "total <= 0.4 * 110000 + 1e-9", "total"), ("order_size", f"largest <= least(12500, {MAX_W} * 110000) + 1e-9", "largest"), ("universe", "outside = 0", "outside"), ("data_age", "age <= 0", "age"),
    ("positions", f"n BETWEEN 5 AND 30 AND heaviest <= {MAX_W} + 1e-9 AND s <= 1 + 1e-9", "n"), ("buying_power", "buys <= 50000 + 1e-9", "buys"), ("pause_switch", "outside >= 0", "0"), ("trading_day", "outside >= 0", "1"),
], "a")


@query(RISK_PRE)
def risk_pre(spark, d):
    return _risk_pre(spark, d, *_two_days(spark, d))


def _risk_pre(spark, d, t: DataFrame, h: DataFrame) -> DataFrame:
    latest = panel.latest(spark, d)
    universe = _members(spark, d, latest).select("symbol")
    day = t.select("day").first()[0]
    rows = checks.pre_trade(portfolio.order_intents(t, h, 110000.0), t, universe, 110000.0, 50000.0, max_position=MAX_W, latest=str(latest), as_of=str(day))
    return rows.withColumn("value", _round("value", 4))


#: Orders that were rejected end in 7; those that end in 5 were filled 2 % off.
RISK_POST = f"""WITH {INTENTS}, f AS (SELECT count(*) FILTER (symbol LIKE '%7') AS failed, coalesce(max(abs(price * CASE WHEN symbol LIKE '%5' THEN 1.02::DOUBLE ELSE 1.001::DOUBLE END / price - 1) * 1e4), 0) AS slip FROM h),
x AS (SELECT coalesce(max(abs(coalesce(p.weight, 0) - coalesce(t.weight, 0))), 0) AS gap FROM t FULL JOIN (SELECT symbol, market_value / 100000::DOUBLE AS weight FROM h) p USING (symbol)), a AS (SELECT *, 5000 AS cash FROM f, x)
""" + _checks_sql("post_trade", [("fills", "failed = 0", "failed"), ("slippage", "slip <= 100 + 1e-9", "slip"), ("reconciliation", "gap <= 0.01 + 1e-9", "gap"), ("cash", "cash >= 0.02 * 110000", "cash")], "a")


@query(RISK_POST)
def risk_post(spark, d):
    return _risk_post(*_two_days(spark, d))


def _risk_post(t: DataFrame, h: DataFrame) -> DataFrame:
    status = F.when(F.col("symbol").endswith("7"), "Rejected").otherwise("filled")
    off = F.when(F.col("symbol").endswith("5"), 1.02).otherwise(1.001)
    fills = h.select("symbol", status.alias("status"), F.col("current_price").alias("expected"), (F.col("current_price") * off).alias("filled"))
    rows = checks.post_trade(fills, t, h.select("symbol", (F.col("market_value") / 100000.0).alias("weight")), 5000.0, 110000.0)
    return rows.withColumn("value", _round("value", 4))


@query("WITH l AS (SELECT user_id, ts, event_id, 1000 + sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS equity FROM events), m AS (SELECT *, max(equity) OVER w AS peak, lag(equity) OVER w AS prev, row_number() OVER w AS seen FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, CASE WHEN 1 - equity / peak > 0.10 AND seen > 5 THEN 2 WHEN 1 - equity / prev > 0.03 THEN 1 ELSE 0 END AS level FROM m")
def equity_monitor(spark, d):
    e = panel.table(spark, d, "events")
    log = e.select("user_id", "event_id", (1000 + F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).alias("equity"))
    return metrics.monitored(log, "user_id", "event_id", "equity").select("user_id", "event_id", "level")


@query(f"""WITH {_weights_sql(True)}, l AS (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, symbol) AS up, row_number() OVER (ORDER BY round(weight, 9), symbol) AS down FROM weights WHERE date = (SELECT max(date) FROM weights))
SELECT max(date) AS date, count(*) AS positions, round(sum(weight), 6) AS weights_sum, string_agg(symbol, ',' ORDER BY up) FILTER (WHERE up <= 5) AS top_5, string_agg(symbol, ',' ORDER BY down) FILTER (WHERE down <= 5) AS bottom_5 FROM l""")
def signal_summary(spark, d):
    s = reports.signal_summary(_kept_weights(spark, d, True, _recent_eligible(spark, d)).withColumn("weight", _round("weight", 9)))
    return s.withColumn("weights_sum", _round("weights_sum", 6))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'rejected' ELSE 'unknown' END AS status, count(*) AS count FROM orders GROUP BY 1")
def fill_counts(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "FILLED").when(F.col("o_orderstatus") == "O", "Rejected")
    return reports.fill_counts(panel.table(spark, d, "orders").select(status.alias("status")))


REPORT = f"""WITH every AS (SELECT * FROM ({DQ}) UNION ALL SELECT * FROM ({RISK_PRE}) UNION ALL SELECT * FROM ({RISK_POST})),
last AS (SELECT count(*)::DOUBLE AS n, round(sum(weight), 6) AS s FROM (WITH {_weights_sql(True)} SELECT weight FROM weights WHERE date = (SELECT max(date) FROM weights)))
SELECT suite AS section, "check" AS item, passed, value FROM every UNION ALL SELECT 'fills', lower(o_orderstatus), NULL, count(*)::DOUBLE FROM orders GROUP BY 2
UNION ALL SELECT 'signals', 'positions', NULL, n FROM last UNION ALL SELECT 'signals', 'weights_sum', NULL, s FROM last
UNION ALL SELECT 'exceptions', suite, false, count(*)::DOUBLE FROM every WHERE NOT passed GROUP BY suite"""


def _report_parts(spark, d) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Checks, fills and weights of a daily report, which goes over each more than once: names are ranked once, for weights with
    and without the sector cap, and the small tables made of them are stored."""
    rows = _recent_eligible(spark, d)
    two = _two_days(spark, d, _kept_weights(spark, d, False, rows))
    quality = checks.quality(panel.bars(spark, d), _members(spark, d, DQ_DAY), DQ_DAY, 5, warn=490)
    fills = panel.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"))
    return [_stored(c, "checks") for c in (quality, _risk_pre(spark, d, *two), _risk_post(*two))], fills, _kept_weights(spark, d, True, rows)


@query(REPORT)
def daily_report(spark, d):
    return reports.daily(*_report_parts(spark, d)).withColumn("value", _round("value", 6))


@query(f"WITH {_weights_sql(True)} SELECT date, symbol, CAST(CAST(round(weight, 6) AS DECIMAL(18, 6)) AS VARCHAR) AS weight FROM weights")
def report_signals(spark, d):
    """Weights of all days published as a report, and read back by its manifest."""
    root = shared_folder(spark, "signals")
    text = _round("weight", 6).cast("decimal(18,6)").cast("string")
    outputs.day_signals(root, _weights(spark, d).select("date", "symbol", text.alias("weight")), checks.quality(panel.bars(spark, d), _members(spark, d, DQ_DAY), DQ_DAY, 5), SIGNALS, DQ_DAY)
    return report.read(spark, f"{root}/signals")


DIGEST = f"""t AS (SELECT '|' || CAST(date AS VARCHAR) || '|' || symbol || '|' || CAST(CAST(ROUND6 AS DECIMAL(18, 6)) AS VARCHAR) AS line FROM weights),
h AS (SELECT sha256(line) AS h FROM t), s AS (SELECT count(*) AS rows, {', '.join(f"coalesce(sum(('0x' || h[{15 * i + 1}:{15 * i + 15}])::BIGINT), 0) AS s{i}" for i in range(4))} FROM h)
SELECT rows, sha256(rows || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS sha256 FROM s""".replace("ROUND6", "round(weight, 6)")


@query(f"WITH {_weights_sql(True)}, {DIGEST}")
def report_digest(spark, d):
    """The digest of the weights' table, as a report's manifest holds it."""
    weights = _weights(spark, d)
    return report.table_digest(weights.select("date", "symbol", _round("weight", 6).cast("decimal(18,6)").alias("weight")))


@query(REPORT)
def report_daily(spark, d):
    """The daily report, published and read back."""
    root = shared_folder(spark, "daily")
    outputs.daily(root, *_report_parts(spark, d))
    return report.read(spark, f"{root}/daily").withColumn("value", _round("value", 6))


@query(f"WITH {BARS} SELECT date, symbol, {_rounds(['open', 'high', 'low', 'close', 'adj_close'], 4)}, {_rounds(['volume'], 2)} FROM bars")
def vendor_history(spark, d):
    b = panel.bars(spark, d)
    text = lambda c: F.col(c).cast("string")
    one = F.struct(text("date").alias("date"), *(text(c).alias(c) for c in ("open", "high", "low", "close", "volume")), text("adj_close").alias("adjusted_close"))
    answers = b.groupBy(F.col("symbol").alias("key"), F.year("date").alias("year")).agg(F.to_json(F.collect_list(one)).alias("body"))
    h = vendor.history(answers)
    return h.select("date", "symbol", *(_round(c, 4).alias(c) for c in ("open", "high", "low", "close", "adj_close")), _round("volume", 2).alias("volume"))


@query(f"""WITH {BARS}, s AS (SELECT upper(s_name) AS symbol, s_suppkey FROM supplier) SELECT date, symbol, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS source, {_rounds(['close', 'adj_close'], 4)}, {_rounds(['volume'], 2)}
FROM bars JOIN s USING (symbol) WHERE s_suppkey % 7 <> 6""")
def backfill_resumed(spark, d):
    """Histories of symbols from two vendors: the first knows two of three, the second all but some; the first run is cut off after a batch."""
    b = panel.bars(spark, d).join(panel.table(spark, d, "supplier").select(F.upper("s_name").alias("symbol"), "s_suppkey"), "symbol")
    text = lambda c: F.col(c).cast("string")
    one = F.struct(text("date").alias("date"), *(text(c).alias(c) for c in ("open", "high", "low", "close", "volume")), text("adj_close").alias("adjusted_close"))
    known = _stored(b.groupBy(F.col("symbol").alias("key"), "s_suppkey").agg(F.to_json(F.collect_list(one)).alias("body")), "known")
    none = F.when(F.col("s_suppkey") % 7 == 6, F.lit("[]"))
    answers = [known.select("key", F.coalesce(none, F.when(F.col("s_suppkey") % 3 != 0, F.col("body"))).alias("body")), known.select("key", F.coalesce(none, F.col("body")).alias("body"))]
    root, runs = shared_folder(spark, "backfill"), []

    def source(i: int):
        def asked(keys: DataFrame) -> DataFrame:
            runs.append(i)
            if len(runs) == 2:
                raise ConnectionError("the run ends here")
            return answers[i].join(F.broadcast(keys), "key", "left_semi").select("key", "body", F.lit(None).cast("string").alias("error"))

        return asked

    wanted, sources = known.select("key"), [source(0), source(1)]
    size = max(1, known.count() // 3)
    try:
        backfill.fetched(root, wanted, sources, size)
    except ConnectionError:
        found = backfill.fetched(root, wanted, sources, size)
    rows = backfill.bars(found).join(found.select(F.upper("key").alias("symbol"), "source"), "symbol")
    return rows.select("date", "symbol", "source", *(_round(c, 4).alias(c) for c in ("close", "adj_close")), _round("volume", 2).alias("volume"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS month, o_orderkey, o_orderstatus FROM orders) SELECT o_orderkey AS orderkey, o_orderstatus AS status FROM m WHERE month = (SELECT max(month) FROM m)""")
def latest_log(spark, d):
    """The orders of the last of many logs, one a month, of which only that one is opened."""
    orders = panel.table(spark, d, "orders").where("o_orderdate is not null").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyyMM").alias("trade_once"))
    root = shared_folder(spark, "logs")
    orders.repartition("trade_once").write.partitionBy("trade_once").json(root)
    return files.latest_json(spark, root, "part-*.json", "orderkey long, status string", lines=True)


@query("""WITH k AS (SELECT s_suppkey AS id, s_suppkey % 5 AS kind FROM supplier) SELECT id, kind < 3 AS valid, (CASE WHEN kind IN (0, 1) THEN 10 + id % 7 ELSE 30 END)::INT AS top_k, CASE kind WHEN 0 THEN 0.1 WHEN 1 THEN 0.2 ELSE 0.05 END::DOUBLE AS max_weight, CASE WHEN kind = 0 THEN 0.3 ELSE 1.0 END::DOUBLE AS max_sector_weight,
CASE kind WHEN 1 THEN 0.15 ELSE 0.2 END::DOUBLE AS max_turnover, CASE kind WHEN 0 THEN 1000000 ELSE 5000000 END::DOUBLE AS min_adv, kind <> 1 AS long_only, 320 AS history_days,
CASE WHEN id % 4 = 1 THEN 'eodhd' WHEN id % 3 = 0 THEN 'crsp' WHEN id % 4 = 2 THEN NULL WHEN id % 2 = 0 THEN 'eodhd' END AS first, CASE WHEN id % 4 <> 1 AND id % 3 = 0 AND id % 2 = 0 THEN 'eodhd' END AS then_,
CASE WHEN id % 4 = 2 AND id % 3 <> 0 THEN 'the warehouse is not configured' WHEN id % 4 = 1 THEN NULL WHEN id % 3 <> 0 AND id % 2 = 1 THEN 'no source is configured' END AS error FROM k""")
def settings_signals(spark, d):
    """Settings out of JSON texts with sections that are there or not, some of them broken, and the source that each would ask."""
    k, i = F.col("kind"), F.col("id")
    s = panel.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("kind"))
    own = F.concat(F.lit('{"portfolio": {"top_k": '), (10 + i % 7).cast("string"), F.lit(', "max_weight_per_name": 0.1, "max_sector_weight": 0.3, "min_avg_daily_volume_usd": 1000000}, "signals": {"topk": 99}}'))
    other = F.concat(F.lit('{"portfolio": {"top_k": null}, "signals": {"topk": '), (10 + i % 7).cast("string"), F.lit(', "max_weight": 0.2, "long_only": false}, "risk": {"max_turnover_daily": 0.15}}'))
    text = F.when(k == 0, own).when(k == 1, other).when(k == 2, F.lit('{"portfolio": [1, 2]}')).when(k == 3, F.lit('{"portfolio": {"top_k": 5')).otherwise(F.lit(None))
    asked = F.when(i % 4 == 1, F.lit(" EODHD")).when(i % 4 == 2, F.lit("crsp")).when(i % 4 == 3, F.lit("auto"))
    choice = settings.chosen_source(asked, i % 3 == 0, (i % 2 == 0) | (i % 4 == 1))
    rows = settings.signal_settings(s.withColumn("doc", text), "id", "doc")
    return rows.join(s.select("id", choice.alias("c")), "id").select(*rows.columns, F.col("c.first").alias("first"), F.col("c.then").alias("then_"), F.col("c.error").alias("error"))


@query("""SELECT p_partkey, 0 AS number, true AS valid, 'TS_MEAN($close, ' || p_size || ')' AS cleaned FROM part
UNION ALL SELECT p_partkey, 1, p_size % 2 = 0, CASE WHEN p_size % 2 = 0 THEN 'RANK($volume)' ELSE 'FOO($volume)' END FROM part""")
def mined_expressions(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, "RANK").otherwise("FOO")
    listed = F.array(F.concat(F.lit("TS_MEAN($close,  "), F.col("p_size").cast("string"), F.lit(")")), F.concat(name, F.lit("($volume)")))
    parts = panel.table(spark, d, "part").select("p_partkey", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a small file, but each row is long in work
    answers = parts.select("p_partkey", F.to_json(F.struct(listed.alias("factors"))).alias("answer"))
    return mining.expressions_in(answers, "p_partkey", "answer").select("p_partkey", "number", "valid", "cleaned")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type AS symbol, min({'a': ts, 'b': event_id, 'c': value}) AS a, max({'a': ts, 'b': event_id, 'c': value}) AS z, max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY 1, 2)
SELECT date, symbol, a.c AS open, high, low, z.c AS close, n FROM d""")
def live_upsert(spark, d):
    return live.latest(live.run_to_end(live.live_bars(live.stream(spark, d, "events"), late=None)), ["date", "symbol"])


@query("""WITH l AS (SELECT user_id, event_id, 1000000000 + CAST(sum(CAST(coalesce(floor(value * 1e6 + 0.5::DOUBLE), 0) AS BIGINT)) OVER w AS BIGINT) AS equity, row_number() OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
m AS (SELECT *, max(equity) OVER w AS peak, lag(equity) OVER w AS prev FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN 1 - equity::DOUBLE / peak > 0.10::DOUBLE AND seen > 5 THEN 2 WHEN 1 - equity::DOUBLE / prev > 0.03::DOUBLE THEN 1 ELSE 0 END AS level FROM m""")
def live_monitor(spark, d):
    return live.monitored_entries(live.stream(spark, d, "events"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    out = shared_folder(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


WALK = walk_forward.Settings(train_months=24, valid_months=6, max_weight=MAX_W)


def _walk(spark, d) -> DataFrame:
    """Every fold's days with the three baselines, which come from the panel that is replayed."""
    days, rows = _replayed(spark, d)
    return days.join(_baselines(spark, d, rows).withColumnRenamed("date", "as_of_date"), "as_of_date", "left")


def _replayed(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every fold's days, and the scored panel. The calendar comes to the driver once, as folds need it there; the panel, which has what is
    to come of opens, and the folds' weights are stored once each: the driver holds every plan that it has run for a while, and
    memory for each job, so that nothing is planned again within another plan and no table opened twice."""
    read = panel.tables()
    days = sorted(r["date"] for r in panel.trading_days(spark, d, read).collect())
    calendar = spark.createDataFrame([(day, i) for i, day in enumerate(days)], "date date, idx long")
    rows = _with_sectors(_with_universe(_factors(spark, d, read), spark, d, read), spark, d, read)
    rows = walk_forward.opened_ahead(rows, calendar, WALK.lag, WALK.horizon)
    rows = scored(rows, ("date", "symbol", "entry", "exit", "adv20", "vol_21d", "mom_252d", "active", "sector"))
    good = F.col("active") & (F.coalesce("adv20", F.lit(0.0)) >= MIN_ADV) & F.col("score").isNotNull()
    rows = rows.select("date", "symbol", "entry", "exit", "adv20", "vol_21d", "mom_252d", "active", "sector", _round("score", 9).alias("score"), good.alias("eligible"))
    rows = _stored(rows, "scored")
    weights = _weights(spark, d, rows=rows.where("eligible"))
    return walk_forward.walk_forward(rows, weights, calendar, WALK, lambda w: _stored(w, "weights")), rows


FOLDS = f"""WITH RECURSIVE {CALENDAR}, days AS (SELECT list(date ORDER BY date) AS days FROM calendar), f(fold_id, goal) AS (
SELECT 0, (days[1] + INTERVAL 24 MONTH)::DATE FROM days WHERE len(days) >= 504
UNION ALL SELECT fold_id + 1, (train_end + INTERVAL 3 MONTH)::DATE FROM (STEPS) WHERE test_end > test_start AND test_end < days[-1] AND fold_id < 200)
SELECT fold_id::INT AS fold_id, days[1] AS train_start, train_end, valid_start, valid_end, test_start, test_end FROM (STEPS) WHERE test_end > test_start"""


def _fold_steps() -> str:
    """A fold's dates from its goal, one after the other: the trading day at or before, or at or after the n-th weekday on."""
    sql = "SELECT * FROM f, days"
    before = lambda t: f"list_filter(days, lambda x: x <= {t})[-1]"
    weekday = lambda t, n: f"list_filter(generate_series({t} + INTERVAL 1 DAY, {t} + INTERVAL 21 DAY, INTERVAL 1 DAY), lambda y: isodow(y) < 6)[{n}]"
    after = lambda t: f"list_filter(days, lambda x: x >= {t})[1]"
    for name, value in [("train_end", before("goal")), ("v", weekday("train_end", 6)), ("valid_start", after("v")), ("valid_end", before("valid_start + INTERVAL 6 MONTH")), ("u", weekday("valid_end", 1)), ("test_start", after("u")), ("test_end", before("test_start + INTERVAL 3 MONTH"))]:
        sql = f"SELECT *, {value} AS {name} FROM ({sql})"
    return sql


@query(FOLDS.replace("STEPS", _fold_steps()))
def folds(spark, d):
    return walk_forward.fold_table(panel.calendar(spark, d), WALK)


@query()
def walk_forward_run(spark, d):
    return _walk(spark, d).drop("held")


@query()
def walk_forward_summary(spark, d):
    return walk_forward.summarised(_stored(_replayed(spark, d)[0].drop("held"), "walk"))


@query()
def research_gates(spark, d):
    r = _stored(_walk(spark, d), "walk")
    return metrics.gates(r.drop("held"), 500, 1.0, walk_forward.greatest_share(r), ["fold_id", "as_of_date"])


_sharpe = lambda x: f"CASE WHEN count({x}) = 0 THEN 0 WHEN stddev_samp({x}) <= 0 THEN 0 ELSE avg({x}) / nullif(stddev_samp({x}), 0) * sqrt(252) END"
RUN = f"""{DAILY}, run AS (SELECT CAST(month(date) % 3 AS INT) AS fold_id, date AS as_of_date, date + 1 AS entry_date, date + 2 AS exit_date, r / 50 - 0.0005::DOUBLE AS net_return, r / 50 AS gross_return, 0.1::DOUBLE + day(date) % 10 / 100::DOUBLE AS turnover,
  CASE WHEN day(date) % 3 > 0 THEN r / 200 END AS baseline_spy, -r AS baseline_momentum FROM daily),
eq AS (SELECT *, exp(sum(ln(1 + net_return)) OVER o) AS equity FROM run WINDOW o AS (ORDER BY fold_id, as_of_date)), worst AS (SELECT max(1 - equity / peak) AS worst FROM (SELECT equity, max(equity) OVER (ORDER BY fold_id, as_of_date) AS peak FROM eq))"""


def _run(spark, d) -> DataFrame:
    """Results of a run as they would be, from the panel's mean returns: three folds, two baselines."""
    r, day = F.col("r"), F.dayofmonth("date")
    return _daily(spark, d).select(
        (F.month("date") % 3).alias("fold_id"), F.col("date").alias("as_of_date"), F.date_add("date", 1).alias("entry_date"), F.date_add("date", 2).alias("exit_date"), (r / 50 - 0.0005).alias("net_return"), (r / 50).alias("gross_return"),
        (0.1 + day % 10 / 100).alias("turnover"), F.when(day % 3 > 0, r / 200).alias("baseline_spy"), (-r).alias("baseline_momentum"),
    )


@query(f"""WITH {RUN}, b AS (SELECT bin, {_sharpe('net_return')} AS s FROM (SELECT net_return, CASE WHEN n > 1 THEN greatest(ceil(p * least(8, n)::DOUBLE / (n - 1)) - 1, 0) ELSE 0 END AS bin
  FROM (SELECT net_return, row_number() OVER (ORDER BY fold_id, as_of_date) - 1 AS p, count(*) OVER () AS n FROM run)) GROUP BY bin), good AS (SELECT (count(*) FILTER (s > 0))::DOUBLE AS good FROM b),
one AS (SELECT {_sharpe('net_return')} AS net, count(*) AS n, avg(turnover) AS turnover, greatest({_sharpe('baseline_spy')}, {_sharpe('baseline_momentum')}) AS beaten FROM run),
a AS (SELECT *, net - sqrt(2 * ln(500::DOUBLE)) / sqrt(greatest(n / 252::DOUBLE, 1e-9::DOUBLE)) AS dsr FROM one, good, worst)
SELECT gate, n > 0 AND passed AS passed, round(metric, 6) AS metric FROM (SELECT n, unnest([{{'gate': 'deflated_sharpe', 'passed': dsr > 0.5, 'metric': dsr}}, {{'gate': 'subperiods', 'passed': good >= 6, 'metric': good}}, {{'gate': 'sector_share', 'passed': true, 'metric': 0.3::DOUBLE}},
  {{'gate': 'drawdown', 'passed': worst < 0.25, 'metric': worst}}, {{'gate': 'turnover', 'passed': turnover < 0.30, 'metric': turnover}}, {{'gate': 'factor_overlap', 'passed': false, 'metric': 0.4::DOUBLE}},
  {{'gate': 'baselines', 'passed': net > beaten, 'metric': net - beaten}}, {{'gate': 'net_sharpe', 'passed': net > 0.4, 'metric': net}}], recursive := true) FROM a)""")
def gates_of_returns(spark, d):
    return _rounded(metrics.gates(_stored(_run(spark, d), "run"), 500, 0.4, 0.3, ["fold_id", "as_of_date"]), ["gate", "passed"], ["metric"])


@query(f"""WITH {RUN} SELECT count(DISTINCT fold_id) AS num_folds, count(*) AS num_observations, CAST(min(entry_date) AS VARCHAR) AS start_date, CAST(max(exit_date) AS VARCHAR) AS end_date, round({_sharpe('gross_return')}, 6) AS gross_sharpe, round({_sharpe('net_return')}, 6) AS net_sharpe,
round(avg(turnover), 6) AS avg_turnover, round(product(1 + net_return) - 1, 6) AS cumulative_net_return, round((SELECT worst FROM worst), 6) AS max_drawdown FROM run""")
def run_summary(spark, d):
    one = walk_forward.summarised(_stored(_run(spark, d), "run"))
    return _rounded(one, ["num_folds", "num_observations", "start_date", "end_date"], ["gross_sharpe", "net_sharpe", "avg_turnover", "cumulative_net_return", "max_drawdown"])


@query(f"""WITH {_weights_sql(True)}, h AS (SELECT coalesce(sector, 'Unknown') AS sector, weight, ret_1d AS ret FROM weights JOIN factors USING (date, symbol) LEFT JOIN sectors USING (symbol)), s AS (SELECT sector, sum(abs(weight * ret)) AS pnl FROM h GROUP BY sector)
SELECT sector, round(pnl / nullif(sum(pnl) OVER (), 0), 6) AS share FROM s""")
def held_sector_shares(spark, d):
    """Sectors' shares of what weights earned or lost, from days with what was held on each."""
    rows = _eligible_of(_factors(spark, d), spark, d, ("ret_1d",)).select("date", "symbol", "score", "sector", F.col("ret_1d").alias("ret"))
    rows = portfolio.desired_weights(rows, TOP_K, MAX_W, SECTOR_CAP, keep=("ret",))
    held = rows.groupBy("date").agg(F.collect_list(F.struct("symbol", "weight", "ret")).alias("held"))
    return _rounded(walk_forward.sector_shares(held, panel.sectors(spark, d)), ["sector"], ["share"])


@query(f"WITH {_weights_sql(True)} SELECT date, symbol, round(weight, 6) AS weight FROM weights WHERE date = (SELECT max(date) FROM weights WHERE date <= DATE '2001-06-30') AND symbol NOT LIKE '%3'")
def latest_signals(spark, d):
    """The signals a trade starts from: the latest day's up to a date, weights as text, some of them below 0 or no number."""
    ends = F.col("symbol").endswith
    text = F.when(ends("3") & (F.length("symbol") % 2 == 0), F.lit("none")).when(ends("3"), F.lit("-0.1")).otherwise(F.col("weight").cast("string"))
    rows = _kept_weights(spark, d, True, _recent_eligible(spark, d, "2001-06-30")).select(F.col("date").cast("string").alias("date"), F.lower("symbol").alias("symbol"), text.alias("weight"))
    return _rounded(jobs.latest_signals(rows), ["date", "symbol"], ["weight"])


SETS = f"""{MEMBERS}, old AS (SELECT DISTINCT symbol FROM members WHERE date <= DATE '1996-06-30'), cur AS (SELECT DISTINCT symbol FROM members WHERE date = (SELECT max(date) FROM members))"""


@query(f"WITH {SETS} SELECT 'union' AS kind, symbol FROM (FROM old UNION FROM cur) UNION ALL SELECT 'both', symbol FROM (FROM old INTERSECT FROM cur) UNION ALL SELECT 'gone', symbol FROM (FROM old EXCEPT FROM cur)")
def membership_sets(spark, d):
    """Symbols that were members once, are now, are still, or no more."""
    members = _stored(_members(spark, d), "members")
    old = members.where("date <= '1996-06-30'").select("symbol").distinct()
    cur = members.join(F.broadcast(members.agg(F.max("date").alias("date"))), "date", "left_semi").select("symbol").distinct()
    return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), "symbol") for kind, rows in (("union", old.union(cur).distinct()), ("both", old.intersect(cur)), ("gone", old.subtract(cur)))])


@query(f"WITH {MEMBERS}, n AS (SELECT date, count(DISTINCT symbol) AS n FROM members WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' GROUP BY date) SELECT (SELECT count(*) FROM members WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') AS membership_rows, (SELECT count(DISTINCT symbol) FROM members WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') AS unique_symbols, CAST(min(date) AS VARCHAR) AS date_min, CAST(max(date) AS VARCHAR) AS date_max, min(n) AS min_members, max(n) AS max_members FROM n")
def membership_summary(spark, d):
    """What a membership table holds over a range of dates."""
    return membership.summary(_members(spark, d), "1997-01-01", "1999-12-31")


@query(f"WITH {BARS} SELECT date, symbol, round(round(close, 6), 4) AS close, round(adj_close, 4) AS adj_close, round(round(close, 6) * round(volume, 2), 2) AS dollar_volume FROM bars WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def vendor_bulk(spark, d):
    """Bars of days from one answer a day with all symbols, some of its objects broken."""
    b = panel.bars(spark, d).where("date between '1998-03-01' and '1998-03-31'")
    one = F.to_json(F.struct(F.lower("symbol").alias("code"), F.col("date").cast("string").alias("date"), _round("close", 6).alias("close"), "adj_close", _round("volume", 2).cast("string").alias("volume")))
    bodies = b.groupBy(F.col("date").cast("string").alias("key")).agg(F.concat(F.lit('[{"code": null, "close": 1}, '), F.array_join(F.collect_list(F.replace(one, F.lit("adj_close"), F.lit("adjusted_close"))), ", "), F.lit("]")).alias("body"))
    none = spark.createDataFrame([("broken", "[{"), ("none", None)], "key string, body string")
    return _rounded(vendor.bulk_day(bodies.unionByName(none)), ["date", "symbol"], ["close", "adj_close"], 4).join(vendor.bulk_day(bodies).select("date", "symbol", _round("dollar_volume", 2).alias("dollar_volume")), ["date", "symbol"])


@query("SELECT upper(s_name) AS code, n_name AS name, DATE '1996-01-01' + CAST(s_suppkey % 300 AS INT) AS start_date, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2001-01-01' END AS end_date, s_suppkey % 4 <> 0 AS active FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def vendor_members(spark, d):
    """Constituents from an answer for each nation, under either key, as a list or as an object by position."""
    s = panel.table(spark, d, "supplier").join(panel.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    gone = F.col("s_suppkey") % 4 == 0
    start = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("s_suppkey") % 300).cast("int")).cast("string")
    one = F.struct(F.lower("s_name").alias("Code"), F.col("n_name").alias("Name"), start.alias("StartDate"), F.when(gone, "2001-01-01").alias("EndDate"), F.when(gone, "0").otherwise("1").alias("IsActiveNow"))
    lists = s.groupBy("n_nationkey").agg(F.collect_list(one).alias("l"))
    by_place = F.map_from_entries(F.transform("l", lambda x, i: F.struct(i.cast("string"), x)))
    k = F.col("n_nationkey") % 3
    body = F.when(k == 0, F.concat(F.lit('{"HistoricalTickerComponents": '), F.to_json(by_place), F.lit("}"))).when(k == 1, F.concat(F.lit('{"Components": '), F.to_json("l"), F.lit("}"))).otherwise(F.to_json("l"))
    return vendor.members(lists.select(F.col("n_nationkey").cast("string").alias("key"), body.alias("body")))


@query("""SELECT upper(p_name) AS symbol, DATE '1999-01-01' + CAST(p_partkey % 90 AS INT) AS date, 'split' AS kind, (p_size % 4 + 1) || '/1' AS value FROM part UNION ALL SELECT upper(p_name), DATE '1999-06-01' + CAST(p_partkey % 30 AS INT), 'dividend', CAST(p_size AS VARCHAR) FROM part WHERE p_size % 5 > 0
UNION ALL SELECT NULL, NULL, 'listed', p_brand FROM (SELECT DISTINCT p_brand FROM part)""")
def vendor_actions(spark, d):
    """Splits, dividends and listed symbols from their answers; dates and amounts that can't be read give no row, or no value."""
    p = panel.table(spark, d, "part")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (F.col("p_partkey") % n).cast("int")).cast("string")
    answer = lambda *fields: F.to_json(F.array(F.struct(*fields), F.struct(F.lit("no date").alias("date"), F.lit("1").alias("x"))))
    split = p.select(F.col("p_name").alias("key"), answer(day("1999-01-01", 90).alias("date"), F.concat((F.col("p_size") % 4 + 1).cast("string"), F.lit("/1")).alias("x")).alias("body"))
    named = lambda name: F.replace("body", F.lit('"x"'), F.lit(f'"{name}"'))
    paid = p.select(F.col("p_name").alias("key"), answer(day("1999-06-01", 30).alias("date"), F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("string")).otherwise("?").alias("x")).alias("body"))
    lists = p.select("p_brand").distinct().select(F.lit("US").alias("key"), F.to_json(F.array(F.struct(F.lower("p_brand").alias("Code"), F.lit("n").alias("Name")))).alias("body"))
    s = vendor.splits(split.withColumn("body", named("split"))).select("symbol", "date", F.lit("split").alias("kind"), F.col("split").alias("value"))
    v = vendor.dividends(paid.withColumn("body", named("value"))).where("value is not null").select("symbol", "date", F.lit("dividend").alias("kind"), F.col("value").cast("long").cast("string").alias("value"))
    known = vendor.listed_symbols(lists).join(p.select(F.upper("p_brand").alias("symbol"), "p_brand").distinct(), "symbol")
    return s.unionByName(v).unionByName(known.select(F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("date").alias("date"), F.lit("listed").alias("kind"), F.col("p_brand").alias("value")))


_full = lambda f, n, x="close": f"CASE WHEN count({x}) {_w(n)} >= {n} THEN {f} {_w(n)} END"
EXPRESSIONS = {
    "ts_mean": ("TS_MEAN($close, 5)", _full("avg(close)", 5)),
    "ts_sum": ("TS_SUM($volume, 5)", _full("sum(volume)", 5, "volume")),
    "ts_max": ("TS_MAX($close, 7)", _full("max(close)", 7)),
    "ts_min": ("TS_MIN($close, 7)", _full("min(close)", 7)),
    "ts_std": ("TS_STD($close, 10)", _full("stddev_samp(close)", 10)),
    "ts_corr": ("TS_CORR($close, $volume, 10)", _full("corr(close, volume)", 10)),
    "ts_cov": ("TS_COV($close, $volume, 10)", _full("covar_samp(close, volume)", 10)),
    "delay": ("DELAY($close, 3)", "lag(close, 3) OVER (PARTITION BY symbol ORDER BY date)"),
    "delta": ("TS_DELTA($close, 2)", "close - lag(close, 2) OVER (PARTITION BY symbol ORDER BY date)"),
    "rank": ("RANK($close)", "(rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date ORDER BY close RANGE BETWEEN CURRENT ROW AND CURRENT ROW) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY date)"),
    "zscore": ("ZSCORE($close)", "(close - avg(close) OVER (PARTITION BY date)) / nullif(stddev_samp(close) OVER (PARTITION BY date), 0)"),
    "demean": ("CS_DEMEAN($close)", "close - avg(close) OVER (PARTITION BY date)"),
    "if_else": ("IF($close > $open, MAX($close, 1000), MIN($open, 1500)) + BOUND($volume, 5, 20)", "CASE WHEN close > open THEN greatest(close, 1000) ELSE least(open, 1500) END + greatest(5, least(volume, 20))"),
    "scalar": ("SIGN($close - $open) * SQRT(ABS($close - $open)) + LOG($volume) / POWER(2, 3)", "sign(close - open) * sqrt(abs(close - open)) + ln(volume) / 8::DOUBLE"),
    "count": ("COUNT($close > $open, 10)", f"sum(CASE WHEN close > open THEN 1 ELSE 0 END) {_w(10)}"),
    "nested": ("TS_MEAN(RANK($close), 5) - DELAY(TS_MAX($high, 3), 1)", f"{_full('avg(r)', 5, 'r')} - lag(m) OVER s"),
    "ts_rank": ("TS_RANK($close, 6)", "CASE WHEN len(l) >= 6 THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2.0::DOUBLE) / 6 END"),
    "ts_argmax": ("TS_ARGMAX($close, 6)", f"CASE WHEN count(close) {_w(6)} >= 6 THEN list_position(list(close) {_w(6)}, max(close) {_w(6)}) - 1 END"),
    "ts_argmin": ("TS_ARGMIN($close, 6)", f"CASE WHEN count(close) {_w(6)} >= 6 THEN list_position(list(close) {_w(6)}, min(close) {_w(6)}) - 1 END"),
    "ts_decay_linear": ("TS_DECAY_LINEAR($close, 3)", "(close * 3 + lag(close, 1) OVER s * 2 + lag(close, 2) OVER s) / 6::DOUBLE"),
    "ts_product": ("TS_PRODUCT($close / 1000, 3)", "close / 1000 * (lag(close, 1) OVER s / 1000) * (lag(close, 2) OVER s / 1000)"),
    "ema": ("EMA($close, 5)", "y"),
}
#: Columns that some of them need first.
BEFORE = {
    "nested": f"bars AS (SELECT date, symbol, {EXPRESSIONS['rank'][1]} AS r, {_full('max(high)', 3, 'high')} AS m FROM bars_)",
    "ts_rank": f"bars AS (SELECT *, list(close) {_w(6)} AS l FROM bars_)",
    "ema": """numbered AS MATERIALIZED (SELECT date, symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars_),
bars AS (SELECT date, symbol, k, close AS y FROM numbered WHERE k = 1 UNION ALL SELECT n.date, n.symbol, n.k, n.close / 3::DOUBLE + b.y * 2 / 3::DOUBLE FROM bars b JOIN numbered n ON n.symbol = b.symbol AND n.k = b.k + 1)""",
}


def _expression_query(name: str, text: str, sql: str | None) -> None:
    def run(spark, d):
        return expressions.evaluated(panel.bars(spark, d), text).select("date", "symbol", _round(F.col("value").cast("double"), 5).alias("value"))

    ctes = f"RECURSIVE {BARS.replace('bars AS', 'bars_ AS')}, {BEFORE[name]}" if name in BEFORE else BARS
    Q[f"expr_{name}"] = (run, f"WITH {ctes} SELECT date, symbol, round(({sql})::DOUBLE, 5) AS value FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY date)")


for _name, (_text, _sql) in EXPRESSIONS.items():
    _expression_query(_name, _text, _sql)


def _plain_rounds(sql: str) -> str:
    """round(x, n) written as floor(x * 10^n + 0.5) / 10^n, as rounded() has it."""
    while (at := re.search(r"\bround\(", sql)) is not None:
        depth, i = 1, at.end()
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            i += 1
        inner, digits = sql[at.end() : i - 1].rsplit(",", 1)
        power = f"1e{int(digits)}"
        sql = f"{sql[: at.start()]}(floor(({inner}) * {power} + 0.5::DOUBLE) / {power}){sql[i:]}"
    return sql


#: Columns of dates in results; they are returned as text, which both engines write alike.
NO_DATE = {"sharpe", "drawdown", "compound_return", "subperiods", "sector_pnl_share", "universe_validate", "interval_join_names", "coverage_report", "coverage_anti", "sic_sector", "dq_suite", "dq_faults", "dq_late", "dq_carried", "dq_carried_faults", "risk_pre", "risk_post", "daily_report", "report_daily", "report_digest", "html_tables", "html_snapshot", "html_pages", "latest_log", "gates_of_returns", "run_summary", "held_sector_shares", "membership_sets", "membership_summary", "settings_signals", "order_intents", "equity_monitor", "fill_counts", "mined_expressions", "live_monitor"}
DATES = {"interval_overlap": ("common_start", "common_end"), "ticker_changes": ("effective_date",), "calendar_shift": ("date", "shifted"), "warehouse_constituents": ("start_date", "end_date"), "vendor_members": ("start_date", "end_date"), "folds": ("train_start", "train_end", "valid_start", "valid_end", "test_start", "test_end")} | {name: () for name in NO_DATE}


def _texts(f):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

    return run


def queries() -> dict:
    return {name: _texts(f) for name, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in Q.items():
        if sql:
            sql = _plain_rounds(sql)
            texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in DATES.get(name, ("date",)))
            out[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if texts else sql
    return out
