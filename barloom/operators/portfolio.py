"""Target weights from scores in closed form for all dates at once, the turnover cap, and order intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def eligible(df: DataFrame, min_adv: float) -> DataFrame:
    return df.where((F.coalesce("adv20", F.lit(0.0)) >= min_adv) & F.col("score").isNotNull())


def desired_weights(df: DataFrame, top_k: int, max_weight: float, max_sector_weight: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """date, symbol, score, weight, and columns in keep: names by score get equal weights up to the caps, then the rest is dealt out in order.

    df has date, symbol, score and, with a sector cap, sector; (date, symbol) is unique. Only the names that a sector, or a date,
    has room for are shuffled.
    """
    tw, capped = min(1 / top_k, max_weight), max_sector_weight is not None and max_sector_weight < 0.999999
    cap = min(max(max_sector_weight or 0.0, 0.0), 1.0)
    order = (F.desc("score"), F.asc("symbol"))
    day, before = Window.partitionBy("date"), (Window.unboundedPreceding, -1)
    sector = Window.partitionBy("date", "sector")
    zero = F.lit(0.0)
    if capped:
        df = df.withColumn("place", F.row_number().over(sector.orderBy(*order))).where(F.col("place") <= (int(cap / tw) + 1 if tw > 0 else 1))
    a = F.greatest(zero, F.least(F.lit(tw), F.lit(cap) - (F.col("place") - 1) * tw)) if capped else F.lit(tw)
    df = df.withColumn("a", a).where("a > 1e-10").withColumn("rn", F.row_number().over(day.orderBy(*order))).where(F.col("rn") <= top_k)
    df = df.withColumns({"left": F.greatest(1 - F.sum("a").over(day), zero), "room": max_weight - F.col("a")})
    if capped:
        df = df.withColumn("used", F.sum("a").over(sector)).withColumn("taken", F.coalesce(F.sum("room").over(sector.orderBy(*order).rowsBetween(*before)), zero))
        df = df.withColumn("b", F.greatest(zero, F.least(F.col("room"), cap - F.col("used") - F.col("taken"))))
    else:
        df = df.withColumn("b", F.col("room"))
    df = df.withColumn("dealt", F.coalesce(F.sum("b").over(day.orderBy(*order).rowsBetween(*before)), zero))
    more = F.when(F.col("left") > 1e-10, F.greatest(zero, F.least(F.col("b"), F.col("left") - F.col("dealt")))).otherwise(0.0)
    df = df.withColumn("w", F.col("a") + more).withColumn("total", F.sum("w").over(day))
    return df.withColumn("weight", F.when(F.col("total") > 1 + 1e-10, F.col("w") / F.col("total")).otherwise(F.col("w"))).where("weight > 1e-8").select("date", "symbol", "score", "weight", *keep)


def capped_turnover(desired: DataFrame, previous: DataFrame, max_turnover: float, max_weight: float, keys: tuple = ("date", "symbol")) -> DataFrame:
    """One step from previous to desired weights, moved only so far that half the sum of changes keeps to max_turnover.

    Without previous weights for a date the desired ones stand.
    """
    both = desired.select(*keys, F.col("weight").alias("d")).join(previous.select(*keys, F.col("weight").alias("p")), list(keys), "full")
    return _moved(both, max_turnover, max_weight, keys)


def turnover_steps(weights: DataFrame, following: DataFrame, max_turnover: float, max_weight: float) -> DataFrame:
    """capped_turnover() of every date's weights from those of the trading day before; following: date and the one after it, shifted.

    Each weight stands on its own date and, as the previous one, on the next; both meet in one shuffle by date, and weights
    are planned once.
    """
    none = F.lit(None).cast("double")
    on = lambda date, d, p: F.struct(F.col(date).alias("date"), d.alias("d"), p.alias("p"))
    rows = weights.join(F.broadcast(following.select("date", "shifted")), "date").select("symbol", F.inline(F.array(on("date", F.col("weight"), none), on("shifted", none, F.col("weight")))))
    both = rows.where("date is not null").repartition("date").groupBy("date", "symbol").agg(F.max("d").alias("d"), F.max("p").alias("p"))
    return _moved(both, max_turnover, max_weight, ("date", "symbol"))


def _moved(both: DataFrame, max_turnover: float, max_weight: float, keys: tuple) -> DataFrame:
    """Weights on the way from p to d; null counts as 0."""
    group = Window.partitionBy(*keys[:-1])
    both = both.withColumn("none", F.count("p").over(group) == 0).fillna(0.0, ["d", "p"])
    both = both.withColumn("turn", 0.5 * F.sum(F.abs(F.col("d") - F.col("p"))).over(group))
    step = F.least(F.greatest(F.col("p") + F.try_divide(F.lit(max_turnover), F.col("turn")) * (F.col("d") - F.col("p")), F.lit(0.0)), F.lit(max_weight))
    free = F.col("none") | F.lit(max_turnover <= 0) | (F.col("turn") <= max_turnover)
    both = both.withColumn("w", F.when(free, F.col("d")).otherwise(step)).withColumn("total", F.sum("w").over(group))
    return both.withColumn("weight", F.when(~free & (F.col("total") > 1), F.col("w") / F.col("total")).otherwise(F.col("w"))).where("weight > 1e-8").select(*keys, "weight")


def order_intents(targets: DataFrame, positions: DataFrame, equity: float, min_trade: float = 25.0) -> DataFrame:
    """Orders that move positions (symbol, market_value, qty, current_price) to targets (symbol, weight)."""
    both = targets.select("symbol", (F.col("weight") * equity).alias("target_value")).join(positions, "symbol", "full").fillna(0.0, ["target_value", "market_value", "qty", "current_price"])
    delta = F.col("target_value") - F.col("market_value")
    df = both.withColumn("delta_value", delta).where(F.abs("delta_value") >= min_trade).withColumn("side", F.when(F.col("delta_value") > 0, "buy").otherwise("sell"))
    sells = (F.col("side") == "sell") & (F.col("current_price") > 0)
    qty = F.when(sells, F.bround(F.least(F.abs("delta_value") / F.nullif("current_price", F.lit(0.0)), F.col("qty")), 6))
    return df.select("symbol", "side", F.bround("delta_value", 6).alias("delta_value"), F.when(~sells, F.bround(F.abs("delta_value"), 2)).alias("notional"), qty.alias("qty"), F.col("current_price").alias("price"))
