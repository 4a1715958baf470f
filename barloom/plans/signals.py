"""A day's signals: the universe's names by score, weighted, and moved from the last weights within the turnover cap."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import rounded
from barloom.operators import portfolio
from barloom.operators.factors import factors, scored

#: Names the rule by which scores are made, in a model's hash.
MODEL = "rank_mean_v1"


@dataclass(frozen=True)
class Settings:
    top_k: int = 30
    max_weight: float = 0.05
    max_sector_weight: float | None = 0.30
    max_turnover: float = 0.20
    min_adv: float = 1e6
    history_days: int = 320


def generate(bars: DataFrame, members: DataFrame, sectors: DataFrame, as_of: str | None, s: Settings, previous: DataFrame | None = None) -> DataFrame:
    """date, symbol, score, weight of one day: as_of, or the latest with bars.

    Only history_days of bars before it are read, and ranks are taken on that day alone. An empty universe filters
    nothing. previous (symbol, weight) are the last weights, if any; names that are no longer eligible are left out.
    """
    day = as_of or str(bars.agg(F.max("date")).first()[0])
    at = F.lit(day).cast("date")
    recent = bars.where((F.col("date") <= at) & (F.col("date") >= F.date_sub(at, max(s.history_days, 60))))
    rows = portfolio.eligible(scored(factors(recent).where(F.col("date") == at)), s.min_adv)
    active = members.where((F.col("date") == at) & F.col("active")).select("symbol").distinct()
    if not active.isEmpty():
        rows = rows.join(active, "symbol", "left_semi")
    rows = rows.withColumn("score", rounded(F.col("score"), 9)).join(F.broadcast(sectors.select("symbol", "sector")), "symbol", "left").fillna("Unknown", ["sector"])
    rows = rows.select("date", "symbol", "score", "sector")
    weights = portfolio.desired_weights(rows, s.top_k, s.max_weight, s.max_sector_weight)
    if previous is None:
        return weights
    moved = portfolio.capped_turnover(weights, previous.select(at.alias("date"), F.upper("symbol").alias("symbol"), "weight"), s.max_turnover, s.max_weight)
    return moved.join(rows.select("symbol", "score"), "symbol").select("date", "symbol", "score", "weight")


def metadata(as_of: str, s: Settings, path: str, checks: DataFrame) -> dict:
    """What is kept beside signals: the settings' hash, the model's, where they lie and the checks they passed."""
    config = hashlib.sha256(json.dumps(asdict(s), sort_keys=True).encode()).hexdigest()
    model = hashlib.sha256(f"{config}|{MODEL}".encode()).hexdigest()
    return {"as_of": as_of, "model_name": MODEL, "model_version_hash": model, "config_hash": config, "signals_file": path, "quality": [r.asDict() for r in checks.collect()]}
