"""The runs of this engine over a workspace: membership, backfill, ingest, coverage, signals, research, trades, halts, reports.

    root/bars                     a Store of daily bars
    root/membership, root/sectors, root/mapping   Parquet tables
    root/out/<job>/...            reports, each with its manifest

A job reads tables of the workspace, publishes what it made, and gives a summary. Nothing is sent to a broker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.columns import rounded
from barloom.operators import checks, membership, metrics, portfolio
from barloom.operators.factors import factors, scored
from barloom.plans import backfill, chain, ingest, outputs, signals, walk_forward
from barloom.plans.ingest import Halted, Session, stored
from barloom.sources import panel, report, sessions
from barloom.sources.store import Store

MEMBERS = T.StructType([T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("permno", T.LongType()), T.StructField("active", T.BooleanType())])
SECTORS = T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "sector", "industry", "name")])
MAPPING = T.StructType([T.StructField("old_symbol", T.StringType()), T.StructField("new_symbol", T.StringType())])
#: Sessions that days may be counted by.
CALENDARS: dict[str, Session] = {"exchange": sessions.is_session, "weekday": sessions.is_weekday}


@dataclass(frozen=True)
class Workspace:
    spark: SparkSession
    root: str

    @property
    def bars(self) -> Store:
        return Store(self.spark, f"{self.root}/bars", panel.BARS)

    def out(self, job: str) -> str:
        return f"{self.root}/out/{job}"

    def members(self) -> DataFrame:
        return panel.scan(self.spark, f"{self.root}/membership", MEMBERS)

    def sectors(self) -> DataFrame:
        """A row a symbol, "Unknown" where the sector is null."""
        return panel.scan(self.spark, f"{self.root}/sectors", SECTORS).fillna("Unknown", ["sector"]).dropDuplicates(["symbol"])

    def mapping(self) -> DataFrame:
        return panel.scan(self.spark, f"{self.root}/mapping", MAPPING)

    def put(self, name: str, df: DataFrame) -> DataFrame:
        panel.publish(stored(df, name), f"{self.root}/{name}")
        return df

    def flagged(self, name: str) -> bool:
        said = report.manifest(f"{self.out('flags')}/{name}")
        return said is not None and said["rows"] > 0


def _calendar(ws: Workspace, start: str, end: str, calendar: str) -> DataFrame:
    days = F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), CALENDARS[calendar])
    return ws.spark.range(1).select(F.explode(days).alias("date"))


def member_summary(members: DataFrame, start: str | None = None, end: str | None = None) -> dict:
    return membership.summary(members, start, end).first().asDict()


def build_membership(ws: Workspace, constituents: DataFrame, start: str, end: str, mapping: DataFrame | None = None, calendar: str = "exchange") -> dict:
    """Daily membership out of intervals (code, start_date, end_date, and permno, sector, industry, name if there are any)."""
    if constituents.isEmpty():
        raise Halted("no constituents")
    rows = constituents if "permno" in constituents.columns else constituents.withColumn("permno", F.lit(None).cast("long"))
    day = lambda x: F.lit(x).cast("date")
    ws.put("membership", membership.expanded(rows, _calendar(ws, start, end, calendar), day(start), day(end)).select(MEMBERS.names))
    text = lambda c: F.col(c) if c in constituents.columns else F.lit(None).cast("string")
    first = constituents.groupBy(F.upper("code").alias("symbol")).agg(F.min(F.struct(*(text(c).alias(c) for c in ("sector", "industry", "name")))).alias("f"))
    ws.put("sectors", first.select("symbol", "f.*"))
    ws.put("mapping", ws.spark.createDataFrame([], MAPPING) if mapping is None else membership.ticker_mapping(mapping))
    return member_summary(ws.members())


def build_membership_approx(ws: Workspace, snapshot: DataFrame, order, start: str, end: str, calendar: str = "exchange") -> dict:
    """Daily membership of a snapshot's constituents on all days: what is left out of the index since is not known to it."""
    current = membership.snapshot(snapshot, order)
    rows = membership.constant_membership(current.select(F.col("code").alias("symbol")), _calendar(ws, start, end, calendar))
    ws.put("membership", rows.select("date", "symbol", F.lit(None).cast("long").alias("permno"), "active"))
    ws.put("sectors", current.select(F.col("code").alias("symbol"), "sector", "industry", "name"))
    return member_summary(ws.members()) | {"mode": "approx_current_constituents", "survivorship_bias": True}


def backfill_history(ws: Workspace, sources: list[backfill.Source], keys_a_batch: int = 500, most_symbols: int = 0) -> dict:
    """History of all members from sources into the store; a run that was cut off goes on. most_symbols, if any, is for trials."""
    wanted = ws.members().select(F.col("symbol").alias("key")).distinct()
    wanted = wanted.orderBy("key").limit(most_symbols) if most_symbols else wanted
    if wanted.isEmpty():
        raise Halted("no members")
    rows = stored(backfill.bars(backfill.fetched(f"{ws.root}/backfill", wanted, sources, keys_a_batch)), "history")
    if rows.isEmpty():
        raise Halted("no prices of any symbol")
    ingest.load(ws.bars, rows)
    return backfill.summary(wanted, rows).first().asDict()


def ingest_day(ws: Workspace, day: str, new: DataFrame, fetch: ingest.Fetch | None = None, mode: str = "strict", calendar: str = "weekday", **options) -> dict:
    """A day's bars into the store, behind the checks; a summary is published."""
    done = ingest.ingest_day(ws.bars, ws.members(), day, new, fetch, strict=mode == "strict", session=CALENDARS[calendar], **options)
    report.published(ws.spark.createDataFrame(done["quality"], "suite string, check string, passed boolean, severity string, value double"), ws.out("ingest"), **{k: v for k, v in done.items() if k != "quality"})
    return done


def coverage(ws: Workspace) -> dict:
    """How many members have bars, by date, and members that once were and now are not."""
    members = ws.members()
    by = stored(membership.coverage(members, ws.bars.read()), "coverage")
    return report.published(by, ws.out("coverage"), **member_summary(members))


def generate_signals(ws: Workspace, as_of: str | None, settings: signals.Settings, least: int = 480, previous: DataFrame | None = None) -> dict:
    """Signals of a day, if its bars pass the checks in strict mode; published with the hashes of settings and model."""
    store = ws.bars
    held = store.dates().where(F.lit(True) if as_of is None else F.col("date") <= F.lit(as_of).cast("date"))
    day = as_of or str(held.agg(F.max("date")).first()[0])
    window = store.read(start=str(ws.spark.range(1).select(F.date_sub(F.lit(day).cast("date"), max(settings.history_days, 60))).first()[0]), end=day)
    members = stored(membership.renamed(ws.members(), ws.mapping()), "members")
    state = checks.carried(window, before=day)
    found = stored(checks.quality_of_day(window.where(F.col("date") == F.lit(day).cast("date")), state, members, day, least), "checks")
    if failed := [r["check"] for r in found.where(checks.halting(True)).collect()]:
        raise Halted(f"failed: {', '.join(sorted(failed))}")
    weights = stored(signals.generate(window, members, ws.sectors(), day, settings, previous), "weights")
    made = outputs.day_signals(ws.out("signals"), weights, found, settings, day)
    return {"as_of": day, "positions": made["signals"]["rows"], **made["signals"]["meta"]}


def research(ws: Workspace, settings: walk_forward.Settings, signal: signals.Settings, benchmark: str, trials: int = 500, overlap: float = 1.0) -> dict:
    """Walk-forward folds over the whole store with baselines, and the gates over their returns."""
    members = ws.members().where("active").select("date", "symbol", F.lit(True).alias("active"))
    rows = scored(factors(ws.bars.read())).join(members, ["date", "symbol"], "left").join(F.broadcast(ws.sectors().select("symbol", "sector")), "symbol", "left")
    active = F.coalesce("active", F.lit(False))
    good = active & (F.coalesce("adv20", F.lit(0.0)) >= signal.min_adv) & F.col("score").isNotNull()
    names = ("date", "symbol", "open", "adv20", "vol_21d", "mom_252d")
    rows = stored(rows.select(*names, active.alias("active"), F.coalesce("sector", F.lit("Unknown")).alias("sector"), rounded(F.col("score"), 9).alias("score"), good.alias("eligible")), "scored")
    weights = portfolio.desired_weights(rows.where("eligible").select("date", "symbol", "score", "sector"), signal.top_k, signal.max_weight, signal.max_sector_weight)
    days = ws.bars.dates().select("date", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("idx"))
    base = walk_forward.baselines(rows, days, signal.top_k, benchmark).withColumnRenamed("date", "as_of_date")
    replayed = walk_forward.walk_forward(rows, weights, days, settings, lambda w: stored(w, "weights"))
    walked = stored(replayed.join(base, "as_of_date", "left"), "walk")
    share = walk_forward.greatest_share(walked)
    summary = walk_forward.summarised(walked.drop("held"))
    gates = stored(metrics.gates(walked.drop("held"), trials, overlap, share, ["fold_id", "as_of_date"]), "gates")
    outputs.walk(ws.out("walk"), walked.drop("held"), walk_forward.fold_table(days, settings), summary)
    return {"days": walked.count(), "passed": outputs.research(ws.out("research"), gates, summary)["gates"]["meta"]["passed"]}


def trade_once(ws: Workspace, as_of: str, positions: DataFrame, equity: float, buying_power: float, min_trade: float = 25.0, session: Session = sessions.is_session, **limits) -> dict:
    """Intents from the latest signals up to a day, and the checks before the trade; they are logged, none is sent.

    positions: symbol, market_value, qty, current_price. Signals weigh more than 0. A pause or lockout fails its check.
    """
    targets = stored(latest_signals(report.read(ws.spark, f"{ws.out('signals')}/signals").where(F.col("date") <= F.lit(as_of).cast("date"))), "targets")
    if targets.isEmpty():
        raise Halted("no signals")
    day = targets.agg(F.max("date")).first()[0]
    intents = stored(portfolio.order_intents(targets.select("symbol", "weight"), positions, equity, min_trade), "intents")
    universe = ws.members().where((F.col("date") == F.lit(day)) & F.col("active")).select("symbol")
    open_ = ws.spark.range(1).select(session(F.lit(as_of).cast("date"))).first()[0]
    paused = ws.flagged("pause") or ws.flagged("lockout")
    found = stored(checks.pre_trade(intents, targets.select("symbol", "weight"), None if universe.isEmpty() else universe, equity, buying_power, latest=str(day), as_of=as_of, paused=paused, trading_day=open_, **limits), "pre_trade")
    outputs.trade_log(f"{ws.out('trades')}/trade_once_{as_of}", intents, found, found.limit(0), equity, equity, as_of, paused)
    passed = checks.passes(found).first()["passed"]
    return {"as_of": as_of, "signals_of": str(day), "intents": intents.count(), "passed": passed, "failed": sorted(r["check"] for r in found.where("not passed").collect())}


def latest_signals(rows: DataFrame) -> DataFrame:
    """The latest date's rows whose weight reads as a number above 0, symbols in capitals; without dates all rows are of one."""
    weight = F.col("weight").cast("string").try_cast("double")
    rows = rows.withColumns({"symbol": F.upper("symbol"), "weight": weight})
    if "date" in rows.columns:
        rows = rows.withColumn("date", F.col("date").cast("string").try_cast("date"))
        rows = rows.join(F.broadcast(rows.agg(F.max("date").alias("date"))), "date", "left_semi")
    return rows.where("weight > 0")


def halt(ws: Workspace, level: int, reason: str) -> dict:
    """Raise a flag: level 1 pauses; 2 asks for all positions to be closed; 3 locks trading out besides."""
    names = {1: ["pause"], 2: ["close"], 3: ["close", "lockout"]}[level]
    row = ws.spark.createDataFrame([(level, reason)], "level int, reason string").withColumn("at", F.current_timestamp().cast("string"))
    for name in names:
        report.published(row, f"{ws.out('flags')}/{name}", level=level, reason=reason)
    return {"level": level, "flags": names, "reason": reason}


def release(ws: Workspace, name: str) -> None:
    """Take a flag back."""
    report.published(ws.spark.createDataFrame([], "level int, reason string, at string"), f"{ws.out('flags')}/{name}")


EQUITY = "seen long, equity double, peak_equity double, drawdown double, daily_loss double"


def monitor(ws: Workspace, equity: float, max_drawdown: float = 0.10, max_loss: float = 0.03, grace: int = 5) -> dict:
    """Add an account's equity to its log, and halt for a deep drawdown (level 2, after the grace days) or a large loss (level 1)."""
    if not equity > 0:
        raise ValueError(f"equity {equity}")
    path = f"{ws.out('equity')}"
    log = report.read(ws.spark, path) if report.manifest(path) else ws.spark.createDataFrame([], EQUITY)
    last = log.agg(F.max_by(F.struct("equity", "peak_equity", "seen"), "seen")).first()[0]
    peak, before, seen = (max(last["peak_equity"], equity), last["equity"], last["seen"] + 1) if last else (equity, equity, 1)
    drawdown, loss = (peak - equity) / peak, max((before - equity) / before, 0.0) if before > 0 else 0.0
    trigger = "drawdown" if drawdown > max_drawdown and seen > grace else "daily_loss" if loss > max_loss else None
    if trigger:
        halt(ws, 2 if trigger == "drawdown" else 1, f"{trigger}: {drawdown if trigger == 'drawdown' else loss:.4f}")
    report.published(ws.spark.createDataFrame([(seen, float(equity), float(peak), drawdown, loss)], EQUITY), path, append=True)
    return {"equity": equity, "peak_equity": peak, "drawdown": drawdown, "daily_loss": loss, "days_seen": seen, "trigger": trigger}


def daily_report(ws: Workspace, day: str | None = None) -> dict:
    """The day's checks, trades and signals as one report, clamped to the latest day with signals; what is missing is left out."""
    read = lambda path: report.read(ws.spark, path) if report.manifest(path) else None
    weights = read(f"{ws.out('signals')}/signals")
    if weights is None:
        raise Halted("no signals")
    log = None if day is None else f"{ws.out('trades')}/trade_once_{day}"
    suites = [x for x in (read(f"{ws.out('signals')}/checks"), log and read(f"{log}/checks")) if x is not None]
    intents = log and read(f"{log}/intents")
    fills = intents.select(F.lit("intended").alias("status")) if intents is not None else ws.spark.createDataFrame([], "status string")
    return outputs.daily(ws.root + "/out", suites, fills, weights, day)


def orchestrate(ws: Workspace, mode: str, day: str, steps: dict[str, Callable[[], object]], log: str, resume: str | None = None, go_on: bool = False, mining: bool = False) -> list[dict]:
    """The stages of a mode in their order: ingest, signals, then mining (if wanted) and research, or the trade, and the report.

    steps gives a function by stage. A log of a former run lets what succeeded there be skipped.
    """
    order = ["ingest", "signals", *((["factor_mining"] if mining else []) + ["research"] if mode == "research" else ["trade"]), "report"]
    if lacking := [n for n in order if n not in steps]:
        raise ValueError(f"no step for {', '.join(lacking)}")
    return chain.run(ws.spark, [(n, steps[n]) for n in order], log, resume, go_on)


def as_settings(row, base: signals.Settings | None = None) -> signals.Settings:
    """Settings of signals from a row that settings.signal_settings() made."""
    base = base or signals.Settings()
    return replace(base, top_k=row["top_k"], max_weight=row["max_weight"], max_sector_weight=row["max_sector_weight"], max_turnover=row["max_turnover"], min_adv=row["min_adv"], history_days=row["history_days"])

