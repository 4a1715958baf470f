"""Settings kept as JSON texts in a table, read as variants: sections, fallbacks and defaults are expressions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The settings of signals as (name, type, default, where they are looked for, the first that is there).
SIGNALS = [
    ("top_k", "int", 30, ("portfolio.top_k", "signals.topk")),
    ("max_weight", "double", 0.05, ("portfolio.max_weight_per_name", "signals.max_weight")),
    ("max_sector_weight", "double", 1.0, ("portfolio.max_sector_weight",)),
    ("max_turnover", "double", 0.20, ("portfolio.max_daily_turnover", "risk.max_turnover_daily")),
    ("min_adv", "double", 5e6, ("portfolio.min_avg_daily_volume_usd",)),
    ("long_only", "boolean", True, ("portfolio.long_only", "signals.long_only")),
    ("history_days", "int", 320, ("signals.history_window_days",)),
]


def parsed(text: Column) -> Column:
    """A JSON text as a variant; null where it is no JSON."""
    return F.try_parse_json(text)


def setting(doc: Column, paths: tuple[str, ...], kind: str, default=None) -> Column:
    """The first of several paths (a.b.c) of a variant that holds a value of the type, else the default."""
    found = [F.try_variant_get(doc, f"$.{p}", kind) for p in paths]
    return F.coalesce(*found, F.lit(default).cast(kind))


def signal_settings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, valid (whether the text is a JSON object) and each of the settings in SIGNALS."""
    doc = parsed(F.col(text))
    rows = docs.select(key, doc.alias("barloom_doc"))
    valid = F.coalesce(F.schema_of_variant("barloom_doc").startswith("OBJECT"), F.lit(False))
    return rows.select(key, valid.alias("valid"), *(setting(F.col("barloom_doc"), paths, kind, default).alias(name) for name, kind, default, paths in SIGNALS))


def chosen_source(asked: Column, warehouse: Column, vendor: Column) -> Column:
    """struct<first, then, error>: which source is asked first and which next, by what is configured; "auto" prefers the warehouse."""
    asked = F.lower(F.trim(F.coalesce(asked, F.lit("auto"))))
    of = lambda first=None, then=None, error=None: F.struct(*(F.lit(x).alias(n) if x is None or isinstance(x, str) else x.alias(n) for n, x in (("first", first), ("then", then), ("error", error))))
    kind = "struct<first: string, then: string, error: string>"
    next_ = F.when(vendor, "eodhd")
    return (
        F.when((asked == "crsp") & ~warehouse, of(error="the warehouse is not configured").cast(kind)).when((asked == "eodhd") & ~vendor, of(error="the vendor is not configured").cast(kind))
        .when(asked == "eodhd", of("eodhd").cast(kind)).when(warehouse, of("crsp", next_).cast(kind)).when(vendor, of("eodhd").cast(kind)).otherwise(of(error="no source is configured").cast(kind))
    )
