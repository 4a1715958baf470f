"""URL filters by association rules, with DataFrame functions only.

FP-growth mines combinations of URL tokens (host labels, path segments, query names) from labelled URLs. Rules with enough
support and confidence whose consequence is a label are kept, all of them; a URL's tokens meet them through an inverted
index from token to rule, and a rule holds if all its tokens are met. Of the rules that hold, the one of the highest
confidence decides (ties: support, then fewer tokens, then the tokens' and the verdict's text); without any, the verdict is allow.

Listed rules (host, path, verdict) come first: one fits its host and all subdomains if the path starts with its path; the
longest fits best. Null URLs and those without "://" have an empty host and path and no token. Repeated rows are kept.
Equal URLs get equal verdicts. Labels that are null on both counts are unused. With no labels
there are no mined rules. Very long URLs are read whole; tokens that only occur together among the labelled URLs are mined as
one, so that a long labelled URL costs no more than its tokens (many that share ever other parts of one long URL still make many
combinations, as the support allows). Further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored

#: The listed rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest listed rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for name, start, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A URL's distinct tokens: h:label, p:segment and q:name."""
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    parts = [("h", F.split(host, r"\.")), ("p", F.split(path, "/")), ("q", F.transform(query, lambda q: F.regexp_extract(q, "^[^=]*", 0)))]

    def marked(kind: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(f"{kind}:"), v))

    return F.when(host != "", F.array_distinct(F.concat(*(marked(*p) for p in parts)))).otherwise(F.array().cast("array<string>"))


def token_groups(labelled: DataFrame) -> DataFrame:
    """(token, group): tokens that occur in the same ones of the labelled URLs are a group, named by the least of them.

    Where a token occurs is told by two 64-bit hashes over the different sets of tokens that hold it. Without groups, one
    labelled URL of n segments that no other has would make 2**n combinations of one meaning.
    """
    held = labelled.select(F.array_sort("tokens").alias("set")).distinct().select(F.explode("set").alias("token"), F.xxhash64("set").alias("h"), F.xxhash64(F.lit("again"), "set").alias("g"))
    where = held.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    names = where.groupBy("n", "h", "g").agg(F.min("token").alias("group"))
    return where.join(names, ["n", "h", "g"]).select("token", "group")


def mined_rules(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent, verdict, rank) from rows (tokens, verdict), and the groups (token, group) that antecedents are made of.

    An antecedent holds if the URL has a token of each of its groups: that token alone has the support and confidence of
    its whole group. A rule decides nothing where a part of its antecedent has a better rule, since that one holds too.
    Parts of one group and those of one group less are looked up; a rule that only other parts outrank stays, which
    changes no verdict. The least rank is the best.
    """
    groups = stored(token_groups(labelled), "groups")
    rows = labelled.select(F.array_sort("tokens").alias("set"), "verdict")
    members = rows.select("set").distinct().select("set", F.explode("set").alias("token")).join(groups, "token")
    items = stored(members.groupBy("set").agg(F.collect_set("group").alias("groups")), "items")
    baskets = rows.join(items, "set").select(F.concat("groups", F.array(F.concat(F.lit("label:"), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    target = F.element_at("consequent", 1)
    rules = model.associationRules.where(target.startswith("label:") & ~F.exists("antecedent", lambda t: t.startswith("label:")))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support", F.regexp_replace(target, "^label:", "").alias("verdict"))
    rank = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("antecedent").alias("n"), "verdict")
    rules = stored(rules.groupBy("antecedent").agg(F.min(rank).alias("rank")).select("antecedent", "rank.verdict", "rank"), "rules")
    less = F.transform("antecedent", lambda t: F.filter("antecedent", lambda u: u != t))
    parts = F.explode(F.array_distinct(F.concat(less, F.transform("antecedent", lambda t: F.array(t)))))
    part = rules.where(F.size("antecedent") > 1).select(F.col("antecedent").alias("whole"), F.col("rank").alias("own"), parts.alias("antecedent"))
    outranked = part.join(rules.select("antecedent", "rank"), "antecedent").where("rank < own").select(F.col("whole").alias("antecedent")).distinct()
    return stored(rules.join(outranked, "antecedent", "left_anti"), "rules"), groups


def matched(urls: DataFrame, rules: DataFrame, groups: DataFrame) -> DataFrame:
    """(url, mined) by the best mined rule that holds, for distinct rows (url); URLs that meet none are left out.

    Only a URL's tokens that occur in rules count, the least of each group, and each set of such tokens is judged once. A
    token in a rule has the least support among the labelled URLs, so there are at most 1 / min_support times as many as a
    URL has on average, and they are broadcast. Rules are not: each is listed under the one of its groups that the fewest
    sets have, joined by it with the sets, and holds if the set has its other groups too.
    """
    known = groups.join(rules.select(F.explode("antecedent").alias("group")).distinct(), "group")
    split = urls.select("url", F.explode(tokens(F.col("url"), host_of(F.col("url")), path_of(F.col("url")))).alias("token"))
    least = split.join(F.broadcast(known), "token").groupBy("url", "group").agg(F.min("token").alias("token"))
    met = stored(least.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("group", "token"))).alias("met")), "met")
    sets = stored(met.select("met").distinct(), "sets")
    in_sets = sets.select("met", F.explode("met.group").alias("group"))
    counts = in_sets.groupBy("group").count()
    of_rules = rules.select("antecedent", "rank", F.explode("antecedent").alias("group")).join(F.broadcast(counts), "group")
    index = of_rules.groupBy("antecedent", "rank").agg(F.min(F.struct("count", "group")).alias("least"))
    index = stored(index.select("antecedent", "rank", "least.group"), "index")
    holding = in_sets.join(index, "group").where(F.size(F.array_except("antecedent", "met.group")) == 0)
    held = F.array_sort(F.transform(F.filter("met", lambda m: F.array_contains("antecedent", m["group"])), lambda m: m["token"]))
    rank = F.struct("rank.c", "rank.s", "rank.n", F.array_join(held, " ").alias("t"), "rank.verdict")
    best = stored(holding.groupBy("met").agg(F.min(rank).alias("rank")).select("met", F.col("rank.verdict").alias("mined")), "best")
    return met.join(best, "met").select("url", "mined")


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; labels (doc_id, quality, toxic) say which pages are bad."""
    rows = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumns({"tokens": tokens(F.col("url"), F.col("host"), F.col("path")), "listed": listed_rule(F.col("host"), F.col("path"), rules)})
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.where("toxic is not null or quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))
    labelled = rows.join(known, "page_id").select("tokens", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict")).where(F.size("tokens") > 0)
    found = matched(rows.select("url").where("url is not null").distinct(), *mined_rules(labelled, **mining))
    out = rows.join(found, "url", "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.col("mined"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))
