"""Policy evaluation: rules, profile defaults, destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.bank import ACTION_RANK, PROFILES, SEVERITY_RANK


def ranked(value: Column, ranks: dict[str, int]) -> Column:
    """Ordinal of a severity or action; null if unknown."""
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(value == name, F.lit(rank)).otherwise(out)
    return out


def action_of(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, r in ACTION_RANK.items():
        out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def severity_of(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, r in SEVERITY_RANK.items():
        out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def default_action(profile: Column, severity: Column) -> Column:
    """The profile's action for a severity; an unknown pair warns."""
    out = F.lit("warn")
    for p, by in PROFILES.items():
        for s, a in by.items():
            out = F.when((profile == p) & (severity == s), F.lit(a)).otherwise(out)
    return out


def effective_rules(rules: DataFrame, modes: tuple[str, ...] = ("enforce",)) -> DataFrame:
    """Of the enabled rules of a tenant and type in these modes, the last."""
    last = Window.partitionBy("tenant_id", "pattern_type").orderBy(F.desc("rule_seq"))
    return rules.where(F.col("enabled") & F.col("mode").isin(*modes)).withColumn("_r", F.row_number().over(last)).where("_r = 1").select("tenant_id", F.col("pattern_type").alias("type"), "rule_id", F.col("action").alias("rule_action"))


def span_actions(spans: DataFrame, policies: DataFrame, rules: DataFrame, modes: tuple[str, ...] = ("enforce",)) -> DataFrame:
    """Adds profile, rule_id and action to spans of tenants: the rule's action, else the profile's default."""
    joined = spans.join(policies, "tenant_id", "left").withColumn("profile", F.coalesce("profile", F.lit("personal_protection"))).join(effective_rules(rules, modes), ["tenant_id", "type"], "left")
    return joined.withColumn("action", F.coalesce("rule_action", default_action(F.col("profile"), F.col("severity")))).drop("rule_action")


def strictest(acted: DataFrame, *keys: str) -> DataFrame:
    """Most restrictive action of each group; the first span that reaches it triggers, unless it allows."""
    order = F.struct(ranked(F.col("action"), ACTION_RANK).alias("rank"), (-F.col("span_start")).alias("a"), (-F.col("span_end")).alias("b"), F.col("type").alias("c"))
    top = acted.groupBy(*keys).agg(F.max_by(F.struct("action", "type", "span_start", "rule_id"), order).alias("t"))
    quiet = F.col("t.action") == "allow"
    return top.select(*keys, F.col("t.action").alias("action"), F.when(~quiet, F.col("t.type")).alias("trigger_type"), F.when(~quiet, F.col("t.span_start")).alias("trigger_start"), F.when(~quiet, F.col("t.rule_id")).alias("trigger_rule"))


def merge_actions(a: Column, b: Column) -> Column:
    return action_of(F.greatest(ranked(a, ACTION_RANK), ranked(b, ACTION_RANK)))


def matches_destination(host: Column, pattern: Column) -> Column:
    """external fits all; *.x fits x and what ends in .x; else the host itself."""
    tail = F.substring(pattern, 3, 1000)
    return (pattern == "external") | (F.startswith(pattern, F.lit("*.")) & ((host == tail) | F.endswith(host, F.concat(F.lit("."), tail)))) | (host == pattern)


def escalate(actions: DataFrame, hosts: DataFrame, destinations: DataFrame) -> DataFrame:
    """Raise a document's action to the strictest rule of its destination; never lower it.

    actions: doc_id, tenant_id, action, n_spans; hosts: doc_id, host. Without spans the
    answer is allow; a document without a host keeps its action, whatever the rules say.
    """
    there = actions.join(hosts, "doc_id", "left").join(destinations.select("tenant_id", "destination", F.col("action").alias("d_action")), "tenant_id", "left")
    fit = F.when(F.col("host").isNotNull() & matches_destination(F.col("host"), F.col("destination")), ranked(F.col("d_action"), ACTION_RANK))
    top = there.groupBy("doc_id", "host", "action", "n_spans").agg(F.max(fit).alias("d_rank"))
    raised = action_of(F.greatest(ranked(F.col("action"), ACTION_RANK), F.coalesce("d_rank", F.lit(0))))
    return top.select("doc_id", "host", F.when(F.col("n_spans") == 0, F.lit("allow")).otherwise(raised).alias("action"))


def file_action(rank: Column) -> Column:
    """By the highest severity in a file; never warns."""
    return F.when(rank >= SEVERITY_RANK["high"], "block").when(rank == SEVERITY_RANK["medium"], "redact").otherwise("allow")
