"""Queries of policy evaluation and span scoring, with SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redactory.functions.bank import ACTION_RANK, BANK, PROFILES, SEVERITY_RANK
from redactory.operators import detect as d
from redactory.operators import policy as p
from redactory.plans.detection_queries import detector_sql
from redactory.sources import corpus as c

QUERIES, SQL = {}, {}
#: Spans of all built-in kinds, with value and tenant.
SPANS_SQL = "SELECT *, doc_id % 25 AS tenant_id FROM (" + " UNION ALL ".join(detector_sql(x, "doc_id, source, text", f"doc_id, source, span_start, span_end, value, '{x.display_name}' AS display_name") for x in BANK) + ")"


def spans(s, sf):
    """Long form of all built-in kinds over all documents, with their tenant."""
    return spans_in_text(s, sf).drop("text")


def spans_in_text(s, sf):
    """The same rows with their document's text, for what reads around a span; nothing is joined."""
    found = c.texts(s, sf).select("doc_id", "source", "text", d.builtin_spans(F.col("text")).alias("spans"))
    return d.long_form(found).withColumn("tenant_id", F.col("doc_id") % 25)


def case(column: str, mapping: dict, default: str = "NULL") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


ANY_MODE = "'enforce', 'monitor'"
RANK = case("action", ACTION_RANK)
SEV = case("severity", SEVERITY_RANK)
BACK = {v: k for k, v in ACTION_RANK.items()}
SEV_BACK = {v: k for k, v in SEVERITY_RANK.items()}
DEFAULT = "CASE " + " ".join(f"WHEN profile = '{pr}' AND severity = '{sv}' THEN '{a}'" for pr, by in PROFILES.items() for sv, a in by.items()) + " ELSE 'warn' END"


def rules_sql(modes: str = "'enforce'") -> str:
    return f"SELECT tenant_id, pattern_type AS type, arg_max(rule_id, rule_seq) AS rule_id, arg_max(action, rule_seq) AS rule_action FROM ({c.RULES_SQL}) WHERE enabled AND mode IN ({modes}) GROUP BY ALL"


def acted_sql(modes: str = "'enforce'") -> str:
    return f"""SELECT s.*, coalesce(profile, 'personal_protection') AS profile, r.rule_id,
        coalesce(rule_action, {DEFAULT.replace('profile', "coalesce(profile, 'personal_protection')")}) AS action
        FROM ({SPANS_SQL}) s LEFT JOIN ({c.POLICIES_SQL}) p ON s.tenant_id = p.tenant_id LEFT JOIN ({rules_sql(modes)}) r ON s.tenant_id = r.tenant_id AND s.type = r.type"""


def acted(s, sf, modes=("enforce",)):
    return p.span_actions(spans(s, sf), c.policies(s, sf), c.rules(s, sf), modes)


QUERIES["policy_rule_lookup"] = lambda s, sf: p.effective_rules(c.rules(s, sf))
SQL["policy_rule_lookup"] = rules_sql()
QUERIES["last_rule_wins"] = lambda s, sf: p.effective_rules(c.rules(s, sf), ("enforce", "monitor")).select("tenant_id", "type", "rule_id")
SQL["last_rule_wins"] = f"SELECT tenant_id, type, rule_id FROM ({rules_sql(ANY_MODE)})"
QUERIES["policy_default"] = lambda s, sf: spans(s, sf).join(c.policies(s, sf), "tenant_id", "left").select("doc_id", "span_start", "type", p.default_action(F.coalesce("profile", F.lit("personal_protection")), F.col("severity")).alias("default_action"))
SQL["policy_default"] = f"SELECT doc_id, span_start, type, {DEFAULT} AS default_action FROM (SELECT s.doc_id, span_start, type, severity, coalesce(p.profile, 'personal_protection') AS profile FROM ({SPANS_SQL}) s LEFT JOIN ({c.POLICIES_SQL}) p USING (tenant_id))"
QUERIES["policy_null"] = lambda s, sf: c.documents(s, sf).select("doc_id", (F.col("doc_id") % 25).alias("tenant_id")).join(c.policies(s, sf), "tenant_id", "left").select("doc_id", "tenant_id", F.coalesce("profile", F.lit("personal_protection")).alias("profile"))
SQL["policy_null"] = f"SELECT doc_id, doc_id % 25 AS tenant_id, coalesce(profile, 'personal_protection') AS profile FROM documents LEFT JOIN ({c.POLICIES_SQL}) p ON doc_id % 25 = p.tenant_id"
QUERIES["load_policy"] = lambda s, sf: c.table(s, sf, "nation").select(F.col("n_nationkey").cast("long").alias("tenant_id")).join(c.policies(s, sf), "tenant_id", "left").join(c.rules(s, sf).where("enabled").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n")), "tenant_id", "left").select("tenant_id", F.coalesce("profile", F.lit("personal_protection")).alias("profile"), F.when(F.col("profile").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).alias("rules"))
SQL["load_policy"] = f"SELECT CAST(n_nationkey AS BIGINT) AS tenant_id, coalesce(profile, 'personal_protection') AS profile, CASE WHEN profile IS NULL THEN 0 ELSE coalesce(n, 0) END AS rules FROM nation LEFT JOIN ({c.POLICIES_SQL}) p ON n_nationkey = p.tenant_id LEFT JOIN (SELECT tenant_id, count(*) AS n FROM ({c.RULES_SQL}) WHERE enabled GROUP BY 1) r ON n_nationkey = r.tenant_id"

STRICT = "SELECT doc_id, action, CASE WHEN action <> 'allow' THEN type END AS trigger_type, CASE WHEN action <> 'allow' THEN span_start END AS trigger_start, CASE WHEN action <> 'allow' THEN rule_id END AS trigger_rule FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {rank} DESC, span_start, span_end, type DESC) AS r FROM ({acted})) WHERE r = 1"
QUERIES["policy_action"] = lambda s, sf: p.strictest(acted(s, sf), "doc_id")
SQL["policy_action"] = STRICT.format(rank=RANK, acted=acted_sql())
QUERIES["policy_merge_actions"] = lambda s, sf: acted(s, sf).select("doc_id", "span_start", "type", p.merge_actions(F.col("action"), p.default_action(F.lit("business_standard"), F.col("severity"))).alias("merged"))
_BOTH = f"greatest({RANK}, {case('other', ACTION_RANK)})"
_OTHER = case("severity", PROFILES["business_standard"], "'warn'")
SQL["policy_merge_actions"] = f"SELECT doc_id, span_start, type, {case(_BOTH, BACK)} AS merged FROM (SELECT *, {_OTHER} AS other FROM ({acted_sql()}))"
QUERIES["detector_scan_action"] = lambda s, sf: spans(s, sf).withColumn("action", p.default_action(F.lit("business_standard"), F.col("severity"))).groupBy("source", "doc_id").agg(F.max(p.ranked(F.col("action"), ACTION_RANK)).alias("r")).groupBy("source", p.action_of(F.col("r")).alias("action")).agg(F.count(F.lit(1)).alias("documents"))
SQL["detector_scan_action"] = f"SELECT source, {case('r', BACK)} AS action, count(*) AS documents FROM (SELECT source, doc_id, max({case('severity', {k: ACTION_RANK[v] for k, v in PROFILES['business_standard'].items()})}) AS r FROM ({SPANS_SQL}) GROUP BY 1, 2) GROUP BY 1, 2"

HOST_SQL = "SELECT page_id, lower(split_part(url, '/', 3)) AS host, page_id % 25 AS tenant_id FROM pages"


def hosts(s, sf):
    return c.table(s, sf, "pages").select("page_id", F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), (F.col("page_id") % 25).alias("tenant_id"))


MATCH = "(destination = 'external' OR (starts_with(destination, '*.') AND (host = substr(destination, 3) OR ends_with(host, substr(destination, 2)))) OR host = destination)"
QUERIES["destination_match"] = lambda s, sf: hosts(s, sf).join(c.destinations(s, sf), "tenant_id").where(p.matches_destination(F.col("host"), F.col("destination"))).select("page_id", "host", "destination", "action")
SQL["destination_match"] = f"SELECT page_id, host, destination, action FROM ({HOST_SQL}) JOIN ({c.DESTINATIONS_SQL}) USING (tenant_id) WHERE {MATCH}"


def _escalate(s, sf):
    per_doc = p.strictest(acted(s, sf), "doc_id").select("doc_id", "action").join(c.documents(s, sf).select("doc_id"), "doc_id", "right")
    acts = per_doc.select("doc_id", (F.col("doc_id") % 25).alias("tenant_id"), F.coalesce("action", F.lit("allow")).alias("action"), F.when(F.col("action").isNull(), 0).otherwise(1).alias("n_spans"))
    return p.escalate(acts, hosts(s, sf).select(F.col("page_id").alias("doc_id"), "host"), c.destinations(s, sf))


QUERIES["destination_escalate"] = _escalate
SQL["destination_escalate"] = f"""WITH a AS ({STRICT.format(rank=RANK, acted=acted_sql())}), d AS ({c.DESTINATIONS_SQL}),
    x AS (SELECT o.doc_id, host, a.action, max(CASE WHEN host IS NOT NULL AND {MATCH} THEN {case('d.action', ACTION_RANK)} END) AS dr
          FROM documents o LEFT JOIN ({HOST_SQL}) h ON o.doc_id = h.page_id LEFT JOIN a ON a.doc_id = o.doc_id LEFT JOIN d ON d.tenant_id = o.doc_id % 25 GROUP BY ALL)
    SELECT doc_id, host, CASE WHEN action IS NULL THEN 'allow' ELSE {case(f'greatest({RANK}, coalesce(dr, 0))', BACK)} END AS action FROM x"""

QUERIES["file_action"] = lambda s, sf: spans(s, sf).groupBy("doc_id").agg(F.max(p.ranked(F.col("severity"), SEVERITY_RANK)).alias("r")).select("doc_id", p.file_action(F.col("r")).alias("action"))
SQL["file_action"] = f"SELECT doc_id, CASE WHEN max({SEV}) >= 3 THEN 'block' WHEN max({SEV}) = 2 THEN 'redact' ELSE 'allow' END AS action FROM ({SPANS_SQL}) GROUP BY 1"
QUERIES["warn_as_redact"] = lambda s, sf: p.strictest(acted(s, sf), "doc_id").select("doc_id", F.when(F.col("action") == "warn", "redact").otherwise(F.col("action")).alias("action"), (F.col("action") == "block").alias("should_block"))
SQL["warn_as_redact"] = f"SELECT doc_id, CASE WHEN action = 'warn' THEN 'redact' ELSE action END AS action, action = 'block' AS should_block FROM ({SQL['policy_action']})"
QUERIES["popup_mode"] = lambda s, sf: acted(s, sf).groupBy("source").agg(F.when(F.bool_or(F.col("action") == "block"), "block").otherwise("warn").alias("mode"))
SQL["popup_mode"] = f"SELECT source, CASE WHEN bool_or(action = 'block') THEN 'block' ELSE 'warn' END AS mode FROM ({acted_sql()}) GROUP BY 1"


def _compare(s, sf):
    out = spans(s, sf).groupBy("doc_id").agg(*(F.max(p.ranked(p.default_action(F.lit(n), F.col("severity")), ACTION_RANK)).alias(n) for n in PROFILES))
    return out.select("doc_id", *(p.action_of(F.col(n)).alias(n) for n in PROFILES))


QUERIES["policy_compare"] = _compare
SQL["policy_compare"] = "SELECT doc_id, " + ", ".join(f"{case('max(' + case('severity', {k: ACTION_RANK[v] for k, v in by.items()}) + ')', BACK)} AS {n}" for n, by in PROFILES.items()) + f" FROM ({SPANS_SQL}) GROUP BY 1"


def _shadow(s, sf):
    """Both answers from one scan: each span gets its action under either set of rules, and one grouping takes both."""
    both = acted(s, sf).withColumnRenamed("action", "now_action").drop("rule_id", "profile")
    both = p.span_actions(both, c.policies(s, sf), c.rules(s, sf), ("enforce", "monitor"))
    top = both.groupBy("doc_id").agg(*(p.action_of(F.max(p.ranked(F.col(x), ACTION_RANK))).alias(n) for n, x in (("action", "now_action"), ("would_be", "action"))))
    return top.select("doc_id", "action", "would_be", (F.col("action") != F.col("would_be")).alias("differs"))


QUERIES["monitor_shadow"] = _shadow
SQL["monitor_shadow"] = f"SELECT a.doc_id, a.action, b.action AS would_be, a.action <> b.action AS differs FROM ({SQL['policy_action']}) a JOIN ({STRICT.format(rank=RANK, acted=acted_sql(ANY_MODE))}) b USING (doc_id)"
QUERIES["monitor_exclude"] = lambda s, sf: _shadow(s, sf).where(~((F.col("action") == "allow") & (F.col("would_be") == "block"))).select("doc_id", "action")
SQL["monitor_exclude"] = f"SELECT doc_id, action FROM ({SQL['monitor_shadow']}) WHERE NOT (action = 'allow' AND would_be = 'block')"


#: Versions of a tenant's policy: one each time an error event of a user with the tenant's number comes.
VERSIONS_SQL = "SELECT user_id % 25 AS tenant_id, event_id AS version, ts AS synced_at FROM events WHERE event_type = 'error'"


def _asof(s, sf):
    e = c.table(s, sf, "events")
    versions = c.relation(s, sf, VERSIONS_SQL, "events").select("tenant_id", F.col("synced_at").alias("ts"), "version", F.lit(0).alias("side"))
    asked = e.select((F.col("user_id") % 25).alias("tenant_id"), "ts", F.col("event_id"), F.lit(1).alias("side"))
    both = versions.unionByName(asked, allowMissingColumns=True)  # one sort by tenant and time serves both sides; no pair is made
    order = Window.partitionBy("tenant_id").orderBy("ts", "side", "version").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("v", F.last(F.when(F.col("side") == 0, F.struct("version", "ts")), True).over(order)).where("side = 1")
    return seen.select("event_id", "tenant_id", F.col("v.version").alias("version"), (F.col("ts").cast("timestamp").cast("double") - F.col("v.ts").cast("timestamp").cast("double") > 600).alias("stale"))


QUERIES["asof_policy"] = _asof
SQL["asof_policy"] = f"""SELECT e.event_id, e.user_id % 25 AS tenant_id, v.version, epoch(e.ts) - epoch(v.synced_at) > 600 AS stale
    FROM events e ASOF LEFT JOIN ({VERSIONS_SQL}) v ON e.user_id % 25 = v.tenant_id AND e.ts >= v.synced_at"""
