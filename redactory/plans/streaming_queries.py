"""Queries that run as streams over the events table, with batch SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from redactory.functions.bank import BANK, SEVERITY_RANK
from redactory.functions.dialect import quoted
from redactory.functions.spans import sql_spans
from redactory.functions.values import SQL_VALIDATORS
from redactory.operators import detect as d
from redactory.operators import policy as p
from redactory.plans.policy_queries import DEFAULT
from redactory.sources import corpus as c
from redactory.sources.storage import scratch
from redactory.streaming import jobs

QUERIES, SQL = {}, {}
#: A message text for each event.
_TEXT = "concat('user', user_id, ' from 10.0.', user_id % 200, '.', event_id % 250, ' wrote a', event_id, '@example.org token=', md5(cast(event_id as string)))"
_DUCK_TEXT = "SELECT event_id AS doc_id, concat('user', user_id, ' from 10.0.', user_id % 200, '.', event_id % 250, ' wrote a', event_id, '@example.org token=', md5(CAST(event_id AS VARCHAR))) AS text FROM events"


def _detect(s, sf):
    """All built-in kinds over a stream of messages, with what the tenant's profile says of each span."""
    rows = jobs.dealt(jobs.source(s, sf).select("event_id", "user_id"), "event_id").select(F.col("event_id").alias("doc_id"), (F.col("user_id") % 25).alias("tenant_id"), F.expr(_TEXT).alias("text"))
    found = d.long_form(rows.select("doc_id", "tenant_id", d.builtin_spans(F.col("text")).alias("spans"))).join(c.policies(s, sf), "tenant_id", "left")
    action = p.default_action(F.coalesce("profile", F.lit("personal_protection")), F.col("severity"))
    return jobs.drain(found.select("doc_id", "tenant_id", "span_start", "span_end", "type", "severity", action.alias("action")))


QUERIES["stream_detect"] = _detect
_MESSAGES = f"SELECT e.event_id AS doc_id, e.user_id % 25 AS tenant_id, t.text FROM events e JOIN ({_DUCK_TEXT}) t ON t.doc_id = e.event_id"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, tenant_id, span_start, span_end, {quoted(x.type)} AS type, {quoted(x.severity)} AS severity FROM ({sql_spans(_MESSAGES, x.regex, x.ignore_case, 'doc_id, tenant_id, text')})" + (f" WHERE {SQL_VALIDATORS[x.validator]}" if x.validator else "") for x in BANK)
SQL["stream_detect"] = f"SELECT doc_id, tenant_id, span_start, span_end, type, severity, {DEFAULT} AS action FROM (SELECT f.*, coalesce(q.profile, 'personal_protection') AS profile FROM ({_FOUND}) f LEFT JOIN ({c.POLICIES_SQL}) q USING (tenant_id))"
QUERIES["stream_audit_counts"] = lambda s, sf: jobs.drain(jobs.audit_counts(jobs.source(s, sf))).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n")
SQL["stream_audit_counts"] = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"
QUERIES["stream_heartbeat_gap"] = lambda s, sf: jobs.drain(jobs.heartbeat_sessions(jobs.source(s, sf))).select("user_id", F.col("begun").cast("timestamp_ntz").alias("begun"), "beats")
SQL["stream_heartbeat_gap"] = """SELECT user_id, min(ts) AS begun, count(*) AS beats FROM (
    SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)) GROUP BY user_id, g
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


def _files(s, sf):
    e = jobs.source(s, sf)
    return jobs.drain(jobs.text_with_files(e.where("event_type = 'purchase'"), jobs.source(s, sf).where("event_type <> 'purchase'"), "30 minutes"))


QUERIES["stream_text_file_join"] = _files
QUERIES["stream_resend"] = lambda s, sf: jobs.drain(jobs.resend_suppressed(jobs.source(s, sf)))
QUERIES["stream_bypass_once"] = lambda s, sf: jobs.drain(jobs.one_shot(jobs.source(s, sf), "user_id", "error", "click", 6 * 3600))
QUERIES["stream_file_allow"] = lambda s, sf: jobs.drain(jobs.one_shot(jobs.source(s, sf).withColumn("file_key", F.col("user_id") * 10 + F.length("props")), "file_key", "view", "purchase", 6 * 3600))
_ONE_SHOT = """SELECT event_id, k, passed FROM (SELECT *, kind = 'use' AND g IS NOT NULL AND epoch(ts) - epoch(g) <= 21600 AND row_number() OVER (PARTITION BY k, island, kind ORDER BY ts, event_id) = 1 AS passed FROM (
    SELECT *, max(CASE WHEN kind = 'grant' THEN ts END) OVER (PARTITION BY k, island) AS g FROM (
      SELECT *, sum(CASE WHEN kind = 'grant' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ts, event_id) AS island FROM (
        SELECT event_id, ts, {key} AS k, CASE event_type WHEN '{grant}' THEN 'grant' ELSE 'use' END AS kind FROM events WHERE event_type IN ('{grant}', '{use}'))))) WHERE kind = 'use'"""
SQL["stream_bypass_once"] = _ONE_SHOT.format(key="user_id", grant="error", use="click")
SQL["stream_file_allow"] = _ONE_SHOT.format(key="user_id * 10 + length(props)", grant="view", use="purchase")


def _refresh(s, sf):
    """Events scored with the policy read anew in each batch."""
    sink = scratch(s, "refreshed")

    def handle(batch, policies, _):
        batch.withColumn("tenant_id", F.col("user_id") % 25).join(F.broadcast(policies), "tenant_id", "left").select("event_id", "tenant_id", F.coalesce("profile", F.lit("personal_protection")).alias("profile")).write.mode("append").parquet(sink)

    jobs.with_refresh(jobs.source(s, sf), lambda: c.policies(s, sf), handle)
    return s.read.schema("event_id long, tenant_id long, profile string").parquet(sink)


QUERIES["stream_policy_refresh"] = _refresh
SQL["stream_policy_refresh"] = f"SELECT event_id, user_id % 25 AS tenant_id, coalesce(profile, 'personal_protection') AS profile FROM events LEFT JOIN ({c.POLICIES_SQL}) p ON user_id % 25 = p.tenant_id"


#: When a tenant's policy, and its rules, were last fetched: at its users' last error and signup events.
SYNCED_SQL = "SELECT user_id % 25 AS tenant_id, max(CASE WHEN event_type = 'error' THEN ts END) AS policy_at, max(CASE WHEN event_type = 'signup' THEN ts END) AS rules_at FROM events WHERE event_id % 3 = 0 GROUP BY user_id % 25"
POLICY_SECONDS, RULES_SECONDS = 600, 360


def _stale(s, sf):
    """Events scored with the policy that is there; one that is too old, or was never fetched, is flagged and still used."""
    sink = scratch(s, "stale")
    age = lambda at: F.col("ts").cast("double") - F.col(at).cast("timestamp").cast("double")
    late = lambda at, most: F.coalesce(age(at) > most, F.lit(True))

    def handle(batch, policies, _):
        rows = batch.withColumn("tenant_id", F.col("user_id") % 25).join(policies, "tenant_id", "left")
        rows.select("event_id", "tenant_id", F.coalesce("profile", F.lit("personal_protection")).alias("profile"), late("policy_at", POLICY_SECONDS).alias("policy_stale"), late("rules_at", RULES_SECONDS).alias("rules_stale")).write.mode("append").parquet(sink)

    jobs.with_refresh(jobs.source(s, sf), lambda: c.policies(s, sf).join(c.relation(s, sf, SYNCED_SQL, "events"), "tenant_id", "full"), handle)
    return s.read.schema("event_id long, tenant_id long, profile string, policy_stale boolean, rules_stale boolean").parquet(sink)


QUERIES["stream_policy_stale"] = _stale
_LATE = "coalesce(epoch(ts) - epoch({at}) > {n}, true)"
SQL["stream_policy_stale"] = f"""SELECT event_id, e.user_id % 25 AS tenant_id, coalesce(profile, 'personal_protection') AS profile, {_LATE.format(at='policy_at', n=POLICY_SECONDS)} AS policy_stale, {_LATE.format(at='rules_at', n=RULES_SECONDS)} AS rules_stale
    FROM events e LEFT JOIN ({c.POLICIES_SQL}) q ON e.user_id % 25 = q.tenant_id LEFT JOIN ({SYNCED_SQL}) y ON e.user_id % 25 = y.tenant_id"""


#: Versions of a tenant's policy and of its rules as events bring them; a policy's body is its profile.
_PART = "CASE event_type WHEN 'error' THEN 'policy' WHEN 'signup' THEN 'rules' END"
_PROFILE = "CASE event_id % 4 WHEN 0 THEN 'personal_protection' WHEN 1 THEN 'business_standard' WHEN 2 THEN 'strict_compliance' ELSE 'monitor_only' END"


def _as_of(s, sf):
    """Each message's gravest span, judged by the policy that stood when it was sent; versions come as a second stream."""
    events = jobs.source(s, sf).select("event_id", "user_id", "event_type", "ts").withColumn("tenant_id", F.col("user_id") % 25)
    texts = jobs.dealt(events.where(F.expr(_PART).isNull()), "event_id").withColumn("text", F.expr(_TEXT))
    messages = texts.select("tenant_id", "ts", F.col("event_id").alias("id"), d.gravest(F.col("text")).alias("body"))
    versions = events.where(F.expr(_PART).isNotNull()).select("tenant_id", "ts", F.expr(_PART).alias("part"), F.col("event_id").alias("id"), F.expr(_PROFILE).alias("body"))
    out = jobs.drain(jobs.policy_as_of(messages, versions, {"policy": POLICY_SECONDS, "rules": RULES_SECONDS}))
    profile = F.coalesce("policy_body", F.lit("personal_protection"))
    action = F.when(F.col("body").isNull(), "allow").otherwise(p.default_action(profile, F.col("body")))
    return out.select(F.col("id").alias("event_id"), "tenant_id", F.col("body").alias("severity"), "policy_version", "policy_stale", "rules_version", "rules_stale", profile.alias("profile"), action.alias("action"))


QUERIES["stream_policy_asof"] = _as_of
_PARTS = f"SELECT user_id % 25 AS tenant_id, {_PART} AS part, ts, max(event_id) AS version FROM events WHERE {_PART} IS NOT NULL GROUP BY ALL"
_RANK = "CASE severity " + " ".join(f"WHEN {quoted(k)} THEN {n}" for k, n in SEVERITY_RANK.items()) + " END"
_NAMED = "CASE r " + " ".join(f"WHEN {n} THEN {quoted(k)}" for k, n in SEVERITY_RANK.items()) + " END"
_GRAVE = f"SELECT doc_id AS event_id, max({_RANK}) AS r FROM ({_FOUND}) GROUP BY 1"
SQL["stream_policy_asof"] = f"""WITH v AS ({_PARTS}), m AS (SELECT e.event_id, user_id % 25 AS tenant_id, ts, {_NAMED} AS severity FROM events e LEFT JOIN ({_GRAVE}) g ON e.event_id = g.event_id
      WHERE {_PART} IS NULL AND epoch_ms(ts) < (SELECT epoch_ms(max(ts)) - 3600000 FROM events)),
    x AS (SELECT m.*, a.version AS policy_version, a.ts AS policy_at, b.version AS rules_version, b.ts AS rules_at
      FROM m ASOF LEFT JOIN (SELECT * FROM v WHERE part = 'policy') a ON m.tenant_id = a.tenant_id AND m.ts >= a.ts ASOF LEFT JOIN (SELECT * FROM v WHERE part = 'rules') b ON m.tenant_id = b.tenant_id AND m.ts >= b.ts),
    y AS (SELECT *, coalesce({_PROFILE.replace('event_id', 'policy_version')}, 'personal_protection') AS by_version FROM x)
    SELECT event_id, tenant_id, severity, policy_version, {_LATE.format(at='policy_at', n=POLICY_SECONDS)} AS policy_stale, rules_version, {_LATE.format(at='rules_at', n=RULES_SECONDS)} AS rules_stale, profile,
      CASE WHEN severity IS NULL THEN 'allow' ELSE {DEFAULT} END AS action FROM (SELECT *, CASE WHEN policy_version IS NULL THEN 'personal_protection' ELSE by_version END AS profile FROM y)"""
