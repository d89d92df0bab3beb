"""Account health and its parts, the people and briefs of an account, evaluation and cost aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators import text as X
from caselight.operators.ranking import cumulated, first_of, nearest_ranks, numbered_in_blocks, top_per_group
from caselight.plans.claims import _HEALTH, corpus_overall, corpus_states
from caselight.plans.frames import AS_OF, COMMITMENTS, LOGS, TICKETS, commitments, logs, tickets
from caselight.tables import table

# --- health -----------------------------------------------------------------------------------------------------------

# Priorities that count as the first and the second, and what each sign takes off a score of 100.
FIRST, SECOND = ("p0", "critical", "urgent", "blocker"), ("p1", "high")
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)

_BAND = "CASE WHEN {0} >= 75 THEN 'Healthy' WHEN {0} >= 45 THEN 'At Risk' ELSE 'Critical' END"
_METRICS = f"""t AS (SELECT user_id, count(*) FILTER (WHERE is_open AND priority IN ({_LIST(FIRST)})) AS p0, count(*) FILTER (WHERE is_open AND priority IN ({_LIST(SECOND)})) AS p1 FROM tkt GROUP BY user_id),
  c AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE is_open) AS n_open, count(*) FILTER (WHERE slipped) AS slipped, count(*) FILTER (WHERE overdue) AS overdue FROM com GROUP BY user_id),
  m AS (SELECT a.customer_slug AS user_id, a.last_call_date, coalesce(p0, 0) AS p0, coalesce(p1, 0) AS p1, coalesce(overdue, 0) AS overdue, coalesce(n_open, 0) AS n_open, coalesce(slipped, 0) AS slipped, coalesce(n, 0) AS n, coalesce(slipped / n, 0.0) AS rate FROM accounts a LEFT JOIN t ON t.user_id = a.customer_slug LEFT JOIN c ON c.user_id = a.customer_slug),
  s AS (SELECT *, greatest(0, 100 - 25 * p0 - 8 * p1 - 12 * overdue - CAST(round_even(rate * 20, 0) AS BIGINT)) AS score FROM m),
  h AS (SELECT *, datediff('day', try_cast(last_call_date AS DATE), DATE '{AS_OF}') AS days FROM s),
  q AS (SELECT *, CASE WHEN days > 14 THEN greatest(0, score - least(20, (days - 14) * 2)) ELSE score END AS contact_score FROM h)"""


def band(score: Column) -> Column:
    return F.when(score >= 75, "Healthy").when(score >= 45, "At Risk").otherwise("Critical")


def health(spark: SparkSession, d: str) -> DataFrame:
    """A row per account: p0, p1, overdue, n_open, slipped, n, rate, score, days (since the last call), contact_score (less two points a day beyond fourteen without a call, twenty at most). Three aggregates of one row per account, joined."""
    t = tickets(spark, d).filter("is_open").groupBy("user_id").agg(F.count_if(F.col("priority").isin(*FIRST)).alias("p0"), F.count_if(F.col("priority").isin(*SECOND)).alias("p1"))
    c = commitments(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("is_open").alias("n_open"), F.count_if("slipped").alias("slipped"), F.count_if("overdue").alias("overdue"))
    a = table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"), "last_call_date")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    m = a.join(t, "user_id", "left").join(c, "user_id", "left").select("user_id", "last_call_date", *map(zero, ("p0", "p1", "overdue", "n_open", "slipped", "n")), F.coalesce(F.col("slipped") / F.col("n"), F.lit(0.0)).alias("rate"))
    score = F.greatest(F.lit(0), 100 - 25 * F.col("p0") - 8 * F.col("p1") - 12 * F.col("overdue") - F.bround(F.col("rate") * 20).cast("long"))
    m = m.withColumn("score", score).withColumn("days", F.datediff(F.lit(AS_OF).cast("date"), F.try_to_date("last_call_date", "yyyy-MM-dd")))
    return m.withColumn("contact_score", F.when(F.col("days") > 14, F.greatest(F.lit(0), F.col("score") - F.least(F.lit(20), (F.col("days") - 14) * 2))).otherwise(F.col("score")))


@query("q_health_metrics", f"WITH {TICKETS}, {COMMITMENTS}, {_METRICS} SELECT user_id, p0, p1, overdue, n_open, slipped, n, round_even(rate, 2) AS slip_rate, score, {_BAND.format('score')} AS band FROM s")
def health_metrics(spark: SparkSession, d: str) -> DataFrame:
    return health(spark, d).select("user_id", "p0", "p1", "overdue", "n_open", "slipped", "n", F.bround("rate", 2).alias("slip_rate"), "score", band(F.col("score")).alias("band"))


@query("q_health_score", f"WITH {TICKETS}, {COMMITMENTS}, {_METRICS} SELECT user_id, CAST(days AS INTEGER) AS days, contact_score AS score, {_BAND.format('contact_score')} AS band FROM q")
def health_score(spark: SparkSession, d: str) -> DataFrame:
    return health(spark, d).select("user_id", "days", F.col("contact_score").alias("score"), band(F.col("contact_score")).alias("band"))


@query("q_account_health", f"WITH {TICKETS}, {COMMITMENTS}, {_METRICS}, {_HEALTH} SELECT q.user_id, contact_score AS score, {_BAND.format('contact_score')} AS band, oh.overall, oh.missing FROM q JOIN oh ON oh.customer_slug = q.user_id")
def account_health(spark: SparkSession, d: str) -> DataFrame:
    o = corpus_overall(corpus_states(spark, d)).withColumnRenamed("customer_slug", "user_id")
    return health(spark, d).join(o, "user_id").select("user_id", F.col("contact_score").alias("score"), band(F.col("contact_score")).alias("band"), "overall", "missing")


@query("q_health_kpis", f"WITH {TICKETS}, {COMMITMENTS}, {_METRICS} SELECT user_id, CAST(trunc(round_even(rate, 2) * 100) AS INTEGER) AS slip_pct, n_open || ' open of ' || n || ' total' AS open_of_total, CASE WHEN days > 14 THEN 'approaching 30' ELSE '' END AS contact FROM q")
def health_kpis(spark: SparkSession, d: str) -> DataFrame:
    return health(spark, d).select("user_id", (F.bround("rate", 2) * 100).cast("int").alias("slip_pct"), F.concat_ws("", "n_open", F.lit(" open of "), "n", F.lit(" total")).alias("open_of_total"), F.when(F.col("days") > 14, "approaching 30").otherwise("").alias("contact"))


_UI = "CASE WHEN upper(priority) IN ('P0', 'CRITICAL', 'BLOCKER') THEN 0 WHEN upper(priority) = 'P1' THEN 1 WHEN upper(priority) = 'P2' THEN 2 ELSE 3 END"


def ui_priority(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.isin("P0", "CRITICAL", "BLOCKER"), 0).when(u == "P1", 1).when(u == "P2", 2).otherwise(3)


@query("q_ui_priority", f"WITH {TICKETS} SELECT user_id, ticket_id, {_UI} AS place, row_number() OVER (PARTITION BY user_id ORDER BY {_UI}, ticket_row_id) AS rank FROM tkt WHERE is_open")
def q_ui_priority(spark: SparkSession, d: str) -> DataFrame:
    """All open items of an account in the order of the page, numbered in blocks, so that a hot account is spread over tasks."""
    t = tickets(spark, d).filter("is_open").withColumn("place", ui_priority(F.col("priority"))).withColumn("_part", F.floor(F.col("ticket_row_id") / 5000))
    return numbered_in_blocks(t, "user_id", ["place", "_part"], ["ticket_row_id"], "rank").select("user_id", "ticket_id", "place", "rank")


@query("q_snapshot", f"""WITH {TICKETS}, {COMMITMENTS}, o AS (SELECT user_id, count(*) AS overdue FROM com WHERE overdue GROUP BY 1), p AS (SELECT user_id, count(*) FILTER (WHERE upper(priority) IN ('P0', 'CRITICAL', 'BLOCKER')) AS p0, arg_min(subject, ticket_row_id) FILTER (WHERE subject IS NOT NULL) AS lead FROM tkt WHERE is_open GROUP BY 1)
  SELECT a.customer_slug AS user_id, coalesce(overdue, 0) AS overdue, coalesce(p0, 0) AS p0, coalesce(CASE WHEN length(lead) > 72 THEN left(lead, 72) || '…' ELSE lead END, '') AS lead FROM accounts a LEFT JOIN o ON o.user_id = a.customer_slug LEFT JOIN p ON p.user_id = a.customer_slug""")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The bar above a brief: overdue commitments, open items of the first priority, and the first directive (here the first open item), cut to 72 characters."""
    o = commitments(spark, d).filter("overdue").groupBy("user_id").agg(F.count("*").alias("overdue"))
    p = tickets(spark, d).filter("is_open").groupBy("user_id").agg(F.count_if(ui_priority(F.col("priority")) == 0).alias("p0"), F.min_by("subject", F.when(F.col("subject").isNotNull(), F.col("ticket_row_id"))).alias("lead"))
    a = table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    cut = F.when(F.length("lead") > 72, F.concat(F.substring("lead", 1, 72), F.lit("…"))).otherwise(F.col("lead"))
    return a.join(o, "user_id", "left").join(p, "user_id", "left").select("user_id", zero("overdue"), zero("p0"), F.coalesce(cut, F.lit("")).alias("lead"))


# --- people, briefs, logs ---------------------------------------------------------------------------------------------

_PEOPLE = "pe AS (SELECT customer_slug, lower(trim(u.s.spk_name)) AS low, min(u.s.spk_name) AS name, count(*) AS n_calls FROM calls, unnest(speakers) AS u(s) WHERE trim(coalesce(u.s.spk_name, '')) <> '' GROUP BY ALL)"


def people(spark: SparkSession, d: str) -> DataFrame:
    """The people of an account, each name once whatever its case: customer_slug, low, name, n_calls."""
    s = table(spark, d, "calls").select("customer_slug", F.explode("speakers").alias("s")).filter("trim(coalesce(s.spk_name, '')) <> ''")
    return s.groupBy("customer_slug", F.lower(F.trim("s.spk_name")).alias("low")).agg(F.min("s.spk_name").alias("name"), F.count("*").alias("n_calls"))


@query("q_people_list", f"WITH {_PEOPLE} SELECT customer_slug, name, n_calls FROM pe ORDER BY customer_slug, name")
def people_list(spark: SparkSession, d: str) -> DataFrame:
    return people(spark, d).select("customer_slug", "name", "n_calls").orderBy("customer_slug", "name")


@query("q_person_by_id", f"WITH {_PEOPLE} SELECT a.account_id, pe.low AS person_id, pe.name FROM pe JOIN accounts a ON a.customer_slug = pe.customer_slug WHERE a.customer_slug = 'northquay'")
def person_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The people of one account, joined with it by its number; the slug is part of the key, so no other account's person can be met."""
    a = table(spark, d, "accounts").filter("customer_slug = 'northquay'").select("account_id", "customer_slug")
    return people(spark, d).join(a, "customer_slug").select("account_id", F.col("low").alias("person_id"), "name")


#: Briefs: each delivery of an account's trackers is one, logged when it was loaded.
_BRIEFS = "br AS (SELECT snapshot_row_id AS brief_id, customer_slug AS customer_id, loaded_at AS created_at, commitment_id, current_target_date AS target_date, promised_date, status FROM commitment_snapshots)"


def brief_logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commitment_snapshots").select(F.col("snapshot_row_id").alias("brief_id"), F.col("customer_slug").alias("customer_id"), F.col("loaded_at").alias("created_at"), "commitment_id", F.col("current_target_date").alias("target_date"), "promised_date", "status")


def latest_briefs(briefs: DataFrame) -> DataFrame:
    """The rows of each customer's latest time; ties keep all. The latest times are combined before they are joined back."""
    last = briefs.groupBy("customer_id").agg(F.max("created_at").alias("created_at"))
    return briefs.join(last, ["customer_id", "created_at"])


@query("q_latest_brief", f"WITH {_BRIEFS}, l AS (SELECT customer_id, max(created_at) AS at FROM br GROUP BY 1) SELECT br.brief_id, br.customer_id, a.account_name FROM br JOIN l ON l.customer_id = br.customer_id AND l.at = br.created_at JOIN accounts a ON a.customer_slug = br.customer_id")
def latest_brief(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "accounts").select(F.col("customer_slug").alias("customer_id"), "account_name")
    return latest_briefs(brief_logs(spark, d)).join(a, "customer_id").select("brief_id", "customer_id", "account_name")


@query("q_brief_history", f"WITH {_BRIEFS} SELECT customer_id, brief_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, brief_id DESC) AS rank FROM br) WHERE rank <= 20")
def brief_history(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(brief_logs(spark, d), ["customer_id"], [F.desc("created_at"), F.desc("brief_id")], 20).select("customer_id", "brief_id", "rank")


@query("q_overdue_digest", f"""WITH {_BRIEFS}, l AS (SELECT customer_id, max(created_at) AS at FROM br GROUP BY 1), b AS (SELECT br.*, a.account_name, coalesce(nullif(trim(target_date), ''), promised_date) AS due, lower(trim(coalesce(status, ''))) AS st FROM br JOIN l ON l.customer_id = br.customer_id AND l.at = br.created_at JOIN accounts a ON a.customer_slug = br.customer_id),
  u AS (SELECT 'outstanding' AS part, * FROM b WHERE st NOT IN ('delivered', 'deferred') UNION ALL SELECT 'overdue', * FROM b WHERE st NOT IN ('delivered', 'deferred') AND due < '{AS_OF}')
  SELECT part, account_name, commitment_id, due AS was_due, st AS status, '- ' || account_name || ': ' || commitment_id || ' (due ' || due || ')' AS line FROM u WHERE st NOT IN ('closed', 'resolved', 'done', 'completed') AND coalesce(due, '') <> '' AND due < '{AS_OF}'""")
def overdue_digest(spark: SparkSession, d: str) -> DataFrame:
    """What the latest brief of each account lists as overdue. An overdue item stands in both lists of a brief and comes out twice, as the reference has it; ``part`` tells which."""
    a = table(spark, d, "accounts").select(F.col("customer_slug").alias("customer_id"), "account_name")
    b = latest_briefs(brief_logs(spark, d)).join(a, "customer_id").withColumns({"due": F.coalesce(F.nullif(F.trim("target_date"), F.lit("")), "promised_date"), "st": F.lower(F.trim(F.coalesce("status", F.lit(""))))})
    b = b.filter(~F.col("st").isin("delivered", "deferred", "closed", "resolved", "done", "completed") & (F.coalesce("due", F.lit("")) != "") & (F.col("due") < AS_OF))
    b = b.withColumn("part", F.explode(F.array(F.lit("outstanding"), F.lit("overdue"))))
    return b.select("part", "account_name", "commitment_id", F.col("due").alias("was_due"), F.col("st").alias("status"), F.concat(F.lit("- "), "account_name", F.lit(": "), "commitment_id", F.lit(" (due "), "due", F.lit(")")).alias("line"))


@query("q_query_stats", f"""WITH {LOGS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, event_id DESC) AS i, row_number() OVER (PARTITION BY user_id, escalated ORDER BY created_at DESC, event_id DESC) AS j FROM logs)
  SELECT user_id, count(*) AS n, count(*) FILTER (WHERE escalated = 1) AS n_escalated, round_even(round(coalesce(avg(elapsed_ms), 0.0), 6), 2) AS mean_value, string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY i) FILTER (WHERE i <= 10) AS latest, coalesce(string_agg(CAST(event_id AS VARCHAR), ';' ORDER BY j) FILTER (WHERE j <= 10 AND escalated = 1), '') AS latest_escalated FROM r GROUP BY user_id""")
def query_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and mean of a user's questions, with the last ten and the last ten that were escalated."""
    e = logs(spark, d)
    total = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("escalated") == 1).alias("n_escalated"), F.bround(F.round(F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)), 6), 2).alias("mean_value"))
    newest = lambda df, name: top_per_group(df, ["user_id"], [F.desc("created_at"), F.desc("event_id")], 10).groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ";").alias(name))
    out = total.join(newest(e, "latest"), "user_id", "left").join(newest(e.filter("escalated = 1"), "latest_escalated"), "user_id", "left")
    return out.withColumn("latest_escalated", F.coalesce("latest_escalated", F.lit("")))


@query("q_logs", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, upper(event_type) AS level FROM events WHERE user_id = 8 AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100")
def q_logs(spark: SparkSession, d: str) -> DataFrame:
    from caselight.sources.files import log_tail

    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.upper("event_type").alias("level"), F.col("ts").alias("created_at"))
    return log_tail(e, "8", "error", 100).select("event_id", "user_id", "level")


# --- timings, cost, evaluation ----------------------------------------------------------------------------------------

_RANKS = ((50, 0.5), (90, 0.9), (95, 0.95), (99, 0.99))


def _rank_sql(source: str, group: str, value: str) -> str:
    picks = ", ".join(f"max(CASE WHEN i = least(CAST(floor(n * {p}) AS BIGINT), n - 1) THEN {value} END) AS p{k}" for k, p in _RANKS)
    return f"SELECT {group}, any_value(n) AS n, {picks} FROM (SELECT {group}, {value}, row_number() OVER (PARTITION BY {group} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL) GROUP BY {group}"


@query("q_nearest_rank", _rank_sql("documents", "doc_type", "n_chars"))
def q_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by the nearest rank, which is ``int(n p)`` from 0 and at most the last."""
    return nearest_ranks(table(spark, d, "documents"), "doc_type", "n_chars", dict(_RANKS))


@query("q_node_timings", f"WITH {LOGS}, k AS ({_rank_sql('logs', 'node', 'elapsed_ms')}), m AS (SELECT node, round(avg(elapsed_ms), 4) AS mean, round(sum(elapsed_ms), 2) AS total, max(elapsed_ms) AS max FROM logs WHERE elapsed_ms IS NOT NULL GROUP BY node) SELECT k.*, m.mean, m.total, m.max FROM k JOIN m ON m.node = k.node")
def node_timings(spark: SparkSession, d: str) -> DataFrame:
    e = logs(spark, d)
    m = e.filter("elapsed_ms IS NOT NULL").groupBy("node").agg(F.round(F.avg("elapsed_ms"), 4).alias("mean"), F.round(F.sum("elapsed_ms"), 2).alias("total"), F.max("elapsed_ms").alias("max"))
    return nearest_ranks(e, "node", "elapsed_ms", dict(_RANKS)).join(m, "node")


@query("q_answer_dist", f"WITH {LOGS}, d AS (SELECT node AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM logs GROUP BY node), k AS ({_rank_sql('logs', 'node', 'elapsed_ms')}) SELECT d.status, d.n, d.share, k.p95, k.p99 FROM d LEFT JOIN k ON k.node = d.status")
def answer_dist(spark: SparkSession, d: str) -> DataFrame:
    """How often each status occurs, its share, and its slowest calls. The counts are one row per status; the total is a window over them."""
    from pyspark.sql import Window as W

    e = logs(spark, d)
    g = e.groupBy(F.col("node").alias("status")).agg(F.count("*").alias("n"))
    g = g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))), 6))
    k = nearest_ranks(e, "node", "elapsed_ms", dict(_RANKS)).select(F.col("node").alias("status"), "p95", "p99")
    return g.join(k, "status", "left")


@query("q_wall_clock", f"""WITH {LOGS}, m AS (SELECT node, avg(elapsed_ms) AS mean, sum(elapsed_ms) AS total FROM logs GROUP BY node), g AS (SELECT *, CASE node WHEN 'view' THEN 'sequential' WHEN 'click' THEN 'sequential' WHEN 'error' THEN 'post' ELSE 'parallel' END AS kind FROM m),
  w AS (SELECT coalesce(sum(mean) FILTER (WHERE kind = 'sequential'), 0) AS seq, coalesce(max(mean) FILTER (WHERE kind = 'parallel'), 0) AS par, coalesce(sum(mean) FILTER (WHERE kind = 'post'), 0) AS post, sum(total) FILTER (WHERE kind = 'sequential') AS seq_total FROM g)
  SELECT g.node, g.kind, round(g.mean, 4) AS mean, round(w.seq + w.par + w.post, 4) AS wall, CASE WHEN kind = 'sequential' THEN round(g.total / greatest(w.seq_total, 1) * 100, 1) END AS share FROM g, w""")
def wall_clock(spark: SparkSession, d: str) -> DataFrame:
    """The wall time that the nodes of a workflow imply: the sum of the sequential means, the greatest of the parallel group, the sum of those behind it; with each sequential node's share. One row per node."""
    from pyspark.sql import Window as W

    m = logs(spark, d).groupBy("node").agg(F.avg("elapsed_ms").alias("mean"), F.sum("elapsed_ms").alias("total"))
    m = m.withColumn("kind", F.when(F.col("node").isin("view", "click"), "sequential").when(F.col("node") == "error", "post").otherwise("parallel"))
    all_nodes = W.partitionBy(F.lit(0))  # as many rows as nodes
    of = lambda f, c, kind: F.coalesce(f(F.when(F.col("kind") == kind, F.col(c))).over(all_nodes), F.lit(0.0))
    wall = of(F.sum, "mean", "sequential") + of(F.max, "mean", "parallel") + of(F.sum, "mean", "post")
    share = F.when(F.col("kind") == "sequential", F.round(F.col("total") / F.greatest(of(F.sum, "total", "sequential"), F.lit(1)) * 100, 1))
    return m.select("node", "kind", F.round("mean", 4).alias("mean"), F.round(wall, 4).alias("wall"), share.alias("share"))


@query("q_ir_latency", f"""WITH {LOGS}, r AS (SELECT node, elapsed_ms AS v, row_number() OVER (PARTITION BY node ORDER BY elapsed_ms) AS i, count(*) OVER (PARTITION BY node) AS n FROM logs WHERE elapsed_ms IS NOT NULL),
  p AS (SELECT node, v, i, n, (n + 1) * 0.95 AS place, least(greatest(CAST(floor((n + 1) * 0.95) AS BIGINT), 1), greatest(n - 1, 1)) AS j FROM r)
  SELECT node, median(v) AS p50, round(max(CASE WHEN i = j THEN v END) + (any_value(place) - any_value(j)) * coalesce(max(CASE WHEN i = j + 1 THEN v END) - max(CASE WHEN i = j THEN v END), 0), 6) AS p95 FROM p GROUP BY node""")
def ir_latency(spark: SparkSession, d: str) -> DataFrame:
    """Median and exclusive 95 % quantile (linear between the ranks about (n + 1) 0.95) of the time of each kind of call. Values are counted before the shuffle, and ranked by running counts in blocks."""
    up = cumulated(logs(spark, d), "node", "elapsed_ms")
    n = F.col("n")
    at = (n + 1) * 0.95
    j = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    value = lambda k: F.min(F.when(F.col("upto") >= k, F.col("elapsed_ms")))
    low, high = value(F.floor((n + 1) / 2)), value(F.floor((n + 2) / 2))
    return up.groupBy("node").agg(((low + high) / 2).alias("p50"), F.round(value(j) + (F.first(at) - F.first(j)) * F.coalesce(F.min(F.when(F.col("upto") >= j + 1, F.col("elapsed_ms"))) - value(j), F.lit(0.0)), 6).alias("p95"))


# The price in money of a million tokens read and written, the calls a day that costs are projected to.
PRICE_IN, PRICE_OUT, VOLUMES = 0.30, 2.50, (10, 100, 1000, 10000)


@query("q_token_cost", f"""WITH w AS (SELECT doc_type AS call, CAST(n_chars / 4 AS DOUBLE) AS est, CAST(len(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9]+')) AS DOUBLE) AS seen, CAST(length(coalesce(filename, '')) AS DOUBLE) AS out FROM documents),
  g AS (SELECT call, count(*) AS n, avg(seen) AS mean_in, avg(out) AS mean_out, avg(est) AS mean_est, avg(CASE WHEN seen = 0 THEN 0 ELSE abs(est - seen) / seen * 100 END) AS error, sum(seen) * {PRICE_IN} / 1e6 + sum(out) * {PRICE_OUT} / 1e6 AS cost FROM w GROUP BY call)
  SELECT call, n, round(mean_in, 4) AS mean_in, round(mean_out, 4) AS mean_out, round(mean_est, 4) AS mean_est, round(error, 4) AS error, round(cost, 6) AS cost, v.per_day, round(cost / n * v.per_day * 30, 4) AS month, round(cost / n * v.per_day * 365, 4) AS year FROM g, (VALUES {', '.join(f'({v})' for v in VOLUMES)}) v(per_day)""")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of calls by kind, with the error of an estimate (characters by four against counted words), projected to volumes. A call reads a document and writes as many tokens as its file name has characters."""
    w = table(spark, d, "documents").select(F.col("doc_type").alias("call"), (F.col("n_chars") / 4).alias("est"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z0-9]+")).cast("double").alias("seen"), F.length(F.coalesce("filename", F.lit(""))).cast("double").alias("out"))
    off = F.when(F.col("seen") == 0, 0.0).otherwise(F.abs(F.col("est") - F.col("seen")) / F.col("seen") * 100)
    g = w.groupBy("call").agg(F.count("*").alias("n"), F.avg("seen").alias("a"), F.avg("out").alias("b"), F.avg("est").alias("c"), F.avg(off).alias("e"), (F.sum("seen") * PRICE_IN / 1e6 + F.sum("out") * PRICE_OUT / 1e6).alias("cost"))
    g = g.withColumn("per_day", F.explode(F.array(*map(F.lit, VOLUMES))))
    each = F.col("cost") / F.col("n") * F.col("per_day")
    return g.select("call", "n", F.round("a", 4).alias("mean_in"), F.round("b", 4).alias("mean_out"), F.round("c", 4).alias("mean_est"), F.round("e", 4).alias("error"), F.round("cost", 6).alias("cost"), "per_day", F.round(each * 30, 4).alias("month"), F.round(each * 365, 4).alias("year"))


_SHARED = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"


def lexical_similarity(answer: Column, expected: Column) -> Column:
    """The share of the expected text's words that the answer has; the scorer that stands where a model's similarity would."""
    want = F.array_distinct(X.tokens(expected))
    return F.round(F.size(F.array_intersect(want, X.tokens(answer))) / F.greatest(F.size(want), F.lit(1)), 6)


def coverage_share(answer: Column, facts: Column) -> Column:
    """The share of ``facts`` (an array) in the answer, blank ones counted as missed; 0 for none."""
    low = F.regexp_replace(F.lower(F.trim(F.coalesce(answer, F.lit("")))), r"\s+", " ")
    hits = F.size(F.filter(facts, lambda f: (F.trim(f) != "") & F.contains(low, F.lower(F.trim(f)))))
    return F.round(hits / F.greatest(F.size(facts), F.lit(1)), 6)


_EVAL = f"""ev AS (SELECT item_id, round(len(list_intersect({_SHARED.format('reference_answer')}, {_SHARED.format('question')})) / greatest(len({_SHARED.format('reference_answer')}), 1), 6) AS sim, (SELECT round(CAST(len(list_filter(string_split(key_facts, ';'), lambda f: trim(f) <> '' AND contains(lower(question || ' ' || reference_answer), lower(trim(f))))) AS DOUBLE) / greatest(len(string_split(key_facts, ';')), 1), 6)) AS cov FROM eval_items)"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    return e.select("item_id", lexical_similarity(F.col("question"), F.col("reference_answer")).alias("sim"), coverage_share(F.concat_ws(" ", "question", "reference_answer"), F.split("key_facts", ";")).alias("cov"))


@query("q_coverage", f"WITH {_EVAL} SELECT item_id, cov AS coverage FROM ev")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d).select("item_id", F.col("cov").alias("coverage"))


@query("q_pass_rate", f"WITH {_EVAL} SELECT count(*) AS n, round(avg(sim), 3) AS mean_sim, round(avg(cov), 3) AS mean_cov, round(avg(CAST(sim >= 0.3 AND cov >= 0.6 AS DOUBLE)), 3) AS pass_rate FROM ev")
def pass_rate(spark: SparkSession, d: str) -> DataFrame:
    """The share of answers that are similar and cover the facts. The bound of similarity is a parameter (0.7 for a model's); 0.3 suits the lexical scorer."""
    e = _evaluated(spark, d)
    ok = ((F.col("sim") >= 0.3) & (F.col("cov") >= 0.6)).cast("double")
    return e.agg(F.count("*").alias("n"), F.round(F.avg("sim"), 3).alias("mean_sim"), F.round(F.avg("cov"), 3).alias("mean_cov"), F.round(F.avg(ok), 3).alias("pass_rate"))


def section_state(sim: Column, cov: Column, empty: Column, judge: Column) -> Column:
    """PASS and FAIL where similarity and coverage tell; between, the judge's (null without one); EMPTY for no text."""
    return F.when(empty, "EMPTY").when((sim >= 0.5) & (cov >= 0.5), "PASS").when(sim < 0.35, "FAIL").when(judge.isNull(), "FAIL_NO_JUDGE").when(judge >= 0.6, "PASS_JUDGE").otherwise("FAIL_JUDGE")


_SECTION = f"""se AS (SELECT comment_row_id, trim(coalesce(c.body, '')) = '' AS empty, round(len(list_intersect({_SHARED.format('t.subject')}, {_SHARED.format('c.body')})) / greatest(len({_SHARED.format('t.subject')}), 1), 6) AS sim, CASE WHEN contains(lower(coalesce(c.body, '')), lower(split_part(trim(coalesce(t.subject, '')), ' ', 1))) THEN 1.0 ELSE 0.0 END AS cov, CASE WHEN c.author IS NOT NULL THEN round(least(length(c.author), 20) / 20.0, 6) END AS judge
  FROM ticket_comments c JOIN (SELECT ticket_id, arg_min(subject, ticket_row_id) AS subject FROM tickets GROUP BY 1) t ON t.ticket_id = c.ticket_id)"""


@query("q_section_pass", f"WITH {_SECTION} SELECT CASE WHEN empty THEN 'EMPTY' WHEN sim >= 0.5 AND cov >= 0.5 THEN 'PASS' WHEN sim < 0.35 THEN 'FAIL' WHEN judge IS NULL THEN 'FAIL_NO_JUDGE' WHEN judge >= 0.6 THEN 'PASS_JUDGE' ELSE 'FAIL_JUDGE' END AS state, count(*) AS n FROM se GROUP BY 1")
def section_pass(spark: SparkSession, d: str) -> DataFrame:
    """Comments as sections, held against their ticket's subject; the judge is a stand-in."""
    t = first_of(table(spark, d, "tickets").select("ticket_id", "ticket_row_id", "subject"), ["ticket_id"], ["ticket_row_id"]).select("ticket_id", "subject")
    s = table(spark, d, "ticket_comments").select("ticket_id", "body", "author").join(t, "ticket_id")
    first = F.lower(F.split(F.trim(F.coalesce("subject", F.lit(""))), " ")[0])
    sim = lexical_similarity(F.col("body"), F.col("subject"))
    cov = F.when(F.contains(F.lower(F.coalesce("body", F.lit(""))), first), 1.0).otherwise(0.0)
    judge = F.when(F.col("author").isNotNull(), F.round(F.least(F.length("author"), F.lit(20)) / 20.0, 6))
    state = section_state(sim, cov, F.trim(F.coalesce("body", F.lit(""))) == "", judge)
    return s.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
