"""Filters, projections, joins, aggregates, windows, limits and versions over the domain frames."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators.fields import TICKET_DATES, normal_date
from caselight.operators.ranking import diversity_cap, first_of, latest_flags, numbered_in_blocks, recency_boost, top_per_group
from caselight.operators.text import base_name
from caselight.plans.frames import AS_OF, CHUNKS, COMMITMENTS, DOC_TYPES, LOGS, TICKETS, chunks, commitments, logs, quoted, tickets
from caselight.session import shared_folder
from caselight.tables import table


@query("q_latest_by_doctype", f"WITH {CHUNKS} SELECT user_id, doc_type, file_id FROM chunks WHERE is_latest_version = 1")
def latest_by_doctype(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).filter("is_latest_version = 1").select("user_id", "doc_type", "file_id")


@query("q_chunks_since", f"WITH {CHUNKS} SELECT user_id, file_id FROM chunks WHERE is_latest_version = 1 AND doc_type <> 'ticket' AND coalesce(nullif(doc_date, ''), '1970-01-01') >= '2025-01-01'")
def chunks_since(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).filter("is_latest_version = 1 AND doc_type <> 'ticket'")
    return c.filter(F.coalesce(F.nullif("doc_date", F.lit("")), F.lit("1970-01-01")) >= "2025-01-01").select("user_id", "file_id")


@query("q_recent_completed", f"WITH {COMMITMENTS} SELECT user_id, commitment_id FROM com WHERE status IN ('delivered', 'closed', 'done', 'complete', 'completed', 'resolved', 'fixed') AND left(last_updated, 10) >= '2025-01-01'")
def recent_completed(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("status").isin("delivered", "closed", "done", "complete", "completed", "resolved", "fixed")
    return commitments(spark, d).filter(done & (F.substring("last_updated", 1, 10) >= "2025-01-01")).select("user_id", "commitment_id")


@query("q_person_relevant", f"WITH {CHUNKS}, r AS (SELECT user_id, file_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(doc_date, '') DESC, file_id) AS rank FROM chunks WHERE is_latest_version = 1 AND doc_type IN ('transcript', 'account_notes')) SELECT user_id, file_id, rank FROM r WHERE rank <= 80")
def person_relevant(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d).filter(F.col("doc_type").isin("transcript", "account_notes") & (F.col("is_latest_version") == 1)).withColumn("_date", F.coalesce("doc_date", F.lit("")))
    return top_per_group(c, ["user_id"], [F.desc("_date"), F.asc("file_id")], 80).select("user_id", "file_id", "rank")


@query("q_structured_retrieve", f"WITH {TICKETS}, r AS (SELECT user_id, ticket_id, row_number() OVER (PARTITION BY user_id ORDER BY loaded_at DESC, ticket_row_id) AS rank FROM tkt WHERE is_open AND priority = 'p1') SELECT user_id, ticket_id, rank FROM r WHERE rank <= 30")
def structured_retrieve(spark: SparkSession, d: str) -> DataFrame:
    t = tickets(spark, d).filter("is_open AND priority = 'p1'")
    return top_per_group(t, ["user_id"], [F.desc("loaded_at"), F.asc("ticket_row_id")], 30).select("user_id", "ticket_id", "rank")


@query("q_docs_exists", "SELECT a.customer_slug FROM accounts a WHERE EXISTS (SELECT 1 FROM documents x WHERE x.customer_slug = a.customer_slug)")
def docs_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accounts").join(table(spark, d, "documents"), "customer_slug", "left_semi").select("customer_slug")


@query("q_missing_doc_types", f"SELECT a.customer_slug, t.doc_type FROM accounts a, (VALUES {', '.join(f'({quoted((x,))})' for x in DOC_TYPES)}) t(doc_type) WHERE NOT EXISTS (SELECT 1 FROM documents x WHERE x.customer_slug = a.customer_slug AND x.doc_type = t.doc_type)")
def missing_doc_types(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "accounts").select("customer_slug", F.explode(F.array(*map(F.lit, DOC_TYPES))).alias("doc_type"))
    return wanted.join(table(spark, d, "documents").select("customer_slug", "doc_type").distinct(), ["customer_slug", "doc_type"], "left_anti")


@query("q_last_call", "SELECT customer_slug, max(doc_date) AS last_call_date FROM documents WHERE doc_type = 'transcript' AND coalesce(doc_date, '') <> '' GROUP BY customer_slug")
def last_call(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_type = 'transcript' AND coalesce(doc_date, '') <> ''").groupBy("customer_slug").agg(F.max("doc_date").alias("last_call_date"))


@query("q_section_sources", "SELECT customer_slug, doc_type, count(DISTINCT filename) AS n_sources, coalesce(max(doc_date), '') AS data_as_of FROM documents GROUP BY customer_slug, doc_type")
def section_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("customer_slug", "doc_type").agg(F.count_distinct("filename").alias("n_sources"), F.coalesce(F.max("doc_date"), F.lit("")).alias("data_as_of"))


@query("q_cache_stats", "SELECT user_id, count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS alive, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS expired FROM events GROUP BY user_id")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    alive = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(~alive).alias("expired"))


@query("q_recency_boost", f"""WITH {CHUNKS}, p AS (SELECT user_id, file_id, row_number() OVER (PARTITION BY user_id ORDER BY file_id DESC) - 1 AS i, coalesce(try_cast(left(doc_date, 10) AS DATE), DATE '1970-01-01') AS dt FROM chunks), q AS (SELECT * FROM p WHERE i < 20)
  SELECT user_id, file_id, round(0.4 * (count(*) OVER w - i) / count(*) OVER w + 0.6 * datediff('day', min(dt) OVER w, dt) / greatest(datediff('day', min(dt) OVER w, max(dt) OVER w), 1), 6) AS score FROM q WINDOW w AS (PARTITION BY user_id)""")
def boosted(spark: SparkSession, d: str) -> DataFrame:
    ranked = top_per_group(chunks(spark, d), ["user_id"], [F.desc("file_id")], 20).withColumn("i", F.col("rank") - 1)
    return recency_boost(ranked, "user_id", "i", "doc_date").select("user_id", "file_id", "score")


@query("q_dedupe_titles", f"WITH {TICKETS} SELECT user_id, min(ticket_row_id) AS ticket_row_id FROM tkt WHERE trim(coalesce(subject, '')) <> '' GROUP BY user_id, lower(trim(subject)) UNION ALL SELECT user_id, ticket_row_id FROM tkt WHERE trim(coalesce(subject, '')) = ''")
def dedupe_titles(spark: SparkSession, d: str) -> DataFrame:
    t = tickets(spark, d).withColumn("title", F.lower(F.trim(F.coalesce("subject", F.lit("")))))
    titled = t.filter("title <> ''").groupBy("user_id", "title").agg(F.min("ticket_row_id").alias("ticket_row_id")).select("user_id", "ticket_row_id")
    return titled.unionByName(t.filter("title = ''").select("user_id", "ticket_row_id"))


@query("q_dedupe_narrative", f"WITH {CHUNKS} SELECT user_id, filename, min(file_id) AS file_id FROM chunks GROUP BY user_id, filename")
def dedupe_narrative(spark: SparkSession, d: str) -> DataFrame:
    return first_of(chunks(spark, d).select("user_id", "filename", "file_id"), ["user_id", "filename"], ["file_id"])


@query("q_version_sql", "SELECT doc_id, CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY customer_slug, doc_type) THEN 1 ELSE 0 END AS is_latest_version, customer_slug || '::' || doc_type AS doc_version_group FROM documents")
def version_sql(spark: SparkSession, d: str) -> DataFrame:
    flagged = latest_flags(table(spark, d, "documents").select("doc_id", "customer_slug", "doc_type"), ["customer_slug", "doc_type"], "doc_id")
    return flagged.select("doc_id", "is_latest_version", F.concat_ws("::", "customer_slug", "doc_type").alias("doc_version_group"))


@query("q_version_chunks", f"WITH {CHUNKS} SELECT user_id, doc_type, count(*) FILTER (WHERE is_latest_version = 0) AS n_demoted FROM chunks GROUP BY user_id, doc_type")
def version_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("user_id", "doc_type").agg(F.count_if(F.col("is_latest_version") == 0).alias("n_demoted"))


@query("q_backfill", "SELECT doc_id, CASE WHEN coalesce(doc_type, '') NOT IN ('', 'unknown') THEN doc_type WHEN filename LIKE '%.json' THEN 'ticket' ELSE 'unknown' END AS doc_type FROM documents")
def backfill(spark: SparkSession, d: str) -> DataFrame:
    known = F.nullif(F.nullif("doc_type", F.lit("")), F.lit("unknown"))
    return table(spark, d, "documents").select("doc_id", F.coalesce(known, F.when(F.col("filename").endswith(".json"), "ticket").otherwise("unknown")).alias("doc_type"))


_PRIO = "CASE priority WHEN 'p0' THEN 0 WHEN 'p1' THEN 1 WHEN 'p2' THEN 2 ELSE 3 END"


@query("q_priority_sort", f"WITH {TICKETS}, r AS (SELECT user_id, ticket_id, {_PRIO} AS prio, row_number() OVER (PARTITION BY user_id ORDER BY {_PRIO}, ticket_row_id) AS rank FROM tkt WHERE is_open) SELECT user_id, ticket_id, prio, rank FROM r WHERE rank <= 10")
def priority_sort(spark: SparkSession, d: str) -> DataFrame:
    prio = F.when(F.col("priority") == "p0", 0).when(F.col("priority") == "p1", 1).when(F.col("priority") == "p2", 2).otherwise(3)
    return top_per_group(tickets(spark, d).filter("is_open").withColumn("prio", prio), ["user_id"], [F.asc("prio"), F.asc("ticket_row_id")], 10).select("user_id", "ticket_id", "prio", "rank")


@query("q_audit_log", f"WITH {LOGS} SELECT event_id, user_id, created_at FROM logs ORDER BY created_at DESC, event_id DESC LIMIT 100")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    return logs(spark, d).select("event_id", "user_id", "created_at").orderBy(F.desc("created_at"), F.desc("event_id")).limit(100)


@query("q_docs_list", "SELECT customer_slug, doc_id, upload_timestamp FROM documents ORDER BY customer_slug, upload_timestamp DESC, doc_id")
def docs_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("customer_slug", "doc_id", "upload_timestamp").orderBy("customer_slug", F.desc("upload_timestamp"), "doc_id")


@query("q_customers_list", "SELECT account_id, account_name, customer_slug FROM accounts ORDER BY account_name, account_id")
def customers_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accounts").select("account_id", "account_name", "customer_slug").orderBy("account_name", "account_id")


@query("q_union_briefs", f"WITH {COMMITMENTS} SELECT user_id, commitment_id, 'outstanding' AS part FROM com WHERE is_open UNION ALL SELECT user_id, commitment_id, 'overdue' AS part FROM com WHERE overdue")
def union_briefs(spark: SparkSession, d: str) -> DataFrame:
    c = commitments(spark, d)
    part = lambda cond, name: c.filter(cond).select("user_id", "commitment_id", F.lit(name).alias("part"))
    return part("is_open", "outstanding").unionAll(part("overdue", "overdue"))


@query("q_overdue_commitments", f"WITH {COMMITMENTS} SELECT user_id, commitment_id, target, coalesce(CAST(datediff('day', try_cast(target AS DATE), DATE '{AS_OF}') AS INTEGER), 0) AS days_overdue FROM com WHERE overdue")
def overdue_commitments(spark: SparkSession, d: str) -> DataFrame:
    return commitments(spark, d).filter("overdue").select("user_id", "commitment_id", "target", F.coalesce(F.datediff(F.lit(AS_OF).cast("date"), F.try_to_date("target", "yyyy-MM-dd")), F.lit(0)).alias("days_overdue"))


@query("q_outstanding_commitments", f"WITH {COMMITMENTS} SELECT user_id, commitment_id, overdue AS is_overdue FROM com WHERE is_open")
def outstanding_commitments(spark: SparkSession, d: str) -> DataFrame:
    return commitments(spark, d).filter("is_open").select("user_id", "commitment_id", F.col("overdue").alias("is_overdue"))


@query("q_tenant_rollup", "SELECT customer_slug, doc_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ROLLUP (customer_slug, doc_type)")
def tenant_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("customer_slug", "doc_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("q_orders_by_nation", "SELECT n.n_name, r.r_name, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY n.n_name, r.r_name")
def orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(places, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("n_orders").alias("n_orders"), F.round(F.sum("total"), 2).alias("total"))


@query("q_pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


_RESOLVED = ("closed", "resolved", "done", "complete", "completed", "fixed")
_DAY = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(trim(updated_at), '{p}') THEN strftime(try_strptime(trim(updated_at), '{duck}'), '%Y-%m-%d') END" for p, _, duck in TICKET_DATES) + ", CASE WHEN regexp_matches(left(trim(updated_at), 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN strftime(try_strptime(left(trim(updated_at), 10), '%Y-%m-%d'), '%Y-%m-%d') END, left(CAST(loaded_at AS VARCHAR), 10), '')"


@query("q_recent_resolved", f"SELECT ticket_row_id, ticket_id, {_DAY} AS day FROM tickets WHERE status IN ({quoted(_RESOLVED)}) AND {_DAY} >= '2025-01-01'")
def recent_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of resolved tickets (the status in this very spelling) that were updated, or, where that date can't be read, loaded since a day."""
    day = F.coalesce(normal_date(F.col("updated_at"), TICKET_DATES), F.substring(F.col("loaded_at").cast("string"), 1, 10), F.lit(""))
    return table(spark, d, "tickets").filter(F.col("status").isin(*_RESOLVED)).select("ticket_row_id", "ticket_id", day.alias("day")).filter("day >= '2025-01-01'")


_OPEN = ("open", "in_progress", "in progress", "new", "wip", "pending", "escalated", "investigating")


@query("q_open_tickets", f"WITH {TICKETS}, o AS (SELECT *, CASE WHEN status <> '' THEN is_open END AS stamped FROM tkt) SELECT user_id, count(*) AS n_open, count(*) FILTER (WHERE priority = 'p0') AS n_p0 FROM o WHERE stamped IS DISTINCT FROM false AND (coalesce(stamped, false) OR status IN ({quoted(_OPEN)})) GROUP BY user_id")
def open_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets that are open: not stamped as closed, and stamped as open or in an open status. Without status nothing is stamped, so such a ticket is neither."""
    t = tickets(spark, d).withColumn("stamped", F.when(F.col("status") != "", F.col("is_open")))
    t = t.filter(~F.col("stamped").eqNullSafe(F.lit(False)) & (F.coalesce("stamped", F.lit(False)) | F.col("status").isin(*_OPEN)))
    return t.groupBy("user_id").agg(F.count("*").alias("n_open"), F.count_if(F.col("priority") == "p0").alias("n_p0"))


@query("q_ticket_items", f"WITH {TICKETS} SELECT k.ticket_id, coalesce(nullif(trim(k.subject), ''), k.ticket_id, left(k.description, 80)) AS title, coalesce(nullif(k.status, ''), 'open') AS status, coalesce(nullif(t.updated_at, ''), left(CAST(k.loaded_at AS VARCHAR), 10), '') AS last_update, coalesce(nullif(trim(k.assignee), ''), '') AS owner, coalesce(nullif(k.priority, ''), 'normal') AS priority, coalesce(nullif(split_part(k.user_id || '/' || k.ticket_id || '.json', '/', -1), ''), '') AS source_doc FROM tkt k JOIN tickets t ON t.ticket_row_id = k.ticket_row_id")
def ticket_items(spark: SparkSession, d: str) -> DataFrame:
    """Tickets as open items, each field with its fallbacks; the source is the file a ticket came in."""
    given = lambda c, *other: F.coalesce(F.nullif(F.trim(c), F.lit("")), *other)
    raw = table(spark, d, "tickets").select("ticket_row_id", "updated_at")
    return tickets(spark, d).join(raw, "ticket_row_id").select(
        "ticket_id", given("subject", F.col("ticket_id"), F.substring("description", 1, 80)).alias("title"), given("status", F.lit("open")).alias("status"), F.coalesce(F.nullif("updated_at", F.lit("")), F.substring(F.col("loaded_at").cast("string"), 1, 10), F.lit("")).alias("last_update"),
        given("assignee", F.lit("")).alias("owner"), given("priority", F.lit("normal")).alias("priority"), base_name(F.concat("user_id", F.lit("/"), "ticket_id", F.lit(".json"))).alias("source_doc"),
    )


@query("q_diversity_cap", "SELECT customer_slug, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY customer_slug, coalesce(source, '') ORDER BY coalesce(doc_date, '') DESC, doc_id) AS nth FROM documents) WHERE nth <= 2")
def q_diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    """Each account's list of documents, the newest first, without those behind the first two of their source."""
    docs = table(spark, d, "documents").select("customer_slug", "doc_id", "source", F.coalesce("source", F.lit("")).alias("_s"), F.struct((-F.unix_date(F.coalesce(F.try_to_date("doc_date", "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")))).alias("d"), F.col("doc_id").alias("i")).alias("_o"))
    return diversity_cap(docs, ["customer_slug"], "_s", F.asc("_o"), 2).select("customer_slug", "doc_id", "source")


@query("q_dedupe_content", "SELECT customer_slug, doc_id, 'C' || row_number() OVER (PARTITION BY customer_slug ORDER BY doc_id) AS chunk_id FROM (SELECT customer_slug, min(doc_id) AS doc_id FROM documents GROUP BY customer_slug, md5(coalesce(text, '')))")
def dedupe_content(spark: SparkSession, d: str) -> DataFrame:
    """Each content of an account once, where it was first seen, numbered C1, C2, … in blocks, so that no task numbers a hot account alone."""
    once = table(spark, d, "documents").groupBy("customer_slug", F.md5(F.coalesce("text", F.lit(""))).alias("_m")).agg(F.min("doc_id").alias("doc_id")).withColumn("_b", F.floor(F.col("doc_id") / 5000))
    return numbered_in_blocks(once, "customer_slug", ["_b"], ["doc_id"], "n").select("customer_slug", "doc_id", F.concat(F.lit("C"), F.col("n").cast("string")).alias("chunk_id"))


@query("q_parent_ids", "SELECT t.ticket_row_id, 'P' || row_number() OVER (PARTITION BY t.customer_slug ORDER BY t.ticket_row_id) AS chunk_id FROM tickets t")
def parent_ids(spark: SparkSession, d: str) -> DataFrame:
    """Parents numbered P1, P2, … within their account, whatever ids they had."""
    t = table(spark, d, "tickets").select("customer_slug", "ticket_row_id").withColumn("_b", F.floor(F.col("ticket_row_id") / 5000))
    return numbered_in_blocks(t, "customer_slug", ["_b"], ["ticket_row_id"], "n").select("ticket_row_id", F.concat(F.lit("P"), F.col("n").cast("string")).alias("chunk_id"))


@query("q_version_rank", "SELECT customer_slug, doc_type, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def version_rank(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each account and type, as the first of a ranking."""
    return top_per_group(table(spark, d, "documents"), ["customer_slug", "doc_type"], [F.desc("doc_id")], 1).select("customer_slug", "doc_type", "doc_id")


@query("q_dedupe_union", "SELECT customer_slug, src, doc_id FROM (SELECT customer_slug, src, doc_id, row_number() OVER (PARTITION BY customer_slug, md5(coalesce(text, '')) ORDER BY src, doc_id) AS nth FROM (SELECT customer_slug, 0 AS src, doc_id, text FROM documents WHERE doc_type = 'account_notes' UNION ALL SELECT customer_slug, 1, doc_id, text FROM documents)) WHERE nth = 1")
def dedupe_union(spark: SparkSession, d: str) -> DataFrame:
    """Notes before everything else, each content of an account once."""
    docs = table(spark, d, "documents")
    part = lambda df, n: df.select("customer_slug", F.lit(n).alias("src"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("_m"))
    return first_of(part(docs.filter("doc_type = 'account_notes'"), 0).unionByName(part(docs, 1)), ["customer_slug", "_m"], ["src", "doc_id"]).select("customer_slug", "src", "doc_id")


def merged_maps(updates: DataFrame, key: str, name: str, value: str, order: list[str]) -> DataFrame:
    """``key``, state: the maps of a state's updates merged, of one name the last by ``order``. Reduced by name before the maps are built."""
    last = updates.groupBy(key, name).agg(F.max_by(value, F.struct(*order)).alias("_v"))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(name), F.col("_v"))))).alias("state"))


@query("q_state_reduce", f"WITH {LOGS}, l AS (SELECT user_id, node, arg_max(elapsed_ms, struct_pack(a := created_at, b := event_id)) AS v FROM logs GROUP BY ALL), c AS (SELECT user_id, count(*) AS n_trail, sum(escalated) AS loops FROM logs GROUP BY 1) SELECT c.user_id, c.n_trail, CAST(c.loops AS BIGINT) AS loops, string_agg(l.node || '=' || l.v, ';' ORDER BY l.node) AS state FROM c JOIN l ON l.user_id = c.user_id GROUP BY ALL")
def state_reduce(spark: SparkSession, d: str) -> DataFrame:
    """The three reducers of a workflow's state over a user's events: trails are concatenated, counters summed, maps merged with the later value winning."""
    e = logs(spark, d)
    m = merged_maps(e, "user_id", "node", "elapsed_ms", ["created_at", "event_id"])
    c = e.groupBy("user_id").agg(F.count("*").alias("n_trail"), F.sum("escalated").alias("loops"))
    shown = F.array_join(F.transform(F.map_entries("state"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ";")
    return c.join(m, "user_id").select("user_id", "n_trail", "loops", shown.alias("state"))


_UPLOADS = "up AS (SELECT customer_slug, doc_type, filename, max(doc_id) AS doc_id FROM documents WHERE lang = 'fr' GROUP BY ALL), st AS (SELECT * FROM documents WHERE lang IS DISTINCT FROM 'fr' OR doc_type IN ('ticket', 'account_notes'))"


@query("q_upload_dup", f"WITH {_UPLOADS} SELECT up.customer_slug, up.filename, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.customer_slug = up.customer_slug AND st.filename = up.filename) THEN 409 ELSE 200 END AS code FROM up")
def upload_dup(spark: SparkSession, d: str) -> DataFrame:
    """French documents uploaded to a store that has some of them: a known file name of the account is refused (409) unless it is to be replaced."""
    docs = table(spark, d, "documents")
    stored = docs.filter("NOT (lang <=> 'fr') OR doc_type IN ('ticket', 'account_notes')")
    uploads = docs.filter("lang = 'fr'").groupBy("customer_slug", "doc_type", "filename").agg(F.max("doc_id").alias("doc_id"))
    known = stored.select("customer_slug", "filename", F.lit(True).alias("_known")).distinct()
    return uploads.join(known, ["customer_slug", "filename"], "left").select("customer_slug", "filename", F.when(F.col("_known"), 409).otherwise(200).alias("code"))


def replaced(stored: DataFrame, uploads: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with ``uploads`` in place of the rows of the same ``key``."""
    return stored.join(uploads.select(*key).distinct(), key, "left_anti").unionByName(uploads)


@query("q_upload_replace", f"WITH {_UPLOADS} SELECT customer_slug, count(*) AS n, max(doc_id) AS newest FROM (SELECT customer_slug, doc_id FROM st WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.customer_slug = st.customer_slug AND up.filename = st.filename) UNION ALL SELECT customer_slug, doc_id FROM up) GROUP BY 1")
def upload_replace(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("customer_slug", "doc_type", "filename", "doc_id", "lang")
    stored = docs.filter("NOT (lang <=> 'fr') OR doc_type IN ('ticket', 'account_notes')").drop("lang", "doc_type")
    uploads = docs.filter("lang = 'fr'").groupBy("customer_slug", "doc_type", "filename").agg(F.max("doc_id").alias("doc_id")).drop("doc_type")
    return replaced(stored, uploads, ["customer_slug", "filename"]).groupBy("customer_slug").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"))


@query("q_mixed_flag", "SELECT customer_slug, count(DISTINCT regexp_matches(lower(filename), '\\.(pdf|docx|html)$')) > 1 AS mixed FROM documents GROUP BY customer_slug")
def mixed_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether an account's chunks were made under different flags; the flag is here whether a file is split into parents and children."""
    flag = F.lower("filename").rlike(r"\.(pdf|docx|html)$")
    return table(spark, d, "documents").groupBy("customer_slug").agg((F.count_distinct(flag) > 1).alias("mixed"))


def without_files(rows: DataFrame, deleted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` without those of the deleted files: the anti join that a rewrite of a collection is."""
    return rows.join(deleted.select(*key).distinct(), key, "left_anti")


@query("q_delete_file", f"WITH {CHUNKS}, gone AS (SELECT file_id, user_id FROM chunks WHERE is_latest_version = 0 OR doc_type = 'qbr_deck') SELECT user_id, 'child' AS collection, count(*) AS n FROM chunks WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = chunks.file_id AND g.user_id = chunks.user_id) GROUP BY 1 UNION ALL SELECT user_id, 'parent', count(*) FROM chunks WHERE doc_type <> 'ticket' AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.file_id = chunks.file_id AND g.user_id = chunks.user_id) GROUP BY 1")
def delete_file(spark: SparkSession, d: str) -> DataFrame:
    """What stays of both collections (children; parents, which tickets don't have) when old versions and decks are deleted by file and account."""
    c = chunks(spark, d).select("file_id", "user_id", "doc_type", "is_latest_version")
    gone = c.filter("is_latest_version = 0 OR doc_type = 'qbr_deck'")
    left = lambda df, name: without_files(df, gone, ["file_id", "user_id"]).groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(name).alias("collection"), "n")
    return left(c, "child").unionByName(left(c.filter("doc_type <> 'ticket'"), "parent"))


@query("q_cascade_delete", "SELECT 'accounts' AS part, count(*) AS n FROM accounts WHERE customer_slug <> 'northquay' UNION ALL SELECT 'documents', count(*) FROM documents WHERE customer_slug <> 'northquay' UNION ALL SELECT 'people', count(*) FROM calls WHERE customer_slug <> 'northquay' UNION ALL SELECT 'chunks', count(*) FROM turns WHERE customer_slug <> 'northquay'")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What stays in four tables when an account is deleted with all that hangs on it."""
    gone = table(spark, d, "accounts").filter("customer_slug = 'northquay'").select("customer_slug")
    parts = {"accounts": "accounts", "documents": "documents", "people": "calls", "chunks": "turns"}
    left = [without_files(table(spark, d, t), gone, ["customer_slug"]).agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p, t in parts.items()]
    return reduce(DataFrame.unionByName, left)


@query("q_demote", f"WITH {CHUNKS} SELECT file_id, CASE WHEN doc_type = 'ticket' THEN 0 ELSE is_latest_version END AS is_latest_version FROM chunks")
def demote(spark: SparkSession, d: str) -> DataFrame:
    """An update of metadata: the chunks of replaced files (here all tickets) lose their flag, the others keep theirs."""
    return chunks(spark, d).select("file_id", F.when(F.col("doc_type") == "ticket", 0).otherwise(F.col("is_latest_version")).alias("is_latest_version"))


@query("q_row_inserts", "SELECT brief_id, section, rating FROM (SELECT commit_row_id AS brief_id, source_section AS section, CASE WHEN is_slipped THEN -1 ELSE 1 END AS rating FROM commitments WHERE source_section IS NOT NULL)")
def row_inserts(spark: SparkSession, d: str) -> DataFrame:
    """Feedback rows written to a new table in the shared folder in two deliveries that overlap, under the rule that a rating is 1 or -1, and read back."""
    from caselight.sources.files import append_rows

    rows = table(spark, d, "commitments").filter("source_section IS NOT NULL").select(F.col("commit_row_id").alias("brief_id"), F.col("source_section").alias("section"), F.when(F.col("is_slipped"), -1).otherwise(1).alias("rating"), "customer_aware")
    path = f"{shared_folder(spark)}/feedback-{uuid.uuid4().hex}"
    rule = F.col("rating").isin(1, -1)
    for part in (rows.filter("customer_aware"), rows):
        append_rows(part.drop("customer_aware"), path, ["brief_id", "section"], rule)
    return spark.read.parquet(path)
