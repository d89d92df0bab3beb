"""Staleness, mentions of people, and parents of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators.people import person_tiers
from caselight.plans.frames import AS_OF, STALE_DAYS
from caselight.tables import table

_STALE_SQL = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in STALE_DAYS.items()) + " ELSE 30 END"


def is_stale(day: Column, kind: Column | None = None, as_of: str = AS_OF) -> Column:
    """Whether ``day`` lies more days before ``as_of`` than its type allows (30 where no type is given); false for no date."""
    limit = F.lit(30) if kind is None else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STALE_DAYS.items() for x in kv]), kind), F.lit(30))
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd")) > limit, F.lit(False))


@query("q_stale", f"SELECT doc_id, coalesce(datediff('day', try_cast(left(doc_date, 10) AS DATE), DATE '{AS_OF}') > {_STALE_SQL}, false) AS stale, coalesce(datediff('day', try_cast(left(doc_date, 10) AS DATE), DATE '{AS_OF}') > 30, false) AS stale_any FROM documents")
def stale(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", is_stale(F.col("doc_date"), F.col("doc_type")).alias("stale"), is_stale(F.col("doc_date")).alias("stale_any"))


def _says_sql(c: str) -> str:
    return r"regexp_matches(low, '(^|[^\p{L}\p{N}_])' || regexp_escape(" + c + r") || '([^\p{L}\p{N}_]|$)')"


@query("q_person_filter", f"""WITH p AS (SELECT DISTINCT call_id, lower(trim(u.s.spk_name)) AS person FROM calls, unnest(speakers) AS u(s) WHERE trim(coalesce(u.s.spk_name, '')) <> ''),
  t AS (SELECT turn_row_id, call_id, person, CASE WHEN {_says_sql('person')} THEN 1 WHEN contains(person, ' ') AND {_says_sql("split_part(person, ' ', 1)")} THEN CASE WHEN {_says_sql("string_split(person, ' ')[-1]")} THEN 2 ELSE 3 END END AS tier FROM (SELECT turn_row_id, t.call_id, person, lower(text) AS low FROM turns t JOIN p ON p.call_id = t.call_id))
  SELECT turn_row_id, call_id, person, tier FROM (SELECT *, min(tier) OVER (PARTITION BY call_id, person) AS best FROM t WHERE tier IS NOT NULL) WHERE tier = best""")
def person_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a call that mention one of its participants, of each participant of a call only those of the best tier (``person_tiers``)."""
    p = table(spark, d, "calls").select(F.col("call_id").alias("tenant"), F.explode("speakers").alias("s")).select("tenant", F.col("s.spk_name").alias("person"))
    lines = table(spark, d, "turns").select(F.col("call_id").alias("tenant"), F.col("turn_row_id").alias("chunk_id"), F.lit("transcript").alias("kind"), "text")
    return person_tiers(lines, p, []).select(F.col("chunk_id").alias("turn_row_id"), F.col("tenant").alias("call_id"), "person", "tier")


@query("q_fetch_parents", """WITH c AS (SELECT customer_slug AS user_id, comment_row_id, 'p_' || ticket_id || '_0' AS parent_chunk_id FROM ticket_comments), p AS (SELECT customer_slug AS user_id, 'p_' || ticket_id || '_0' AS parent_chunk_id, min(ticket_row_id) AS ticket_row_id FROM tickets WHERE description IS NOT NULL GROUP BY ALL)
  SELECT p.user_id, p.parent_chunk_id, p.ticket_row_id, min(c.comment_row_id) AS first_child, count(*) AS n_children FROM c JOIN p ON p.user_id = c.user_id AND p.parent_chunk_id = c.parent_chunk_id GROUP BY ALL""")
def q_fetch_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parents (tickets) of retrieved children (comments), each once, within one tenant."""
    pid = F.concat(F.lit("p_"), "ticket_id", F.lit("_0")).alias("parent_chunk_id")
    children = table(spark, d, "ticket_comments").select(F.col("customer_slug").alias("user_id"), pid, F.col("comment_row_id").alias("child"))
    parents = table(spark, d, "tickets").filter("description IS NOT NULL").groupBy(F.col("customer_slug").alias("user_id"), pid).agg(F.min("ticket_row_id").alias("ticket_row_id"))
    return fetch_parents(children, parents, "child")


def fetch_parents(children: DataFrame, parents: DataFrame, child: str) -> DataFrame:
    """``parents`` (user_id, parent_chunk_id and others) that ``children`` name, with first_child and n_children. Children are combined by parent before the join, so a hot parent meets one row."""
    named = children.filter("nullif(parent_chunk_id, '') IS NOT NULL").groupBy("user_id", "parent_chunk_id").agg(F.min(child).alias("first_child"), F.count("*").alias("n_children"))
    return parents.join(named, ["user_id", "parent_chunk_id"])
