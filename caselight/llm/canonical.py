"""Free-entered values mapped to the entries of a canonical list.

Values are deduplicated, normalised and looked up in an inverted index of character n-grams over the surface forms of the entries; the
candidates are scored by weighted cosine, and the best is accepted above a threshold and with a margin over the best form of any other entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.operators.ranking import top_per_group
from caselight.session import cut_lineage

UNMATCHED = "UNMATCHED"

#: Least cosine of the best form, and least distance to the best form of another entry.
THRESHOLD, MARGIN = 0.47, 0.06

# Surface forms of the entries, as people type them, by group and entry.
FORMS = {
    "ticket_status": {
        "open": "open, opened, re-opened, new, todo, to do, backlog, unassigned, just received, received, not started, offen, neu, ouvert, nouveau, abierto, nuevo",
        "in_progress": "in_progress, inprogress, in prog, wip, work in progress, started, working, working on it, active, investigating, being worked on, in bearbeitung, in arbeit, en curso, en cours",
        "pending": "pending, pend, waiting, waiting for customer, waiting on customer, awaiting customer, awaiting reply, waiting on 3rd party, pending vendor, wartet auf kunde, wartend, en attente, pendiente",
        "closed": "closed, close, completed, complete, done, fixed, resolved, won't fix, wontfix, invalid, duplicate, canceled, cancelled, rejected, closed - fixed, withdrawn, finished, erledigt, geschlossen, fermé, cerrado",
        "escalated": "escalated, escalation, escalate, esc, with leadership, raised to management, escalated to mgmt, eskaliert, escalado, escaladé",
    },
    "ticket_priority": {
        "P0": "p0, p 0, sev0, sev 0, severity 0, prio 0, priority 0, 0 - critical, critical, crit, kritisch, crítico, critique, showstopper, blocker, urgent",
        "P1": "p1, p 1, sev1, sev 1, severity 1, prio 1, priority 1, 1 - high, high, hi, high priority, high prio, p1 (high), hoch, alta, haute",
        "P2": "p2, p 2, sev2, sev 2, severity 2, prio 2, priority 2, 2 - normal, normal, medium, med, media, mittel, moderate, moyenne",
        "P3": "p3, p 3, sev3, sev 3, severity 3, prio 3, priority 3, 3 - low, low, lo, low prio, low priority, minor, niedrig, baja, basse",
    },
    "commitment_status": {
        "active": "active, activ, activo, aktiv, actif, new, agreed, open, offen, pending, not started, planned, committed",
        "in_progress": "in_progress, inprogress, in prog, wip, work in progress, half done, started, working, ongoing, underway, under way, in arbeit, in bearbeitung, en curso, en cours",
        "slipped": "slipped, slip, slipping, late, missed, overdue, delayed, date missed, behind schedule, verspätet, retrasado, en retard",
        "delivered": "delivered, deliverd, done, complete, completed, closed, fixed, resolved, finished, handed over, geliefert, livré, entregado",
        "deferred": "deferred, parked, hold, on hold, postponed, put off, blocked, canceled, cancelled, won't_do, wontdo, verschoben, aplazado, reporté",
    },
}


def normalised(value: Column) -> Column:
    """Lower case without accents, marks around the value, remarks after it, or differences of separators."""
    v = F.lower(F.trim(F.regexp_replace(value, r"[\s ]+", " ")))
    v = F.translate(v, "áàâäéèêëíìîïóòôöúùûüñçß’", "aaaaeeeeiiiioooouuuuncs'")
    v = F.regexp_replace(v, r"^(?:now:|->|=>|status:|prio(?:rity)?:)\s*", "")
    v = F.regexp_replace(v, r"\s*(?:\((?:per call|see .*|as of .*|tbc)\)|- see thread|- see \w+|since [\d/.]+|as of \w+)\s*$", "")
    v = F.regexp_replace(v, r"^[^\p{L}\d]+|[^\p{L}\d]+$", "")
    return F.trim(F.regexp_replace(v, r"[^\p{L}\d'/]+", " "))


def grams(s: Column) -> Column:
    """Distinct pairs of characters that are neighbours or have one between them; ``^`` and ``$`` mark the ends. One name space for both, so two swapped letters still share most pairs."""
    marked = F.concat(F.lit("^"), s, F.lit("$"))
    near = F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2)))
    apart = F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - 2, F.lit(1))), lambda i: F.concat(F.substring(marked, i, F.lit(1)), F.substring(marked, i + 2, F.lit(1))))
    return F.when(F.length(s) > 0, F.array_distinct(F.concat(near, apart))).otherwise(F.array().cast("array<string>"))


def listed_aliases(spark: SparkSession) -> DataFrame:
    """FORMS as a table: grp, canonical, form."""
    rows = [(g, c, f.strip()) for g, by in FORMS.items() for c, forms in by.items() for f in forms.split(",")]
    return spark.createDataFrame(rows, "grp string, canonical string, form string")


def surface_forms(entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """group, canonical, form: the forms of every entry in ``entries`` (field_group, canonical, and gloss if there is one): the entry itself, the pieces of its gloss between commas and "or", and those of ``aliases`` (grp, canonical, form)."""
    kept = entries.select(F.col("field_group").alias("grp"), "canonical", (F.col("gloss") if "gloss" in entries.columns else F.lit(None)).cast("string").alias("gloss")).filter("grp IS NOT NULL AND canonical IS NOT NULL")
    own = kept.select("grp", "canonical", F.explode(F.concat(F.array("canonical"), F.split(F.coalesce("gloss", F.lit("")), r"\s*[,;]\s*|\s+or\s+"))).alias("form"))
    if aliases is not None:
        own = own.unionByName(aliases.join(kept.select("grp", "canonical").distinct(), ["grp", "canonical"]).select("grp", "canonical", "form"))
    return own.select("grp", "canonical", normalised(F.col("form")).alias("form")).filter("form <> ''").distinct()


def _weighted(forms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The inverted index of ``forms``: weights (grp, gram, weight), unseen (grp, unseen) and profiles (grp, canonical, form, terms by falling weight, norm2)."""
    form_grams = forms.select("grp", "canonical", "form", F.explode(grams(F.col("form"))).alias("gram"))
    sizes = forms.groupBy("grp").agg(F.count("*").alias("n_forms"))
    weights = form_grams.groupBy("grp", "gram").agg(F.count("*").alias("df")).join(sizes, "grp").select("grp", "gram", F.log(1 + F.col("n_forms") / F.col("df")).alias("weight"))
    weights = cut_lineage(weights)
    profiles = form_grams.join(weights, ["grp", "gram"]).groupBy("grp", "canonical", "form").agg(F.sort_array(F.collect_list(F.struct("weight", "gram")), asc=False).alias("terms"), F.sum(F.col("weight") * F.col("weight")).alias("norm2"))
    return weights, sizes.select("grp", F.log(1 + F.col("n_forms")).alias("unseen")), profiles


def map_values(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, aliases: DataFrame | None = None) -> DataFrame:
    """The canonical entry of each distinct (grp, value) of ``values``: grp, value, canonical, score; ``UNMATCHED`` if it names none.

    Null and blank values give no row; a value without letters or digits is unmatched. A tie between two entries is unmatched (no margin). ``aliases`` (grp, canonical, form) are other words for entries,
    which no spelling shows; ``listed_aliases`` has some.

    Values are deduplicated and looked up gram by gram, never compared with each other. Of a form only its rarest grams are looked up, as many as any value needs to share for a score
    that could matter (``threshold - margin``), so the grams that half of a long list has are never met; candidates are then scored by all grams. Nothing is broadcast by force.
    """
    weights, unseen, profiles = _weighted(surface_forms(entries, aliases))
    profiles = cut_lineage(profiles)
    least = max(threshold - margin, 1e-3) ** 2
    squared = lambda terms: F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"])
    rare = F.filter("terms", lambda t, i: squared(F.slice("terms", i + 1, F.size("terms"))) >= F.lit(least) * F.col("norm2") - F.lit(1e-9))
    index = profiles.select("grp", "canonical", "form", F.explode(F.transform(rare, lambda t: t["gram"])).alias("gram"))

    distinct = cut_lineage(values.select("grp", "value").filter(F.col("value").rlike(r"[^\s ]")).distinct().withColumn("plain", normalised(F.col("value"))))
    # The grams are made once per plain value and kept, not made anew for every form they are held against.
    plain = cut_lineage(distinct.select("grp", "plain").distinct().withColumn("own", grams(F.col("plain"))))
    terms = plain.select("grp", "plain", F.explode("own").alias("gram"))
    norms = terms.join(weights, ["grp", "gram"], "left").join(unseen, "grp").groupBy("grp", "plain").agg(F.sqrt(F.sum(F.pow(F.coalesce("weight", "unseen"), F.lit(2)))).alias("norm"))
    candidates = terms.join(index, ["grp", "gram"]).select("grp", "plain", "canonical", "form").distinct().join(profiles, ["grp", "canonical", "form"]).join(plain, ["grp", "plain"])
    by_form = candidates.select("grp", "plain", "canonical", (squared(F.filter("terms", lambda t: F.array_contains("own", t["gram"]))) / F.sqrt("norm2")).alias("part"))
    by_entry = by_form.groupBy("grp", "plain", "canonical").agg(F.max("part").alias("part"))
    two = top_per_group(by_entry, ["grp", "plain"], [F.desc("part"), F.desc("canonical")], 2)
    best = two.groupBy("grp", "plain").agg(F.max(F.when(F.col("rank") == 1, F.struct("part", "canonical"))).alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("part"))), F.lit(0.0)).alias("second"))
    scored = best.join(norms, ["grp", "plain"]).select("grp", "plain", F.col("top.canonical").alias("entry"), (F.col("top.part") / F.col("norm")).alias("score"), (F.col("second") / F.col("norm")).alias("second"))
    accepted = (F.col("score") >= threshold) & (F.col("score") - F.col("second") >= margin)
    return distinct.join(scored, ["grp", "plain"], "left").select("grp", "value", F.when(accepted, F.col("entry")).otherwise(UNMATCHED).alias("canonical"), F.round("score", 6).alias("score"))


def mapped_rows(rows: DataFrame, entries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``rows`` (grp, value and any keys) that are neither null nor blank nor literally an entry of their group, with ``canonical``.

    The typed value decides, so equal values map alike wherever they stand. A value that holds a third of all rows is mapped once; joining it back is
    left to the adaptive planner, which broadcasts the distinct values where they are few and splits a hot value otherwise.
    """
    literal = entries.select(F.col("field_group").alias("grp"), F.col("canonical").alias("value")).filter("grp IS NOT NULL AND value IS NOT NULL").distinct()
    cases = rows.filter(F.col("value").rlike(r"[^\s ]")).join(literal, ["grp", "value"], "left_anti")
    return cases.join(map_values(cases, entries, aliases=aliases).select("grp", "value", "canonical"), ["grp", "value"])
