"""Registered queries about planning, reading and covering facts, each with its DuckDB statement: every order is an investigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocabulary import FACT_KINDS
from ..operators import fact_plan
from ..streaming.files import stored

SUBJECT_KINDS = ("work_item", "repository", "team", "pull_request", "ci_run", "organization", "deployment")
#: So few facts of an investigation are kept here that some are cut.
MOST = 9


def _kind_at(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, FACT_KINDS)), (n % len(FACT_KINDS) + 1).cast("int"))


class _Inputs:
    """Requirements, subjects, gaps and results that the orders and their lines stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str, several: bool = False, planned: bool = False) -> None:
        # several frames are asked for: what they share is made once, not once for each of them; a plan reads two of them often
        plain = lambda df, name: df
        once, often = stored if several else plain, stored if several or planned else plain
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("investigation"))
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("investigation"), F.col("l_linenumber").cast("int").alias("place"), F.col("l_partkey").alias("part"), "l_returnflag")
        # a flag counts only as R: before, at or after it is a number in the order of the flags, which is compared without a sort
        flag = F.when(F.col("l_returnflag") < "R", 0).when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") > "R", 2)
        lines = lines.withColumn("flag", flag).repartition("investigation").groupBy("investigation", "place").agg(F.min("part").alias("part"), F.min("flag").alias("flag"))
        axis = F.when(F.col("investigation") % 13 == 0, "observed").when(F.col("investigation") % 13 == 1, "valid").otherwise("current")
        asked = orders.select("investigation", F.explode(F.array(*map(F.lit, range(4)))).alias("nth"))
        groups = [asked.filter(f"nth {c} 2").withColumn("fact_kind", _kind_at(F.col("investigation") * 3 + F.col("nth") * step)) for c, step in (("<", 5), (">=", 10))]
        self.requirements = often(fact_plan.merged_requirements(*groups).select("investigation", "fact_kind", axis.alias("axis"), "nth"), "requirements")
        at = ((F.col("part") + F.col("place")) % len(SUBJECT_KINDS) + 1).cast("int")
        named = lines.groupBy("investigation", at.alias("_kind"), "part").agg(F.min("place").alias("place"), F.max("flag").alias("flag"))
        named = named.withColumn("subject_kind", F.element_at(F.array(*map(F.lit, SUBJECT_KINDS)), F.col("_kind"))).withColumn("subject_id", F.concat_ws(":", "subject_kind", F.col("part").cast("string")))
        named = often(named.select("investigation", "subject_kind", "subject_id", "place", "flag"), "named")
        self.scope = named.filter("place <= 4")
        own = named.filter("investigation % 11 = 0 AND place = 1")
        self.own = own.join(self.requirements.filter("nth = 0").select("investigation", "fact_kind"), "investigation")
        self.derived = named.filter("place > 4 AND flag = 1").join(self.requirements.filter("nth = 1").select("investigation", "fact_kind"), "investigation")
        gap = self.requirements.filter("investigation % 4 = 0 AND nth <= 1")
        self.gaps = gap.select(
            "investigation", "fact_kind", F.when(F.col("investigation") % 8 == 0, "attempted_empty").otherwise("target_kind_mismatch").alias("outcome"), F.lit("project").alias("origin_kind"),
            F.lit("project_to_repository").alias("policy"), F.lit("membership").alias("basis"), (F.col("investigation") % 8 != 0).alias("degrades"),
        )
        self.capable = fact_plan.capabilities(spark)
        self.subjects = once(fact_plan.read_subjects(self.requirements, self.own, self.scope, self.derived), "subjects")
        self.planned = fact_plan.plan(self.requirements, self.subjects, self.capable, self.gaps, SUBJECT_KINDS)
        self.reads = fact_plan.planned_reads(self.planned, self.subjects, self.capable)

    def answers(self) -> tuple[DataFrame, DataFrame]:
        """Each subject gives one to four facts; one in eleven reads gives none, one in seven fails."""
        n = F.col("investigation") + F.char_length("fact_kind")
        state = F.when(n % 11 == 0, "no_data").when(n % 11 == 1, "stale").when(n % 11 == 2, "conflicted").when(n % 11 == 3, "pruned").otherwise("available")
        ran = self.planned.filter(F.col("decision").isin("read", "narrowed")).filter(n % 7 != 0)
        results = ran.select(
            "investigation", "fact_kind", state.alias("state"), F.when(n % 5 == 0, " late ").alias("reason"), (n % 17 == 0).alias("truncated"), F.when(n % 19 == 0, n % 3).otherwise(F.lit(0)).alias("omitted"),
            F.when(n % 2 == 0, "day").otherwise("instant").alias("grain"),
        )
        given = self.reads.join(results.filter("state NOT IN ('no_data')").filter((F.col("state") != "conflicted") | (F.col("investigation") % 2 == 0)).select("investigation", "fact_kind"), ["investigation", "fact_kind"], "left_semi")
        each = given.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("investigation") % 4 + 1).cast("int"))))
        return results, each.select("investigation", "fact_kind", "subject_id", F.struct("derived", F.col("place").alias("at"), "subject_id", "_copy").alias("place"), "_copy")


def fact_plans(spark, sf_dir):
    return _Inputs(spark, sf_dir, planned=True).planned


def fact_reads(spark, sf_dir):
    got = _Inputs(spark, sf_dir)
    return fact_plan.open_reads(got.requirements, got.own, got.scope, got.derived, got.capable)


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _Inputs(spark, sf_dir, several=True)
    got.planned, got.reads = stored(got.planned, "planned"), stored(got.reads, "reads")
    results, facts = (stored(df, "answers") for df in got.answers())
    return fact_plan.coverage(got.planned, results, facts, fact_plan.kept_facts(got.planned, facts, MOST))


def fact_source_states(spark, sf_dir):
    return _covered(spark, sf_dir)


def fact_bundles(spark, sf_dir):
    return fact_plan.bundles(_covered(spark, sf_dir)).withColumn("degraded_reasons", F.array_join("degraded_reasons", "; "))


_KINDS = "[" + ", ".join(f"'{k}'" for k in FACT_KINDS) + "]"
_CAPABLE = ", ".join(f"('{k}', {list(v)})" for k, v in fact_plan.CAPABILITIES.items())
_NO_HISTORY = ", ".join(f"'{k}'" for k in fact_plan.NO_HISTORY)
_WITHOUT = ", ".join(f"'{k}'" for k in fact_plan.WITHOUT_FACTS)
_DEGRADING = ", ".join(f"'{k}'" for k in fact_plan.DEGRADING)

PLAN_SQL = f"""WITH asked AS (
  SELECT o_orderkey AS investigation, nth, CASE o_orderkey % 13 WHEN 0 THEN 'observed' WHEN 1 THEN 'valid' ELSE 'current' END AS axis,
    ({_KINDS})[((o_orderkey * 3 + nth * CASE WHEN nth < 2 THEN 5 ELSE 10 END) % {len(FACT_KINDS)} + 1)::INT] AS fact_kind FROM orders, range(4) r(nth)
), req AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY investigation, fact_kind ORDER BY nth) = 1),
lines AS (SELECT l_orderkey AS investigation, l_linenumber AS place, min(l_partkey) AS part, min(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
named AS (
  SELECT investigation, subject_kind, subject_kind || ':' || part AS subject_id, min(place) AS place, max(flag) AS flag
  FROM (SELECT *, ({list(SUBJECT_KINDS)})[((part + place) % 7 + 1)::INT] AS subject_kind FROM lines) GROUP BY 1, 2, 3
), own AS (SELECT n.*, fact_kind FROM named n JOIN req USING (investigation) WHERE investigation % 11 = 0 AND place = 1 AND nth = 0),
sub AS (
  SELECT investigation, fact_kind, subject_kind, subject_id, min((d, place)) AS first FROM (
    SELECT investigation, fact_kind, subject_kind, subject_id, place, 0 AS d FROM own
    UNION ALL SELECT investigation, fact_kind, subject_kind, subject_id, place, 0 FROM named JOIN req r USING (investigation) WHERE place <= 4 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.investigation = r.investigation AND o.fact_kind = r.fact_kind)
    UNION ALL SELECT investigation, fact_kind, subject_kind, subject_id, place, 1 FROM named JOIN req USING (investigation) WHERE place > 4 AND flag = 'R' AND nth = 1)
  GROUP BY 1, 2, 3, 4
), cap(fact_kind, supported) AS (VALUES {_CAPABLE}),
sums AS (
  SELECT investigation, fact_kind, count(*) AS asked, count(*) FILTER (list_contains(supported, subject_kind)) AS readable,
    coalesce(string_agg(DISTINCT subject_kind, ',' ORDER BY subject_kind) FILTER (NOT coalesce(list_contains(supported, subject_kind), false)), 'none') AS skipped
  FROM sub LEFT JOIN cap USING (fact_kind) GROUP BY 1, 2
), base AS (
  SELECT r.*, supported, array_to_string(supported, ',') AS caps, coalesce(asked, 0) AS n, coalesce(readable, 0) AS m, coalesce(skipped, 'none') AS skipped, r.investigation % 4 = 0 AND nth <= 1 AS has_gap, r.investigation % 8 <> 0 AS degrades,
    CASE WHEN r.investigation % 8 = 0 THEN 'attempted_empty' ELSE 'target_kind_mismatch' END AS outcome,
    CASE WHEN axis = 'observed' THEN '{fact_plan.OBSERVED_REFUSED}' WHEN axis <> 'current' AND fact_kind IN ({_NO_HISTORY}) THEN '{fact_plan.HISTORY_REFUSED}' END AS refused
  FROM req r LEFT JOIN sums USING (investigation, fact_kind) LEFT JOIN cap USING (fact_kind)
), dec AS (
  SELECT *, CASE WHEN supported IS NULL THEN 'unconfigured' WHEN n = 0 THEN 'no_subjects' WHEN m = 0 AND has_gap THEN 'gap' WHEN m = 0 THEN 'pruned' WHEN refused IS NOT NULL THEN 'refused' WHEN m < n THEN 'narrowed' ELSE 'read' END AS decision,
    'unexpanded:' || outcome || ': no resolved subject holds this capability''s facts directly and scope expansion did not reach them (origin: project; supported: ' || caps || '; policy: project_to_repository; basis: membership)' AS gap_note FROM base
), planned AS (
  SELECT investigation, fact_kind, nth, decision, n AS asked, CASE WHEN decision IN ('read', 'narrowed') THEN m ELSE 0 END AS readable,
    CASE decision WHEN 'gap' THEN gap_note WHEN 'refused' THEN refused
      WHEN 'pruned' THEN 'pruned:subject_kind_unsupported: no resolved subject has a kind this capability supports (resolved: ' || skipped || '; supported: ' || caps || ')'
      ELSE nullif(concat_ws(' ', CASE WHEN decision = 'narrowed' THEN 'narrowed:subject_kind_unsupported: ' || (n - m) || ' subject(s) were not queried because this capability does not support their kind (skipped: ' || skipped || '; supported: ' || caps || ')' END,
        CASE WHEN decision IN ('read', 'narrowed') AND has_gap AND degrades THEN gap_note END), '') END AS note,
    decision IN ('read', 'narrowed') AND has_gap AND degrades AS incomplete, CASE WHEN has_gap THEN outcome END AS gap_outcome FROM dec
), reads AS (
  SELECT investigation, fact_kind, subject_kind, subject_id, first[1] AS derived, first[2] AS place FROM sub JOIN cap USING (fact_kind) JOIN planned p USING (investigation, fact_kind)
  WHERE list_contains(supported, subject_kind) AND p.decision IN ('read', 'narrowed')
)"""
COVER_SQL = f"""{PLAN_SQL}, res AS (
  SELECT *, CASE x % 11 WHEN 0 THEN 'no_data' WHEN 1 THEN 'stale' WHEN 2 THEN 'conflicted' WHEN 3 THEN 'pruned' ELSE 'available' END AS state, CASE WHEN x % 5 = 0 THEN 'late' END AS said, x % 17 = 0 AS truncated,
    CASE WHEN x % 19 = 0 THEN x % 3 ELSE 0 END AS omitted, CASE WHEN x % 2 = 0 THEN 'day' ELSE 'instant' END AS grain
  FROM (SELECT investigation, fact_kind, investigation + length(fact_kind) AS x FROM planned WHERE decision IN ('read', 'narrowed')) WHERE x % 7 <> 0
), given AS (
  SELECT investigation, fact_kind, count(*) * (investigation % 4 + 1) AS k FROM reads JOIN res USING (investigation, fact_kind) WHERE state <> 'no_data' AND (state <> 'conflicted' OR investigation % 2 = 0) GROUP BY 1, 2
), room AS (
  SELECT p.*, coalesce(k, 0)::BIGINT AS k, least(coalesce(k, 0), greatest(0, {MOST} - coalesce(sum(k) OVER (PARTITION BY investigation ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS kept
  FROM planned p LEFT JOIN given USING (investigation, fact_kind)
), j AS (
  SELECT room.*, res.state AS rs, said, truncated, coalesce(omitted, 0) AS omitted, grain AS g, decision IN ('read', 'narrowed') AS ran,
    coalesce(truncated, false) OR incomplete OR coalesce(omitted, 0) > 0 OR kept < k AS cut FROM room LEFT JOIN res USING (investigation, fact_kind)
), s AS (
  SELECT *, CASE WHEN decision = 'unconfigured' THEN 'unconfigured' WHEN decision = 'pruned' THEN 'pruned' WHEN decision IN ('refused', 'no_subjects') THEN 'not_applicable'
      WHEN decision = 'gap' THEN CASE WHEN gap_outcome = 'attempted_empty' THEN 'no_data' ELSE 'unavailable' END
      WHEN rs IS NULL THEN 'unavailable' WHEN cut AND rs NOT IN ({_WITHOUT}) THEN 'truncated' ELSE rs END AS state,
    concat_ws(' ', note, said) AS own FROM j
), t AS (
  SELECT *, CASE WHEN decision = 'unconfigured' THEN 'canonical fact capability is not configured' WHEN NOT ran THEN note WHEN rs IS NULL THEN concat_ws(' ', note, 'canonical fact capability timed out')
      WHEN omitted > 0 THEN CASE WHEN own = '' THEN 'canonical fact rows were omitted' ELSE own END || ' (omitted ' || omitted || ')' WHEN own <> '' THEN own
      WHEN cut AND rs NOT IN ({_WITHOUT}) THEN 'canonical fact result was truncated' END AS why FROM s
), c AS (
  SELECT investigation, fact_kind, nth, 'canonical_fact:' || fact_kind AS source, state, coalesce(why, CASE WHEN state <> 'available' THEN 'canonical fact capability returned ' || state END) AS reason,
    CASE WHEN ran AND state NOT IN ({_WITHOUT}) THEN kept ELSE 0 END AS facts, state IN ({_DEGRADING}) AS degrades, CASE WHEN ran AND state NOT IN ({_WITHOUT}) AND kept > 0 THEN g END AS grain,
    CASE WHEN ran AND rs = 'pruned' THEN 'invalid_state' WHEN ran AND rs IN ({_WITHOUT}) AND k > 0 THEN 'facts_without_source' END AS fault FROM t
)"""

STATEMENTS = {
    "fact_plans": f"{PLAN_SQL} SELECT * FROM planned",
    "fact_reads": f"{PLAN_SQL} SELECT * FROM reads",
    "fact_source_states": f"{COVER_SQL} SELECT * FROM c",
    "fact_bundles": f"""{COVER_SQL} SELECT investigation, bool_or(degrades) AS partial, coalesce(string_agg(fact_kind || ': ' || reason, '; ' ORDER BY nth) FILTER (degrades), '') AS degraded_reasons, sum(facts)::BIGINT AS facts,
  CASE WHEN bool_or(grain = 'day') THEN 'day' ELSE min(grain) END AS grain, count(*) FILTER (fault IS NOT NULL) AS faults FROM c GROUP BY investigation""",
}
QUERIES = (fact_plans, fact_reads, fact_source_states, fact_bundles)
