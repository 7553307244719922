"""Which facts are read for which subjects, and what came back: plan, refusals, merge and coverage of many investigations at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_text

#: Which kinds of subjects each kind of facts can be read for.
CAPABILITIES = {
    "identity": ("repository", "work_item"), "membership": ("repository", "work_item"), "status": ("work_item",), "actual_completion": ("work_item",), "work": ("work_item",),
    "blockers": ("work_item",), "required_children": ("work_item",), "pull_requests": ("pull_request",), "reviews": ("pull_request_review",), "continuous_integration": ("ci_run",),
    "deployments": ("deployment",), "incidents": ("incident",), "metrics": ("repository",), "health": ("repository", "team"), "workload": ("team",), "investment": ("team",),
    "readiness": ("team",), "operational_deficiencies": ("team",), "source_health": ("organization",),
}
#: Facts whose earlier values are overwritten, so that they have no history.
NO_HISTORY = ("identity", "membership", "status", "work", "blockers", "required_children")
#: The ten states of a source, those that carry no facts and those that make an answer partial.
STATES = ("available", "stale", "unavailable", "unconfigured", "unauthorized", "no_data", "truncated", "conflicted", "not_applicable", "pruned")
WITHOUT_FACTS = ("unavailable", "unconfigured", "unauthorized", "no_data", "conflicted", "not_applicable", "pruned")
DEGRADING = ("stale", "unavailable", "unconfigured", "unauthorized", "truncated", "conflicted")
#: Facts of one investigation, letters of a reason, and the reasons' first words.
MOST_FACTS, REASON_LENGTH = 2000, 2000
PRUNED, NARROWED, UNEXPANDED = "pruned:subject_kind_unsupported", "narrowed:subject_kind_unsupported", "unexpanded"
OBSERVED_REFUSED = "observed-time questions cannot be answered; no canonical source retains observation history, so what was known at a past instant is not recoverable"
HISTORY_REFUSED = "this fact keeps no history"


def capabilities(spark: SparkSession) -> DataFrame:
    """fact_kind, supported (array), one row per capability."""
    return spark.createDataFrame([(k, list(v)) for k, v in CAPABILITIES.items()], "fact_kind string, supported array<string>")


def merged_requirements(*groups: DataFrame) -> DataFrame:
    """One requirement per investigation and fact kind: the first of the first group that has it, in their order.

    Groups of nothing but the key and a whole number ``nth`` are merged by one number each, without a sort.
    """
    keyed = [g.withColumn("_group", F.lit(i)) for i, g in enumerate(groups)]
    both = keyed[0]
    for g in keyed[1:]:
        both = both.unionByName(g, allowMissingColumns=True)
    if set(both.columns) == {"investigation", "fact_kind", "nth", "_group"} and both.schema["nth"].dataType.simpleString() == "int":
        least = both.groupBy("investigation", "fact_kind").agg(F.min((F.col("_group") * F.lit(1 << 32)) + F.col("nth")).alias("_least"))
        group = F.shiftright(F.col("_least") + F.lit(1 << 31), 32)
        return least.select("investigation", "fact_kind", (F.col("_least") - group * F.lit(1 << 32)).cast("int").alias("nth"))
    order = Window.partitionBy("investigation", "fact_kind").orderBy("_group", "nth")
    return both.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def read_subjects(requirements: DataFrame, own: DataFrame, scope: DataFrame, derived: DataFrame, capable: DataFrame | None = None) -> DataFrame:
    """Subjects of each requirement: its own or else the investigation's, then derived ones that are not among them.

    requirements: investigation, fact_kind; own and derived: investigation, fact_kind, subject_kind,
    subject_id, place; scope: investigation, subject_kind, subject_id, place.  With ``capable``
    only subjects of a kind that their facts can be read for, so that no others are grouped.
    """
    key, subject = ["investigation", "fact_kind"], ["subject_kind", "subject_id", "place"]
    named = own.select(*key, *subject).join(requirements.select(*key), key, "left_semi")
    wide = requirements.select(*key).join(own.select(*key).distinct(), key, "left_anti").join(scope.select("investigation", *subject), "investigation").select(*key, *subject)
    more = derived.select(*key, *subject).join(requirements.select(*key), key, "left_semi")
    both = named.unionByName(wide).withColumn("_derived", F.lit(0)).unionByName(more.withColumn("_derived", F.lit(1)))
    both = both if capable is None else fitting(both, capable)
    # plain numbers, which are hashed where structs would be sorted; dealt by requirement, which is what subjects meet next
    first = [F.min(F.when(F.col("_derived") == d, F.col("place"))).alias(f"_place{d}") for d in (0, 1)]
    once = both.repartition(*key).groupBy(*key, "subject_kind", "subject_id").agg(F.min("_derived").alias("derived"), *first)
    return once.select(*key, "subject_kind", "subject_id", "derived", F.when(F.col("derived") == 0, F.col("_place0")).otherwise(F.col("_place1")).alias("place"))


def _list(c: str | Column) -> Column:
    joined = F.array_join(c, ",")
    return F.when(joined == "", "none").otherwise(joined)


def refusal() -> Column:
    """Why a requirement's axis cannot be answered by its kind of facts, or null."""
    return F.when(F.col("axis") == "observed", OBSERVED_REFUSED).when((F.col("axis") != "current") & F.col("fact_kind").isin(*NO_HISTORY), HISTORY_REFUSED)


def plan(requirements: DataFrame, subjects: DataFrame, capable: DataFrame, gaps: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per requirement: read, narrowed, pruned, gap, no_subjects, refused or unconfigured, and why.

    A kind of facts that no subject can have is pruned, which proves that nothing is missing;
    where the scope is known to be incomplete (a gap: outcome, origin_kind, policy, basis,
    degrades) that is said instead.  An axis that the facts cannot answer is refused as a row.
    Subjects are counted per requirement, so any number of them costs one row here.  Where all
    kinds of subjects are known (``kinds``, 63 at most), those of a requirement are one number, not a set.
    """
    key = ["investigation", "fact_kind"]
    capable = F.broadcast(capable.withColumn("_capable", _list("supported")))  # a row per kind of facts; joined by shuffle it would gather all subjects at a few kinds
    met = subjects.join(capable, "fact_kind", "left").withColumn("_fits", F.coalesce(F.array_contains("supported", F.col("subject_kind")), F.lit(False)))
    if kinds is None:
        skipped, unfit = _list("_skipped"), F.array_sort(F.collect_set(F.when(~F.col("_fits"), F.col("subject_kind"))))
    else:
        bits = {k: 1 << i for i, k in enumerate(sorted(kinds))}
        named = F.concat_ws(",", *(F.when(F.col("_skipped").bitwiseAND(F.lit(b)) != 0, k) for k, b in bits.items()))
        skipped = F.when(F.col("_skipped").isNotNull(), F.when(named == "", "none").otherwise(named))
        bit = reduce(lambda c, k: c.when(F.col("subject_kind") == k, F.lit(bits[k])), list(bits)[1:], F.when(F.col("subject_kind") == next(iter(bits)), F.lit(bits[next(iter(bits))])))
        unfit = F.coalesce(F.bit_or(F.when(~F.col("_fits"), bit.cast("long"))), F.lit(0).cast("long"))
    sums = met.groupBy(*key).agg(F.count("*").alias("asked"), F.count_if("_fits").alias("readable"), unfit.alias("_skipped"))
    out = requirements.join(sums, key, "left").join(capable, "fact_kind", "left").join(gaps.withColumn("_gap", F.lit(True)), key, "left")
    asked, readable = F.coalesce("asked", F.lit(0)), F.coalesce("readable", F.lit(0))
    has_gap, degrades = F.coalesce("_gap", F.lit(False)), F.coalesce("degrades", F.lit(False))
    refused = refusal()
    decision = (
        F.when(F.col("supported").isNull(), "unconfigured").when(asked == 0, "no_subjects").when((readable == 0) & has_gap, "gap").when(readable == 0, "pruned")
        .when(refused.isNotNull(), "refused").when(readable < asked, "narrowed").otherwise("read")
    )
    # each used more than once, so each is a step of its own: all in one is too long a method to be compiled
    out = out.withColumn("decision", decision).withColumn("_skipped", skipped)
    decision, supported, skipped = F.col("decision"), F.col("_capable"), F.col("_skipped")
    pruned = F.concat(F.lit(f"{PRUNED}: no resolved subject has a kind this capability supports (resolved: "), skipped, F.lit("; supported: "), supported, F.lit(")"))
    narrowed = F.concat(F.lit(f"{NARROWED}: "), (asked - readable).cast("string"), F.lit(" subject(s) were not queried because this capability does not support their kind (skipped: "), skipped, F.lit("; supported: "), supported, F.lit(")"))
    gap = F.concat(
        F.lit(f"{UNEXPANDED}:"), F.col("outcome"), F.lit(": no resolved subject holds this capability's facts directly and scope expansion did not reach them (origin: "), F.col("origin_kind"),
        F.lit("; supported: "), supported, F.lit("; policy: "), F.col("policy"), F.lit("; basis: "), F.col("basis"), F.lit(")"),
    )
    out = out.withColumn("_gap_note", F.when(has_gap, gap))
    gap = F.col("_gap_note")
    note = F.concat_ws(" ", F.when(decision == "narrowed", narrowed), F.when(decision.isin("read", "narrowed") & has_gap & degrades, gap))
    reason = F.when(decision == "gap", gap).when(decision == "pruned", pruned).when(decision == "refused", refused).otherwise(F.nullif(note, F.lit("")))
    incomplete = decision.isin("read", "narrowed") & has_gap & degrades
    return out.select(*key, "nth", "decision", asked.alias("asked"), F.when(decision.isin("read", "narrowed"), readable).otherwise(F.lit(0)).alias("readable"), reason.alias("note"), incomplete.alias("incomplete"), F.col("outcome").alias("gap_outcome"))


def planned_reads(planned: DataFrame, subjects: DataFrame, capable: DataFrame) -> DataFrame:
    """The subjects that each planned read is about."""
    key = ["investigation", "fact_kind"]
    return fitting(subjects, capable).join(planned.filter(F.col("decision").isin("read", "narrowed")).select(*key), key, "left_semi").select(*key, "subject_kind", "subject_id", "derived", "place")


def fitting(subjects: DataFrame, capable: DataFrame) -> DataFrame:
    """The subjects of a kind that their requirement's facts can be read for."""
    kinds = capable.select("fact_kind", F.explode("supported").alias("subject_kind"))
    return subjects.join(F.broadcast(kinds), ["fact_kind", "subject_kind"], "left_semi")


def open_reads(requirements: DataFrame, own: DataFrame, scope: DataFrame, derived: DataFrame, capable: DataFrame) -> DataFrame:
    """What ``planned_reads`` gives, without the plan: a requirement with a fitting subject is read unless its axis is refused."""
    asked = requirements.filter(refusal().isNull())
    return read_subjects(asked, own, scope, derived, capable)


def kept_facts(planned: DataFrame, facts: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """The facts of an investigation up to ``most``, in the order of its requirements and then of the provider.

    Facts are counted per requirement; a requirement that lies within the bound keeps all, one
    beyond it none, and only in the one that crosses it are facts ranked.
    """
    key = ["investigation", "fact_kind"]
    sizes = planned.filter(F.col("decision").isin("read", "narrowed")).join(facts.groupBy(*key).agg(F.count("*").alias("n")), key)
    before = Window.partitionBy("investigation").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)  # one row per requirement
    room = sizes.withColumn("_room", F.lit(most) - F.coalesce(F.sum("n").over(before), F.lit(0))).filter("_room > 0").select(*key, "_room", (F.col("n") > F.col("_room")).alias("_crosses"))
    met = facts.join(room, key)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    crossing = met.filter("_crosses").withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_room")).drop("_rank")
    return met.filter("NOT _crosses").unionByName(crossing).drop("_room", "_crosses")


def coverage(planned: DataFrame, results: DataFrame, facts: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per requirement: state, reason, facts kept, and whether the answer is partial for it.

    results: investigation, fact_kind, state, reason, truncated, omitted, grain; a planned read
    without a result timed out.  A truncated, omitted-from or cut result is ``truncated``, as is
    one over subjects that are known not to be all.  A state that can carry no facts but has
    some, or one that no provider may give, is a fault.
    """
    key = ["investigation", "fact_kind"]
    counts = facts.groupBy(*key).agg(F.count("*").alias("_given"))
    left = kept.groupBy(*key).agg(F.count("*").alias("_kept"))
    out = planned.join(results, key, "left").join(counts, key, "left").join(left, key, "left")
    ran = F.col("decision").isin("read", "narrowed")
    given, stays = F.coalesce("_given", F.lit(0)), F.coalesce("_kept", F.lit(0))
    cut = F.coalesce(F.col("truncated"), F.lit(False)) | F.col("incomplete") | (F.coalesce("omitted", F.lit(0)) > 0) | (stays < given)
    failed = F.col("state").isNull()
    state = (
        F.when(F.col("decision") == "unconfigured", "unconfigured").when(F.col("decision") == "pruned", "pruned").when(F.col("decision") == "refused", "not_applicable").when(F.col("decision") == "no_subjects", "not_applicable")
        .when((F.col("decision") == "gap") & (F.col("gap_outcome") == "attempted_empty"), "no_data").when(F.col("decision") == "gap", "unavailable")
        .when(failed, "unavailable").when(cut & ~F.col("state").isin(*WITHOUT_FACTS), "truncated").otherwise(F.col("state"))
    )
    said = F.nullif(F.trim(F.coalesce("reason", F.lit(""))), F.lit(""))
    own = F.when(failed, "canonical fact capability timed out").otherwise(F.concat_ws(" ", "note", said))
    omitted = F.when(F.coalesce("omitted", F.lit(0)) > 0, F.concat(F.coalesce(F.nullif(own, F.lit("")), F.lit("canonical fact rows were omitted")), F.lit(" (omitted "), F.col("omitted").cast("string"), F.lit(")")))
    ran_reason = F.when(failed, F.concat_ws(" ", "note", F.lit("canonical fact capability timed out"))).otherwise(F.coalesce(omitted, F.nullif(own, F.lit("")), F.when(cut & ~F.col("state").isin(*WITHOUT_FACTS), "canonical fact result was truncated")))
    reason = F.when(F.col("decision") == "unconfigured", "canonical fact capability is not configured").when(ran, ran_reason).otherwise(F.col("note"))
    shown = F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.when(state != "available", F.concat(F.lit("canonical fact capability returned "), state)))
    fault = F.when(ran & ~failed & ~F.col("state").isin(*[s for s in STATES if s != "pruned"]), "invalid_state").when(ran & F.col("state").isin(*WITHOUT_FACTS) & (given > 0), "facts_without_source")
    return out.select(
        *key, "nth", F.concat(F.lit("canonical_fact:"), "fact_kind").alias("source"), state.alias("state"), bounded_text(shown, REASON_LENGTH).alias("reason"), F.when(ran & ~state.isin(*WITHOUT_FACTS), stays).otherwise(F.lit(0)).alias("facts"),
        state.isin(*DEGRADING).alias("degrades"), F.when(ran & ~state.isin(*WITHOUT_FACTS) & (stays > 0), F.col("grain")).alias("grain"), fault.alias("fault"),
    )


def bundles(covered: DataFrame) -> DataFrame:
    """One row per investigation: partial, its degraded reasons in order, facts, and the coarsest grain of what contributed."""
    reason = F.when(F.col("degrades"), bounded_text(F.concat(F.col("fact_kind"), F.lit(": "), F.coalesce("reason", F.lit(""))), REASON_LENGTH))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("degrades"), F.struct("nth", reason.alias("r"))))), lambda x: x["r"])
    grain = F.when(F.bool_or(F.coalesce(F.col("grain") == "day", F.lit(False))), "day").when(F.bool_or(F.col("grain").isNotNull()), F.min("grain"))
    return covered.groupBy("investigation").agg(
        F.bool_or("degrades").alias("partial"), listed.alias("degraded_reasons"), F.sum("facts").alias("facts"), grain.alias("grain"), F.count_if(F.col("fault").isNotNull()).alias("faults"),
    )
