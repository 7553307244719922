"""Closed vocabularies and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far a row's provenance is from its source.
PROVENANCE_RANK = {"native": 0, "explicit_text": 1, "derived": 2, "heuristic": 3}
#: Rule, category, claim, severity, category rank, and the lower-cased entity types they hold for.
CATEGORY_RULES = (
    ("evidence.observed.pressure.v1", "pressure", "observed", "high", 1, ("check", "check_run", "workflow_run", "build", "incident", "alert")),
    ("evidence.observed.cause.v1", "cause", "observed", "warning", 2, ("commit", "change", "diff")),
    ("evidence.observed.action.v1", "action", "observed", "warning", 4, ("recommendation", "review_action", "task")),
    ("evidence.observed.state.v1", "state", "observed", "info", 0, ("state", "deployment", "release")),
)
#: The rule of all other entity types.
EVIDENCE_RULE = ("evidence.observed.reference.v1", "evidence", "observed", "info", 3)
#: Claims that evidence may make for itself, and the most bytes of the rule that it names for them.
OWN_CLAIMS = ("inferred", "recommendation")
OWN_RULE_BYTES = 240
#: The order in which categories get what a quota leaves over.
CATEGORIES = ("state", "pressure", "cause", "evidence", "action")
AVAILABILITY = ("available", "stale", "redacted", "deleted", "unauthorized")
#: Raw link sources and the provenance they stand for; unknown ones become empty and fail validation.
ARTIFACT_PROVENANCE = {"pr_body": "explicit_text", "branch_name": "heuristic", "native": "native"}
REVIEW_PROVENANCE = {"native": "native"}
DEPLOYMENT_PROVENANCE = {"native": "native", "heuristic": "heuristic"}
INCIDENT_PROVENANCE = {
    "bounded_service_repository_heuristic": "heuristic",
    "native": "native", "native_repository_context": "native", "admin_configuration": "native", "pagerduty_service_metadata": "native", "compass_service_catalog": "native",
    "explicit_text": "explicit_text", "heuristic": "heuristic", "derived": "derived",
}
#: The order of match mechanisms and of relation types that may be stored.
MECHANISMS = ("caller", "exact", "alias", "provider_key", "lexical", "vector")

#: Kinds of facts in the order in which a bundle lists them.
FACT_KINDS = (
    "identity", "membership", "status", "actual_completion", "work", "blockers", "required_children", "pull_requests", "reviews", "continuous_integration",
    "deployments", "incidents", "metrics", "health", "workload", "investment", "readiness", "operational_deficiencies", "source_health", "evidence",
)


def choose(c: Column, table: dict[str, str], otherwise: str = "") -> Column:
    out = F.lit(otherwise)
    for value, target in table.items():
        out = F.when(c == value, target).otherwise(out)
    return out


def provenance_rank(c: Column) -> Column:
    out = F.lit(4)
    for value, rank in PROVENANCE_RANK.items():
        out = F.when(c == value, rank).otherwise(out)
    return out


def category_rule(entity_type: Column, own_rule: Column | None = None, own_claim: Column | None = None) -> Column:
    """struct(rule_id, category, claim, severity, category_rank) of an entity type.

    Evidence that names a rule of its own and one of ``OWN_CLAIMS`` has these two instead;
    a blank or too long rule or another claim counts for nothing.
    """
    names = ("rule_id", "category", "claim", "severity", "category_rank")

    def rule(row: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)])

    out = rule(EVIDENCE_RULE)
    for *row, types in CATEGORY_RULES:
        out = F.when(F.lower(entity_type).isin(*types), rule(tuple(row))).otherwise(out)
    if own_rule is None or own_claim is None:
        return out
    named = F.coalesce((F.trim(own_rule) != "") & (F.octet_length(own_rule) <= OWN_RULE_BYTES) & own_claim.isin(*OWN_CLAIMS), F.lit(False))
    own = {"rule_id": own_rule, "claim": own_claim}
    return F.struct(*[(F.when(named, own[n]).otherwise(out[n]) if n in own else out[n]).alias(n) for n in names])


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
