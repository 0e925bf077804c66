"""A table-driven rule engine: one definition gives firing, band, explanation and counterfactual."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.params import PARAMS

LEVELS = ("Low", "Moderate", "Elevated")
NOT_ASSESSED = "Not assessed"


@dataclass(frozen=True)
class Rule:
    """Fires where ``measure`` (SQL) reaches the threshold, or where ``measure`` itself is true if there is none."""

    rule_id: str
    level: str
    measure: str
    threshold: str | None = None
    unless: str | None = None  # a rule that takes this one's place where both would fire
    setting: str | None = None  # fires only if this setting is on


RULES = (
    Rule("AREA_GROWTH_LARGE", "Elevated", "area_change_pct", "risk.growth_elevated_pct"),
    Rule("AREA_GROWTH", "Moderate", "area_change_pct", "risk.growth_moderate_pct", unless="AREA_GROWTH_LARGE"),
    Rule("NEW_LESION", "Moderate", "state = 'new'"),
    Rule("COLOUR_CHANGE", "Moderate", "colour_measurable AND notable_colour"),
    Rule("PERSISTENT_CONDITION", "Moderate", "persistent_condition", setting="risk.allow_classifier_rules"),
)


def _fires(rule: Rule, params: dict, rules: tuple[Rule, ...]) -> Column:
    if rule.setting and not params.get(rule.setting):
        return F.lit(False)
    value = F.expr(rule.measure)
    out = F.coalesce(value >= F.lit(float(params[rule.threshold])) if rule.threshold else value, F.lit(False))
    other = next((r for r in rules if r.rule_id == rule.unless), None)
    return out & ~_fires(other, params, rules) if other else out


def fired_rules(params: dict = PARAMS, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of the rules that fire on a row; nothing fires on a refused or partial one."""
    usable = F.coalesce((F.col("status") == "ok") & (F.col("comparability") == "full"), F.lit(False))
    one = lambda r: F.when(
        usable & _fires(r, params, rules),
        F.struct(
            F.lit(r.rule_id).alias("rule_id"),
            F.lit(r.level).alias("level"),
            F.lit(LEVELS.index(r.level)).alias("rank"),
            F.col("lesion_id").alias("lesion_id"),
            (F.expr(r.measure).cast("double") if r.threshold else F.lit(None).cast("double")).alias("measured"),
            F.lit(float(params[r.threshold]) if r.threshold else None).cast("double").alias("threshold"),
            F.lit(r.threshold).cast("string").alias("threshold_key"),
        ),
    )
    return F.filter(F.array(*(one(r) for r in rules)), lambda x: x.isNotNull())


def assess(lesions: DataFrame, report: str, params: dict = PARAMS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per report: band, rules that fired, escalation, what decided.

    lesions: report, lesion_id, status, comparability, state, area_change_pct,
    colour_measurable, notable_colour, persistent_condition.  A refused report is
    not assessed; it is never Low.
    """
    d = lesions.withColumn("_f", fired_rules(params, rules))
    g = d.groupBy(report).agg(
        F.max(F.col("status") == "ok").alias("_ok"),
        F.count_if(F.col("comparability") == "partial").alias("n_partial"),
        F.sum(F.size("_f")).cast("int").alias("n_rules"),
        F.coalesce(F.max(F.array_max(F.transform("_f", lambda r: r["rank"]))), F.lit(0)).alias("_top"),
        F.sum(F.size(F.filter("_f", lambda r: r["level"] == "Moderate"))).cast("int").alias("n_moderate"),
        F.min(F.array_min(F.transform(F.filter("_f", lambda r: r["threshold"].isNotNull()), lambda r: r["measured"] - r["threshold"]))).alias("least_margin"),
    )
    escalated = F.coalesce((F.col("_top") == 1) & (F.col("n_moderate") >= params["risk.escalate_on_rule_count"]), F.lit(False))
    names = F.array(*map(F.lit, LEVELS))
    return g.select(
        report,
        F.when(~F.col("_ok"), NOT_ASSESSED).when(escalated, "Elevated").otherwise(F.element_at(names, F.col("_top") + 1)).alias("band"),
        (escalated & F.col("_ok")).alias("escalated_by_rule_count"),
        "n_rules",
        "n_moderate",
        "n_partial",
        "least_margin",
    )


def counterfactuals(lesions: DataFrame, report: str, params: dict = PARAMS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(report, lesion_id, rule_id, level, measured, threshold, margin): how far each firing stands above its threshold."""
    d = lesions.select(report, F.explode(fired_rules(params, rules)).alias("r"))
    return d.select(report, "r.lesion_id", "r.rule_id", "r.level", "r.measured", "r.threshold", (F.col("r.measured") - F.col("r.threshold")).alias("margin"), F.col("r.threshold_key").alias("threshold_key"))


def deciding(lesions: DataFrame, report: str, params: dict = PARAMS, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(report, lesion_id, rule_id, level): firings at the highest level of their report; several can tie."""
    d = lesions.select(report, F.explode(fired_rules(params, rules)).alias("r"))
    top = d.groupBy(report).agg(F.max("r.rank").alias("_top"))
    return d.join(top, report).where("r.rank = _top").select(report, "r.lesion_id", "r.rule_id", "r.level")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return spark.createDataFrame([(r.rule_id, r.level, r.measure, r.threshold) for r in rules], "rule_id string, level string, measure string, threshold_key string")


def unregistered(rules: DataFrame, registry: DataFrame) -> DataFrame:
    """Thresholds that rules use and the registry does not know."""
    return rules.where("threshold_key IS NOT NULL").join(registry.select(F.col("key").alias("threshold_key")), "threshold_key", "left_anti")


def with_provenance(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with the state of their threshold's origin; a missing one is unregistered, never an error."""
    return rows.join(registry.select(F.col("key").alias("threshold_key"), "state"), "threshold_key", "left").withColumn("state", F.coalesce("state", F.lit("unregistered")))
