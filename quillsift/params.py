"""Thresholds of the library's rules, each with the key under which its origin is registered.

Fixed values: they must equal the published settings for equal results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARAMS = {
    "split.train": 0.70,
    "split.val": 0.15,
    "split.test": 0.15,
    "split.seed": 42,
    "dedup.hamming": 8,
    "dedup.cluster_margin": 4,
    "dedup.family_hamming": 14,
    "dedup.max_per_family": 3,
    "dedup.synthetic_score": 0.70,
    "dedup.clip_fraction": 0.60,
    "audit.cluster_hamming": 6,
    "classes.max_ratio": 2.0,
    "classes.max_rows": 600,
    "alignment.ratio_test": 0.75,
    "alignment.min_abs_det": 1e-6,
    "alignment.min_scale": 0.5,
    "alignment.max_scale": 2.0,
    "alignment.max_perspective": 0.002,
    "confidence.w_inlier_ratio": 0.35,
    "confidence.w_inliers": 0.20,
    "confidence.w_reproj": 0.30,
    "confidence.w_blur": 0.15,
    "confidence.inliers_saturation": 60,
    "confidence.reproj_halflife": 2.0,
    "confidence.blur_saturation": 150.0,
    "delta.confidence_floor": 0.3,
    "delta.min_overlap": 0.60,
    "delta.match_iou": 0.10,
    "delta.area_change": 0.10,
    "delta.relative_color": 28.0,
    "delta.reliability_high": 0.7,
    "delta.reliability_moderate": 0.5,
    "caption.mouth_tolerance": 0.20,
    "caption.intraoral_min": 0.25,
    "caption.full_frame": 0.995,
    "caption.focus_poor": 40.0,
    "caption.focus_marginal": 120.0,
    "risk.growth_moderate_pct": 10.0,
    "risk.growth_elevated_pct": 30.0,
    "risk.condition_prob_high": 0.70,
    "risk.escalate_on_rule_count": 2,
    "screening.flag": 0.5,
}


def params_table(spark: SparkSession) -> DataFrame:
    """(key, value) of every threshold."""
    return spark.createDataFrame([(k, float(v)) for k, v in sorted(PARAMS.items())], "key string, value double")
