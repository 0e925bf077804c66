"""Predicates, labels and exclusion rules (projection-only operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.scalars import c, first_segment, name_of, segments, slashed
from quillsift.params import PARAMS

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".jfif", ".tif", ".tiff")
META_SUFFIXES = (".csv", ".json", ".xml", ".txt", ".xlsx", ".md")


def case(*branches, otherwise=None) -> Column:
    """Ordered (condition, value) branches: the first that holds decides."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def keep_path(path, excluded_prefixes: list[str]) -> Column:
    """False if the path starts with an excluded prefix."""
    if not excluded_prefixes:
        return F.lit(True)
    return ~F.exists(F.array(*map(F.lit, excluded_prefixes)), lambda p: F.startswith(slashed(path), p))


def file_kind(suffix) -> Column:
    return case((c(suffix).isin(*IMAGE_SUFFIXES), "image"), (c(suffix).isin(*META_SUFFIXES), "meta"), otherwise="other")


def quality_label(clip, score, clip_limit=PARAMS["dedup.clip_fraction"], score_limit=PARAMS["dedup.synthetic_score"]) -> Column:
    """clipped before synthetic before photo."""
    return case((c(clip) >= clip_limit, "clipped"), (c(score) >= score_limit, "synthetic"), otherwise="photo")


def exclusion_cascade(flags: DataFrame, manual: DataFrame, key: str = "path") -> DataFrame:
    """(key, reason): rows flagged by rule, then manual ones that no rule has excluded; reasons have 48 characters at most.

    flags: key, clip_frac, score; manual: key, reason.  Repeated keys count once.
    """
    ruled = flags.select(key, quality_label("clip_frac", "score").alias("reason"), F.lit(0).alias("priority")).where("reason != 'photo'")
    by_hand = manual.select(key, F.substring("reason", 1, 48).alias("reason"), F.lit(1).alias("priority"))
    return ruled.unionByName(by_hand).groupBy(key).agg(F.min(F.struct("priority", "reason"))["reason"].alias("reason"))


def allowed_folder(path, folders: list[str]) -> Column:
    return first_segment(path).isin(*folders)


def blocked_path(path, open_level: str = "unannotated") -> Column:
    """A path inside an annotated level or of an annotation file; the open level is exempt."""
    low = F.transform(segments(path), lambda p: F.lower(p))
    is_open = F.exists(low, lambda p: F.contains(p, F.lit(open_level)))
    annotated = F.exists(low, lambda p: F.contains(p, F.lit("annotated")))
    files = F.element_at(low, -1)
    return F.coalesce((annotated & ~is_open) | files.endswith("annotation") | files.endswith("annotations") | files.endswith(".json"), F.lit(False))


def guarded(df: DataFrame, broken: Column, message: str) -> DataFrame:
    """``df``, failing at run time if any row is broken: an output check that travels with the plan."""
    return df.withColumn("_guard", F.when(broken, F.raise_error(F.lit(message)))).where(F.col("_guard").isNull()).drop("_guard")


def masked(value, hidden) -> Column:
    """``value``, or null where it must not be used."""
    return F.when(~c(hidden), c(value))


def category_of(path, categories: list[str]) -> Column:
    """The first of ``categories`` that is a part of the path."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, categories)), lambda x: F.array_contains(segments(path), x)), F.lit(1)) if categories else F.lit(None)


def naming_scheme(path, schemes: list[tuple[str, str]], otherwise: str) -> Column:
    """The first of (scheme, pattern) whose pattern the file's name holds."""
    return case(*((name_of(path).rlike(pattern), scheme) for scheme, pattern in schemes), otherwise=otherwise)


def same_scene(correlation, inliers) -> Column:
    """What confirms a candidate pair: a high correlation and enough inliers; a missing measure confirms nothing."""
    return F.coalesce((c(correlation) > 0.90) & (c(inliers) >= 30), F.lit(False))


def band(x, cuts: list[tuple[float, str]], lowest: str) -> Column:
    """The label of the first cut (from the highest down) that x reaches; null if x is null."""
    out = None
    for limit, label in cuts:
        out = F.when(c(x) >= limit, label) if out is None else out.when(c(x) >= limit, label)
    return F.when(c(x).isNotNull(), out.otherwise(lowest))


def reliability(confidence) -> Column:
    return band(confidence, [(PARAMS["delta.reliability_high"], "high"), (PARAMS["delta.reliability_moderate"], "moderate")], "low")


def confidence_words(confidence) -> Column:
    """Words for readers; their cut-offs differ from those of ``reliability``."""
    return band(confidence, [(0.65, "good"), (0.45, "fair")], "poor")


def focus_band(sharpness) -> Column:
    return band(sharpness, [(PARAMS["caption.focus_marginal"], "sharp"), (PARAMS["caption.focus_poor"], "marginal")], "poor")


def agreed_extent(model, heuristic) -> Column:
    """Mean of two sources if they agree and the second has not filled the frame; else null."""
    agree = (F.abs(c(model) - c(heuristic)) <= PARAMS["caption.mouth_tolerance"]) & (c(heuristic) < PARAMS["caption.full_frame"])
    return F.when(agree, (c(model) + c(heuristic)) / 2)


def comparability(failed, confidence, overlap) -> Column:
    """Ordered refusals: failed alignment, low confidence, small overlap."""
    return case(
        (c(failed), "alignment_failed"),
        (c(confidence) < PARAMS["delta.confidence_floor"], "low_confidence"),
        (c(overlap) < PARAMS["delta.min_overlap"], "small_overlap"),
        otherwise="comparable",
    )


def refusal_kind(reason) -> Column:
    """Class of a refusal by what its text says; the first match decides."""
    r = F.lower(c(reason))
    return case(
        (r.isNull(), "none"),
        (F.contains(r, F.lit("confidence")), "confidence"),
        (F.contains(r, F.lit("overlap")), "overlap"),
        (F.contains(r, F.lit("inlier")) | F.contains(r, F.lit("match")), "matching"),
        otherwise="other",
    )


def forbidden_term(text, terms: list[str], whole_words: bool = False) -> Column:
    """True if a text holds one of the terms, case aside; inside words too unless ``whole_words``."""
    union = "|".join(terms)
    return F.coalesce(c(text).rlike(rf"(?i)\b(?:{union})\b" if whole_words else f"(?i)(?:{union})"), F.lit(False))


def pick_column(df: DataFrame, *candidates: str) -> str | None:
    """The first column whose name, without spaces, underscores and case, is a candidate; candidates decide first."""
    plain = lambda s: s.lower().replace(" ", "").replace("_", "")
    for want in candidates:
        for have in df.columns:
            if plain(have) == plain(want):
                return have
    return None
