"""Scalar column functions: paths, numbers, hashes, rings and matrices.

All of them are built-in expressions, so they stay inside generated code.
Undefined results are null, never 0, 1 or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# --- paths and text -------------------------------------------------------


def slashed(path) -> Column:
    """Back-slashes as slashes."""
    return F.replace(c(path), F.lit("\\"), F.lit("/"))


def name_of(path) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def stem_of(path) -> Column:
    """File name without its last suffix; a name that starts with its only dot has none."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def suffix_of(path) -> Column:
    """Lower-case suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(name_of(path), r"(?<=.)(\.[^.]*)$", 1))


def first_segment(path) -> Column:
    return F.element_at(F.split(slashed(path), "/"), 1)


def segments(path) -> Column:
    """Sort key of paths: compared part by part, so that a/b comes before a-b/c."""
    return F.split(slashed(path), "/")


def extract_or_null(text, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c(text), pattern, group), F.lit(""))


def zero_to(x, other) -> Column:
    """``other`` where the number x is null or 0."""
    return F.coalesce(F.nullif(c(x), F.lit(0)), c(other))


def token_class(text, first: list[str], second: list[str], names=("first", "second", "mixed", "none")) -> Column:
    """Which of two dictionaries of patterns a text matches."""
    a, b = (F.lower(c(text)).rlike("|".join(f"(?:{p})" for p in ps)) for ps in (first, second))
    return F.when(a & b, names[2]).when(a, names[0]).when(b, names[1]).otherwise(names[3])


def filled(template: str, **values) -> Column:
    """``template`` with each {name} replaced by a column; nulls are written as a dash."""
    out = F.lit(template)
    for name, v in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c(v).cast("string"), F.lit("-")))
    return out


# --- numbers --------------------------------------------------------------


def ramp(x, low: float, high: float) -> Column:
    """Linear ramp from low (0) to high (1), clipped; inverted if high < low, 0 if they are equal."""
    if low == high:
        return F.lit(0.0)
    return clip01((c(x) - F.lit(low)) / F.lit(high - low))


def clip01(x) -> Column:
    # greatest and least pass over nulls, so an unknown value is kept unknown
    return F.when(c(x).isNotNull(), F.greatest(F.least(c(x), F.lit(1.0)), F.lit(0.0)))


def saturating(n, scale: float) -> Column:
    """1 - exp(-n / scale), 0 for n <= 0."""
    return 1 - F.exp(-F.greatest(c(n).cast("double"), F.lit(0.0)) / F.lit(scale))


def half_life(x, scale: float) -> Column:
    """exp(-x / scale) for x >= 0; 0 where x is not finite."""
    x = c(x).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.when(finite, F.exp(-F.greatest(x, F.lit(0.0)) / F.lit(scale))).otherwise(0.0)


def angle_delta(a, b) -> Column:
    """a - b on a circle of 180, from -90 up to 90."""
    return F.pmod(c(a) - c(b) + F.lit(90.0), F.lit(180.0)) - F.lit(90.0)


def magnitude(*xs) -> Column:
    return F.sqrt(sum((c(x) * c(x) for x in xs[1:]), c(xs[0]) * c(xs[0])))


def compactness(perimeter, area) -> Column:
    """p^2 / (4 pi A); null for an area of 0 or less."""
    return F.when(c(area) > 0, c(perimeter) * c(perimeter) / (F.lit(4.0) * F.pi() * c(area)))


def percent_change(old, new) -> Column:
    return F.try_divide(F.lit(100.0) * (c(new) - c(old)), c(old).cast("double"))


def entropy(counts) -> Column:
    """Shannon entropy in bits of an array of counts; null if they sum to 0."""
    n = F.aggregate(c(counts), F.lit(0.0), lambda s, x: s + x)
    return F.when(n > 0, F.aggregate(c(counts), F.lit(0.0), lambda s, x: s - F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0)))


def argmax(xs) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(c(xs), F.array_max(c(xs))) - 1


def power_of_two_sample(edge, target: int) -> Column:
    """Smallest power of two by which the long edge must be divided to be at most ``target``."""
    ratio = F.greatest(c(edge).cast("double") / F.lit(float(target)), F.lit(1.0))
    return F.pow(F.lit(2.0), F.ceil(F.log2(ratio))).cast("long")


def weighted_confidence(inlier_ratio, n_inliers, reprojection, blur, p: dict) -> Column:
    """Weighted mean of four terms in [0, 1]."""
    w = [p[f"confidence.w_{k}"] for k in ("inlier_ratio", "inliers", "reproj", "blur")]
    terms = (
        clip01(c(inlier_ratio)),
        clip01(c(n_inliers) / F.lit(float(p["confidence.inliers_saturation"]))),
        half_life(reprojection, p["confidence.reproj_halflife"]),
        clip01(c(blur) / F.lit(p["confidence.blur_saturation"])),
    )
    return clip01(sum((F.lit(a) * t for a, t in zip(w[1:], terms[1:])), F.lit(w[0]) * terms[0]) / F.lit(sum(w)))


# --- hashes ---------------------------------------------------------------


def hamming(a, b) -> Column:
    return F.bit_count(c(a).bitwiseXOR(c(b)))


def sign_bits(values) -> Column:
    """63-bit fingerprint of 64 numbers: element 0 is dropped, a bit is set where a value exceeds the others' median; the first bit is the highest."""
    rest = F.transform(F.slice(c(values), 2, 63), lambda x: x.cast("double"))
    median = F.element_at(F.array_sort(rest), 32)
    return F.element_at(
        F.transform(F.array(F.struct(rest.alias("r"), median.alias("m"))), lambda s: F.aggregate(s["r"], F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1) + F.when(x > s["m"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))),
        1,
    )


def word_grams(words, n: int = 3) -> Column:
    """Distinct n-grams of a word array joined by spaces; of a shorter array all its words."""
    w = c(words)
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.array_distinct(F.when(F.size(w) >= n, grams).otherwise(F.array(F.array_join(w, " "))))


# --- dates ------------------------------------------------------------------


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def file_stamp(epoch_ms, prefix: str = "visit_", suffix: str = ".jpg") -> Column:
    """File name of a moment in milliseconds, in the session's time zone."""
    return F.concat(F.lit(prefix), F.date_format(F.timestamp_millis(c(epoch_ms)), "yyyyMMdd_HHmmss_SSS"), F.lit(suffix))


# --- rings and matrices ---------------------------------------------------


def shoelace(points) -> Column:
    """Area of a ring of structs (x, y); null under 3 points."""
    p = c(points)
    turned = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    twice = F.aggregate(F.zip_with(p, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(p) >= 3, F.abs(twice) / 2)


def ring_points(flat) -> Column:
    """Points of a flat list x, y, x, y, ...; null if it has fewer than 6 numbers or an odd count."""
    f = c(flat)
    n = F.size(f)
    return F.when((n >= 6) & (n % 2 == 0), F.transform(F.sequence(F.lit(0), (n / 2).cast("int") - 1), lambda i: F.struct(F.element_at(f, 2 * i + 1).cast("double").alias("x"), F.element_at(f, 2 * i + 2).cast("double").alias("y"))))


def ellipse_points(cx, cy, rx, ry, n: int = 48) -> Column:
    """A polygon of n points around an ellipse."""
    step = F.lit(2.0) * F.pi() / F.lit(float(n))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct((c(cx) + c(rx) * F.cos(step * i)).alias("x"), (c(cy) + c(ry) * F.sin(step * i)).alias("y")))


def project(h, x, y) -> Column:
    """The point (x, y) under a 3x3 matrix of nested arrays."""
    h, x, y = c(h), c(x), c(y)
    row = lambda i: h[i][0] * x + h[i][1] * y + h[i][2]
    return F.struct(F.try_divide(row(0), row(2)).alias("x"), F.try_divide(row(1), row(2)).alias("y"))


def corner_error(h_true, h_found, width, height) -> Column:
    """Mean distance of the four projected corners of an image under two matrices."""
    total = F.lit(0.0)
    for x, y in ((F.lit(0.0), F.lit(0.0)), (c(width), F.lit(0.0)), (c(width), c(height)), (F.lit(0.0), c(height))):
        a, b = project(h_true, x, y), project(h_found, x, y)
        total = total + F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    return total / 4


def normalised(h) -> Column:
    """The matrix with its last element 1, or as it is if that is 0."""
    h = c(h)
    k = h[2][2]
    return F.when(F.abs(k) < 1e-12, h).otherwise(F.transform(h, lambda r: F.transform(r, lambda v: v / k)))


def det3(h) -> Column:
    h = c(h)
    return h[0][0] * (h[1][1] * h[2][2] - h[1][2] * h[2][1]) - h[0][1] * (h[1][0] * h[2][2] - h[1][2] * h[2][0]) + h[0][2] * (h[1][0] * h[2][1] - h[1][1] * h[2][0])


def det2(h) -> Column:
    h = c(h)
    return h[0][0] * h[1][1] - h[0][1] * h[1][0]


def frame_overlap(h, width, height, width2, height2) -> Column:
    """Share of the first frame that a second frame, moved into it by ``h``, covers.

    By area of the clipped quadrilateral, not by pixels.  Null if a corner of the
    second frame lies on or behind the horizon of the matrix.
    """
    h, w, t, w2, t2 = c(h), *(c(x).cast("double") for x in (width, height, width2, height2))
    zero = F.lit(0.0)
    corners = ((zero, zero), (w2, zero), (w2, t2), (zero, t2))
    ahead = F.least(*(h[2][0] * x + h[2][1] * y + h[2][2] for x, y in corners)) > 0
    side = lambda a, b, d: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), d.alias("d"))
    sides = F.array(side(1.0, 0.0, zero), side(-1.0, 0.0, w), side(0.0, 1.0, zero), side(0.0, -1.0, t))

    def clipped(points, s):
        inside = lambda p: s["a"] * p["x"] + s["b"] * p["y"] + s["d"]

        def step(p, i):
            q = F.get(points, F.pmod(i + 1, F.size(points)))
            a, b = inside(p), inside(q)
            at = lambda k: p[k] + F.try_divide(a, a - b) * (q[k] - p[k])
            return F.array_compact(F.array(F.when(a >= 0, p), F.when((a >= 0) != (b >= 0), F.struct(at("x").alias("x"), at("y").alias("y")))))

        return F.flatten(F.transform(points, step))

    # lambdas over one element, so that matrix and region are computed once
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    region = lambda m: F.aggregate(sides, F.array(*(project(m, x, y) for x, y in corners)), clipped)
    area = once(h, lambda m: once(region(m), lambda r: F.coalesce(shoelace(r), zero)))
    return F.when(ahead, area / (w * t))


def uniform(key, place: int, seed: int = 42) -> Column:
    """A number in [0, 1) drawn by md5 of seed, key and place: the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), c(key).cast("string"), F.lit(str(place))).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def drawn_homography(key, width, height, max_rotation_deg: float, scales: tuple[float, float], max_shift: float, jitter: float, seed: int = 42) -> Column:
    """A matrix drawn for ``key``: rotation and scale about the centre, a shift, then each corner moved a little.

    Shift and jitter are shares of the frame.  The matrix takes the frame's
    corners exactly to the drawn ones.
    """
    w, t = c(width).cast("double"), c(height).cast("double")
    span = lambda i, low, high: F.lit(low) + uniform(key, i, seed) * (high - low)
    angle, scale = F.radians(span(0, -max_rotation_deg, max_rotation_deg)), span(1, *scales)
    shift = span(2, -max_shift, max_shift) * w, span(3, -max_shift, max_shift) * t
    moved = []
    for i, (right, low) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
        x, y = (w - 1) * right - w / 2, (t - 1) * low - t / 2
        moved.append((
            w / 2 + scale * (F.cos(angle) * x - F.sin(angle) * y) + shift[0] + span(4 + 2 * i, -jitter, jitter) * w,
            t / 2 + scale * (F.sin(angle) * x + F.cos(angle) * y) + shift[1] + span(5 + 2 * i, -jitter, jitter) * t,
        ))
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = moved
    # the unit square to a quadrilateral in closed form, then the frame to the unit square
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    det = (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2)
    g, k = (sx * (y3 - y2) - (x3 - x2) * sy) / det, ((x1 - x2) * sy - sx * (y1 - y2)) / det
    row = lambda a, b, last: F.array(a / (w - 1), b / (t - 1), last)
    return F.array(row(x1 - x0 + g * x1, x3 - x0 + k * x3, x0), row(y1 - y0 + g * y1, y3 - y0 + k * y3, y0), row(g, k, F.lit(1.0)))


def implausible(h, p: dict) -> Column:
    """Why a matrix cannot be a change of camera: the first reason that holds, or null."""
    n = normalised(h)
    scale = F.sqrt(F.abs(det2(n)))
    return (
        F.when(F.abs(det3(n)) < p["alignment.min_abs_det"], "near-singular")
        .when(det2(n) <= 0, "mirrored")
        .when((scale < p["alignment.min_scale"]) | (scale > p["alignment.max_scale"]), "scale")
        .when(F.greatest(F.abs(n[2][0]), F.abs(n[2][1])) > p["alignment.max_perspective"], "perspective")
    )
