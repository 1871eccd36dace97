"""Values, utilities, confidences and pointwise losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicketry.functions.vectors import EPS, col

#: The named selection formulas as (value mode, utility mode).
VARIANTS = {"v1": ("hard_gap", "product"), "v2a": ("smooth", "product"), "v2b": ("hard_gap", "reward"), "v2": ("smooth", "reward")}


def band_score(boundary: Column | str, whole: Column | str) -> Column:
    return col(boundary) * (1 - col(whole))


def value(boundary: Column | str, whole: Column | str, mode: str, valid: Column | str | None = None) -> Column:
    """``hard_gap``: relu(b - w) (1 - w); ``smooth``: b (1 - w); zero where not valid."""
    b, w = col(boundary), col(whole)
    v = F.greatest(F.lit(0.0), b - w) * (1 - w) if mode == "hard_gap" else b * (1 - w)
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return v if valid is None else F.when(col(valid), v).otherwise(0.0)


def novelty(max_cosine: Column | str) -> Column:
    return 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(max_cosine)))


def utility(v: Column | str, n: Column | str, mode: str) -> Column:
    return col(v) * col(n) if mode == "product" else col(v) * (1 + col(n))


def uncertainty(p: Column | str) -> Column:
    return 4 * col(p) * (1 - col(p))


def binary_entropy(p: Column | str, eps: float = EPS) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(p)))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q)) / F.log(F.lit(2.0))


def bce(p: Column | str, target: Column | str, eps: float = EPS) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), col(p)))
    return -(col(target) * F.log(q) + (1 - col(target)) * F.log(1 - q))


def bce_logit(logit: Column | str, target: Column | str) -> Column:
    """Cross-entropy of a logit, in the form that cannot overflow."""
    x = col(logit)
    return F.greatest(x, F.lit(0.0)) - x * col(target) + F.log1p(F.exp(-F.abs(x)))


def confidence(p, contradiction, mix_entropy, route, shift) -> Column:
    """Product of five factors: decidedness, agreement, mixture certainty, route, and small displacement."""
    return F.abs(2 * col(p) - 1) * (1 - col(contradiction)) * (1 - col(mix_entropy)) * col(route) * (0.5 + 0.5 * F.exp(-F.abs(col(shift)) / 0.25))


def hard_target(p: Column | str, fg: float, bg: float) -> tuple[Column, Column]:
    """(target, kept): foreground from ``fg`` on, background up to ``bg``, the band between is not kept."""
    return (col(p) >= fg).cast("double"), (col(p) >= fg) | (col(p) <= bg)


def needs_correction(p: Column | str, g: Column | str, least: float = 0.25) -> Column:
    return F.abs(col(p) - col(g)) > least


def error_class(p: Column | str, g: Column | str, boundary: Column | str) -> Column:
    """Mutually exclusive, in this order: missed, false, boundary, stable."""
    hit, real = col(p) >= 0.5, col(g) >= 0.5
    return F.when(~hit & real, "missed").when(hit & ~real, "false").when(col(boundary) > 0, "boundary").otherwise("stable")


def ramp(epoch: Column | str, start: int, end: int) -> Column:
    """0 up to ``start``, 1 from ``end`` on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(epoch) - start) / float(max(1, end - start))))


def margin_confidence(margin: Column | str, temperature: float = 0.1, floor: float = 0.1) -> Column:
    """max(sigmoid(margin / temperature), floor); the floor where there is no second hit."""
    return F.coalesce(F.greatest(1 / (1 + F.exp(-col(margin) / temperature)), F.lit(floor)), F.lit(floor))


def contradiction(parent: Column | str, semantic: Column | str, detail: Column | str) -> Column:
    return (F.abs(col(parent) - col(semantic)) + F.abs(col(semantic) - col(detail))) / 2


def geometry_error(sdf: tuple, normal: tuple, offset: tuple) -> Column:
    """|distance error| + 0.5 (1 - cosine of normals) + 0.5 |offset error|, from pairs (predicted, real); a normal is a pair (x, y)."""
    (nx, ny), (mx, my) = normal
    cos = (col(nx) * col(mx) + col(ny) * col(my)) / F.greatest(F.hypot(col(nx), col(ny)) * F.hypot(col(mx), col(my)), F.lit(EPS))
    return F.abs(col(sdf[0]) - col(sdf[1])) + 0.5 * (1 - cos) + 0.5 * F.abs(col(offset[0]) - col(offset[1]))


def gate_target(need: Column | str, contradicted: Column | str) -> Column:
    return col(need) * (1 - col(contradicted))


def support_weight(target: Column | str, hard: Column | str) -> Column:
    """2 for a hard negative, else 1."""
    return F.when(col(hard) & (col(target) <= 0), 2.0).otherwise(1.0)


def class_nll(p: Column | str, eps: float = EPS) -> Column:
    return -F.log(F.greatest(col(p), F.lit(eps)))


def smooth_l1(x: Column | str) -> Column:
    return F.when(F.abs(col(x)) < 1, 0.5 * col(x) * col(x)).otherwise(F.abs(col(x)) - 0.5)


def oracle_divergence(target: Column | str, weights: Column | str, eps: float = EPS) -> Column:
    """Divergence of the oracle's weights from those used."""
    low = lambda x: F.log(F.greatest(x, F.lit(eps)))
    return F.aggregate(F.zip_with(col(target), col(weights), lambda t, w: t * (low(t) - low(w))), F.lit(0.0), lambda s, x: s + x)


def support_targets(query_region: Column | str, region: Column | str) -> dict[str, Column]:
    """What a candidate's region says of a query's: the same side, the same region, and the hard ones.

    Regions 0 and 1 are foreground, 2 and 3 background; 1 and 2 meet at the boundary. False where
    the candidate's region is unknown.
    """
    q, c = col(query_region), col(region)
    known = F.coalesce(c.between(0, 3), F.lit(False))
    semantic, detail = known & ((q < 2) == (c < 2)), known & (q == c)
    across = known & (((q == 1) & (c == 2)) | ((q == 2) & (c == 1)))
    return {"semantic": semantic, "detail": detail, "semantic_hard": across, "detail_hard": semantic & ~detail}


def geometry_support(query: Column, child: Column, parent: Column) -> Column:
    """Eight features of three geometries (sdf, nx, ny, ox, oy, reliability) as an array.

    Negated distance, cosine of the normals, negated offset error, and the cube root of the product
    of the reliabilities, of query and child; the first three of parent and child; the parent's
    reliability.
    """
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def pair(a, b):
        cos = (a[1] * b[1] + a[2] * b[2]) / (F.greatest(F.hypot(a[1], a[2]), F.lit(EPS)) * F.greatest(F.hypot(b[1], b[2]), F.lit(EPS)))
        return -F.abs(a[0] - b[0]), cos, -(F.abs(a[3] - b[3]) + F.abs(a[4] - b[4])) / 2

    trust = F.cbrt(unit(query[5]) * unit(child[5]) * unit(parent[5]))
    return F.array(*pair(query, child), trust, *pair(parent, child), unit(parent[5]))


def decoder_confidence(final, main, contradiction, weights, route_entropy) -> Column:
    """Decidedness, agreement of final and main value, no contradiction, sure mixture of four branches, sure route: their product."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    p = unit(col(final))
    w = F.transform(col(weights), lambda x: F.greatest(x, F.lit(EPS)))
    mixed = -F.aggregate(F.transform(w, lambda x: x * F.log(x)), F.lit(0.0), lambda s, x: s + x) / F.log(F.lit(4.0))
    return unit(2 * F.abs(p - 0.5)) * unit(1 - F.abs(p - col(main))) * (1 - unit(col(contradiction))) * (1 - unit(mixed)) * unit(1 - col(route_entropy))


def coverage_weight(coverage: Column | str, epoch: Column | str, target: float = 0.2, epochs: int = 3, weight: float = 2.0) -> Column:
    """Weight of the loss on hard targets: grows with their share up to ``target``, and over the first ``epochs``."""
    return weight * F.least(F.lit(1.0), col(epoch) / float(epochs)) * F.least(F.lit(1.0), col(coverage) / target)


def stage_mode(epoch: Column | str, parents: int = 6, full: int = 11) -> Column:
    return F.when(col(epoch) < parents, "off").when(col(epoch) < full, "parent_only").otherwise("full")


def injection_strength(epoch: Column | str, full: int = 11, epochs: int = 3) -> Column:
    """1/3, 2/3, 1 over the first epochs of the full mode; 1 where no epoch is given."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(epoch) - full + 1) / float(max(1, epochs)))), F.lit(1.0))


def parent_values(region: Column | str, sdf: Column | str, reliability: Column | str) -> Column:
    """The eight values of a parent row: one-hot region, foreground, background, distance, reliability. Regions 0 and 2 are foreground."""
    r = col(region)
    hot = [(r == i).cast("double") for i in range(4)]
    return F.array(*hot, hot[0] + hot[2], hot[1] + hot[3], col(sdf).cast("double"), col(reliability).cast("double"))
