"""Column builders over arrays of numbers; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def let(a: Column | str, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once: lambdas would compute an expression at every use."""
    return F.transform(F.array(col(a)), f)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where a vector has length zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column | str, zero: str = "zero") -> Column:
    """Unit vector; a zero vector stays zero, or raises with ``zero='error'``."""
    bad = F.transform(col(a), lambda x: F.lit(0.0)) if zero == "zero" else F.raise_error(F.lit("vector of length zero"))
    return let(norm(a), lambda n: F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(bad))


def finite_or_zero(x: Column | str) -> Column:
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def unit_interval(x: Column | str) -> Column:
    """NaN and -inf become 0, +inf 1, the rest is clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(col(x).cast("double"), F.lit(0.0))))


def normalize_probabilities(a: Column | str, eps: float = EPS) -> Column:
    """Non-negative parts over their sum; all zero stays zero."""
    pos = F.transform(col(a), lambda x: F.greatest(F.lit(0.0), finite_or_zero(x)))
    share = lambda p, s: F.when(s > eps, F.transform(p, lambda x: x / s)).otherwise(F.transform(p, lambda x: F.lit(0.0)))
    return let(pos, lambda p: let(total(p), lambda s: share(p, s)))


def entropy(p: Column | str, eps: float = EPS) -> Column:
    """Normalized to 0..1 by the logarithm of the length."""
    p = col(p)
    h = -total(F.transform(p, lambda x: x * F.log(F.greatest(x, F.lit(eps)))))
    return h / F.log(F.greatest(F.lit(2), F.size(p)).cast("double"))


def js_divergence(p: Column | str, q: Column | str, eps: float = EPS) -> Column:
    """Jensen-Shannon divergence of two probability arrays, in units of ln 2."""
    p, q = col(p), col(q)
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    kl = lambda a: total(F.zip_with(a, m, lambda x, y: x * (F.log(F.greatest(x, F.lit(eps))) - F.log(F.greatest(y, F.lit(eps))))))
    return (kl(p) + kl(q)) / 2 / F.log(F.lit(2.0))


def softmax(a: Column | str, temperature: float = 1.0) -> Column:
    """Of an array of numbers; an empty array stays empty."""
    e = lambda a, top: F.transform(a, lambda x: F.exp((x - top) / temperature))
    return let(col(a), lambda v: let(e(v, F.array_max(v)), lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s))))


def one_hot(index: Column | str, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == col(index)).cast("double"))


def mean_of(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") + y) / 2)


def mixture(base: Column, branches: list[Column], weights: Column) -> Column:
    """Convex mixture in delta form: base plus the weighted differences of the branches to it."""
    out = base
    for i, b in enumerate(branches):
        out = out + weights[i] * (b - base)
    return out


# Grids: arrays in row-major order.


def grid_map(a: Column | str, h: int, w: int, f: Callable[[Callable[[int, int], Column], Column, Column], Column]) -> Column:
    """New value of every cell from ``at(dy, dx)``, its replicated neighbours, and its row and column."""

    def cells(v: Column) -> Column:
        def cell(i: Column) -> Column:
            y, x = F.floor(i / w).cast("int"), F.pmod(i, F.lit(w))

            def at(dy: int, dx: int) -> Column:
                yy = F.greatest(F.lit(0), F.least(F.lit(h - 1), y + dy)) if dy else y
                xx = F.greatest(F.lit(0), F.least(F.lit(w - 1), x + dx)) if dx else x
                return F.get(v, (yy * w + xx).cast("int")).cast("double")

            return f(at, y, x)

        return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), cell)

    return let(a, cells)


def sobel(a: Column | str, h: int, w: int, scale: float = 1 / 8, clear_border: bool = False) -> Column:
    """Gradient magnitude by the 3 x 3 Sobel kernels with replicated edges."""

    def f(at, y, x):
        # differences first, so that a constant map has a gradient of exactly zero
        gx = ((at(-1, 1) - at(-1, -1)) + 2 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1))) * scale
        gy = ((at(1, -1) - at(-1, -1)) + 2 * (at(1, 0) - at(-1, 0)) + (at(1, 1) - at(-1, 1))) * scale
        g = F.hypot(gx, gy)
        return F.when((y == 0) | (x == 0) | (y == h - 1) | (x == w - 1), 0.0).otherwise(g) if clear_border else g

    return grid_map(a, h, w, f)


def forward_difference(a: Column | str, h: int, w: int) -> Column:
    """|dx| + |dy| to the next cell, zero at the end of a row or column."""
    return grid_map(a, h, w, lambda at, y, x: F.abs(at(0, 1) - at(0, 0)) + F.abs(at(1, 0) - at(0, 0)))


def dilate(a: Column | str, h: int, w: int, r: int = 1) -> Column:
    return grid_map(a, h, w, lambda at, y, x: F.greatest(*(at(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1))))


def erode(a: Column | str, h: int, w: int, r: int = 1) -> Column:
    return grid_map(a, h, w, lambda at, y, x: F.least(*(at(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1))))


def box_average(a: Column | str, h: int, w: int, r: int) -> Column:
    """Mean over a (2r + 1) squared box with zeros outside; the divisor is fixed."""
    k = float((2 * r + 1) ** 2)

    def cells(v: Column) -> Column:
        def cell(i: Column) -> Column:
            y, x = F.floor(i / w).cast("int"), F.pmod(i, F.lit(w))
            rows = F.sequence(F.greatest(F.lit(0), y - r), F.least(F.lit(h - 1), y + r))
            x0, x1 = F.greatest(F.lit(0), x - r), F.least(F.lit(w - 1), x + r)
            part = lambda yy: F.slice(v, (yy * w + x0 + 1).cast("int"), (x1 - x0 + 1).cast("int"))
            return F.aggregate(rows, F.lit(0.0), lambda s, yy: s + F.aggregate(part(yy), F.lit(0.0), lambda t, z: t + z)) / k

        return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), cell)

    return let(a, cells)


def flip_rows(a: Column | str, h: int, w: int) -> Column:
    """Each row of the grid reversed: the second view, aligned again."""
    there = lambda i: (F.floor(i / w) * w + (w - 1 - F.pmod(i, F.lit(w)))).cast("int")
    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.get(v, there(i))))


def resize_nearest(a: Column | str, h: int, w: int, to_h: int, to_w: int) -> Column:

    def cell(v: Column, i: Column) -> Column:
        y, x = F.floor(i / to_w), F.pmod(i, F.lit(to_w))
        return F.get(v, (F.floor(y * h / to_h) * w + F.floor(x * w / to_w)).cast("int"))

    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), lambda i: cell(v, i)))


def resize_area(a: Column | str, h: int, w: int, fy: int, fx: int) -> Column:
    """Mean over blocks of fy x fx cells; h and w must be multiples."""
    ww = w // fx

    def cell(a: Column, i: Column) -> Column:
        y, x = F.floor(i / ww).cast("int"), F.pmod(i, F.lit(ww))
        return F.aggregate(F.sequence(F.lit(0), F.lit(fy - 1)), F.lit(0.0), lambda s, r: s + F.aggregate(F.slice(a, ((y * fy + r) * w + x * fx + 1).cast("int"), F.lit(fx)), F.lit(0.0), lambda t, v: t + v)) / (fy * fx)

    return let(a, lambda v: F.transform(F.sequence(F.lit(0), F.lit((h // fy) * ww - 1)), lambda i: cell(v, i)))


def scale_index(i: Column | str, h: int, w: int, to_h: int, to_w: int) -> Column:
    """The cell of another resolution that a flat index falls into."""
    i = col(i)
    return (F.floor(F.floor(i / w) * to_h / h) * to_w + F.floor(F.pmod(i, F.lit(w)) * to_w / w)).cast("int")


def to_grid(a: Column | str, h: int, w: int) -> Column:
    """A row-major array as an array of rows."""
    return F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda y: F.slice(col(a), y * w + 1, F.lit(w)))


def from_grid(rows: Column | str) -> Column:
    return F.flatten(col(rows))
