"""Cell and force geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vec import norm, total


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _determinant(a: Column) -> Column:
    return (
        a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
        - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
        + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    )


def determinant(cell: Column) -> Column:
    return bound(cell, _determinant)


def _inverse(a: Column) -> Column:
    def minor(r: int, c: int) -> Column:
        rows, cols = [x for x in range(3) if x != c], [x for x in range(3) if x != r]
        sign = 1 if (r + c) % 2 == 0 else -1
        return sign * (a[rows[0]][cols[0]] * a[rows[1]][cols[1]] - a[rows[0]][cols[1]] * a[rows[1]][cols[0]])

    adjugate = F.array(*[F.array(*[minor(r, c) for c in range(3)]) for r in range(3)])
    return bound(_determinant(a), lambda d: F.when(
        d != 0, F.transform(adjugate, lambda row: F.transform(row, lambda x: x / d))))


def inverse(cell: Column) -> Column:
    """Null where singular."""
    return bound(cell, _inverse)


def _times(point: Column, m: Column) -> Column:
    return F.array(*[point[0] * m[0][c] + point[1] * m[1][c] + point[2] * m[2][c] for c in range(3)])


def times(point: Column, m: Column) -> Column:
    """Row vector times 3x3 matrix."""
    return bound(m, lambda b: bound(point, lambda p: _times(p, b)))


def _moved(point: Column, cell: Column, pbc: Column, step) -> Column:
    """The point less ``step`` whole cells along periodic axes."""
    inside = F.zip_with(times(point, inverse(cell)), pbc, lambda x, repeats: F.when(repeats, x - step(x)).otherwise(x))
    return times(inside, cell)


def wrapped(point: Column, cell: Column, pbc: Column) -> Column:
    """The point moved into the cell along periodic axes."""
    return _moved(point, cell, pbc, F.floor)


def minimum_image(gap: Column, cell: Column, pbc: Column) -> Column:
    """A displacement reduced by whole cells; halves round to even."""
    return _moved(gap, cell, pbc, F.rint)


def cell_parameters(cell: Column) -> Column:
    """``struct<a, b, c, alpha, beta, gamma>`` with angles in degrees."""
    return bound(cell, _cell_parameters)


def _cell_parameters(cell: Column) -> Column:
    lengths = [norm(cell[k]) for k in range(3)]

    def angle(x: int, y: int) -> Column:
        product = total(F.zip_with(cell[x], cell[y], lambda p, q: p * q))
        size = F.greatest(lengths[x] * lengths[y], F.lit(1e-15))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), product / size))))

    return F.struct(
        lengths[0].alias("a"), lengths[1].alias("b"), lengths[2].alias("c"),
        angle(1, 2).alias("alpha"), angle(0, 2).alias("beta"), angle(0, 1).alias("gamma"))


def image_limits(cell: Column, cutoff: float, pbc: Column, per_axis: int = 8, in_total: int = 1024) -> Column:
    """Images needed per axis for a cutoff; null means the cell is too narrow."""

    def needed(inv: Column) -> Column:
        return F.array(*[
            F.when(pbc[k], (F.ceil(F.lit(cutoff) * F.sqrt(sum(inv[r][k] * inv[r][k] for r in range(3)))) + 1).cast("int")).otherwise(0)
            for k in range(3)])

    def checked(axis: Column) -> Column:
        count = F.aggregate(axis, F.lit(1), lambda n, x: n * (2 * x + 1))
        return F.when((F.array_max(axis) <= per_axis) & (count <= in_total), axis)

    return bound(bound(inverse(cell), needed), checked)


def magnitudes(forces: Column) -> Column:
    return F.transform(forces, norm)


def net_force(forces: Column) -> Column:
    zero = F.array(*[F.lit(0.0)] * 3)
    return norm(F.aggregate(forces, zero, lambda acc, f: F.zip_with(acc, f, lambda x, y: x + y)))


def periodic_axes(pbc: Column) -> Column:
    text = F.concat(*[F.when(pbc[k], axis).otherwise("") for k, axis in enumerate("XYZ")])
    return F.when(text == "", "—").otherwise(text)
