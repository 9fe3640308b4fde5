"""Scalar functions over text, numbers, colours, maps, arrays and matrices; a matrix is an array of rows."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.functions import sessions


# --- text -----------------------------------------------------------------------------------


def text_format(pattern: str, *args: Column) -> Column:
    """``pattern`` with every {0}, {1}, … replaced."""
    out = F.lit(pattern)
    for k, a in enumerate(args):
        out = F.replace(out, F.lit(f"{{{k}}}"), a.cast("string"))
    return out


def text_match(x: Column, regex: str) -> Column:
    """The first group of the first match, the match itself if there is no group; empty if none."""
    return F.regexp_extract(x, regex, 1 if "(" in regex.replace("\\(", "").replace("(?:", "") else 0)


def text_split(x: Column, separator: str) -> Column:
    return F.split(x, f"\\Q{separator}\\E") if separator else F.array(x)


def number_text(x: Column, mode: str = "", mintick: float = 0.01) -> Column:
    """A number as text: by ticks, in percent, as a volume (K, M, B), or with six decimals; NaN if it is missing.

    Digits are those of the number's exact binary value, which the JVM's formats don't give.
    """
    places = tick_decimals(mintick)

    def one(v: float) -> str:
        if v != v:
            return "NaN"
        if mode == "mintick" and mintick > 0:
            return f"{math.copysign(math.floor(abs(v / mintick) + 0.5), v) * mintick:.{places}f}"
        if mode == "percent":
            return f"{v * 100:.2f}%"
        if mode == "volume":
            size, unit = next(((n, u) for n, u in ((1e9, "B"), (1e6, "M"), (1e3, "K")) if abs(v) >= n), (1.0, ""))
            return f"{'-' if v < 0 else ''}{abs(v) / size:.2f}{unit}"
        return f"{v:.6f}"

    @F.pandas_udf("string")
    def shown(values: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in values.astype(float).tolist()], dtype=object)

    return shown(x.cast("double"))


def tick_decimals(mintick: float) -> int:
    """Decimals that show a tick; 15 at most."""
    places, scaled = 0, mintick
    while scaled < 1 - 1e-10 and places < 15:
        scaled, places = scaled * 10, places + 1
    return places


def half_away(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def format_time(ts: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """``ts`` in a zone, by the marks yyyy MM dd HH mm ss; all else stays as it is."""
    marks = {"yyyy", "MM", "dd", "HH", "mm", "ss"}
    pieces = re.split("(yyyy|MM|dd|HH|mm|ss)", pattern)
    wall = sessions.local(ts, zone)
    return F.concat(*[F.date_format(wall, x) if x in marks else F.lit(x) for x in pieces if x])


# --- numbers and colours --------------------------------------------------------------------


def nz(x: Column, other: float = 0.0) -> Column:
    return F.coalesce(x, F.lit(other))


def to_tick(price: Column, tick: float) -> Column:
    return F.round(price / tick) * tick


def to_tick_against(price: Column, tick: float, buy: bool) -> Column:
    """Up to a tick for a buy, down for a sale; what is a tick already stays."""
    return (F.ceil(price / tick - 1e-9) if buy else F.floor(price / tick + 1e-9)) * tick


def to_lot(quantity: Column, step: float) -> Column:
    return F.floor(quantity / step + 1e-9) * step if step > 0 else quantity


def commission(kind: str, value: float, price: Column, quantity: Column, point_value: float = 1.0) -> Column:
    """Fee of a fill: a percentage, a sum for each order, or for each contract."""
    if kind == "percent":
        return price * quantity * point_value * value / 100
    return F.lit(float(value)) if kind == "order" else quantity * value


def argb(r: int, g: int, b: int, transparency: float = 0.0) -> int:
    return round(255 * (1 - transparency / 100)) << 24 | r << 16 | g << 8 | b


def channel(color: Column, name: str) -> Column:
    """r, g, b, or t, the transparency in percent."""
    byte = lambda n: F.shiftright(color, n).bitwiseAND(F.lit(255))
    return 100 * (1 - byte(24) / 255) if name == "t" else byte({"r": 16, "g": 8, "b": 0}[name])


LEVELS = ("p", "r1", "s1", "r2", "s2", "r3", "s3", "r4", "s4", "r5", "s5")


def pivot_levels(method: str, h: Column, low: Column, c: Column) -> Column:
    """struct(p, r1, s1, … r5, s5) of the range before, NULL where the method has no such level.

    Methods are Traditional, Fibonacci, Woodie, Classic, DM and Camarilla; of another name only p is known.
    """
    p, wide = (h + low + c) / 3, h - low
    steps: list[tuple[Column, Column]] = []
    if method == "Traditional":
        steps = [(2 * p - low, 2 * p - h), (p + wide, p - wide), (h + 2 * (p - low), low - 2 * (h - p)), (p + 3 * wide, p - 3 * wide), (p + 4 * wide, p - 4 * wide)]
    elif method == "Fibonacci":
        steps = [(p + k * wide, p - k * wide) for k in (0.382, 0.618, 1.0)]
    elif method in ("Woodie", "Classic"):
        p = (h + low + 2 * c) / 4 if method == "Woodie" else p
        steps = [(2 * p - low, 2 * p - h), *((p + k * wide, p - k * wide) for k in (1, 2, 3))]
    elif method == "DM":
        x = F.when(c == h, h + 2 * low + c).when(c == low, 2 * h + low + c).otherwise(h + low + 2 * c)
        p, steps = x / 4, [(x / 2 - low, x / 2 - h)]
    elif method == "Camarilla":
        top = F.try_divide(h, F.nullif(low, F.lit(0.0))) * c
        steps = [*((c + wide * 1.1 / k, c - wide * 1.1 / k) for k in (12, 6, 4, 2)), (top, c - (top - c))]
    found = [p, *(x for pair in steps for x in pair)]
    known = h.isNotNull() & low.isNotNull() & c.isNotNull()
    return F.struct(*[(F.when(known, found[k]) if k < len(found) else F.lit(None).cast("double")).alias(name) for k, name in enumerate(LEVELS)])


# --- maps -----------------------------------------------------------------------------------


MAP_CAP = 50_000


def _capped(m: Column) -> Column:
    return F.when(F.size(m) > MAP_CAP, F.raise_error(F.lit(f"a map holds at most {MAP_CAP} pairs"))).otherwise(m)


def map_put(m: Column, k: Column, v: Column) -> Column:
    """``m`` with k: v; a key that is there keeps its place, a new one comes last. ``map_get`` before it tells the previous value."""
    fresh = F.map_concat(m, F.create_map(k, v))
    return F.when(F.map_contains_key(m, k), F.transform_values(m, lambda a, b: F.when(a == k, v).otherwise(b))).otherwise(_capped(fresh))


def map_put_all(m: Column, more: Column) -> Column:
    """All pairs of ``more`` put one after another; nothing is put if the map would grow too large."""
    kept = F.transform_values(m, lambda a, b: F.when(F.map_contains_key(more, a), F.try_element_at(more, a)).otherwise(b))
    return _capped(F.map_concat(kept, F.map_filter(more, lambda a, _: ~F.map_contains_key(m, a))))


def map_get(m: Column, k: Column) -> Column:
    """The value of a key, NULL if it isn't there."""
    return F.try_element_at(m, k)


def map_remove(m: Column, k: Column) -> Column:
    """``m`` without a key; ``map_get`` before it tells what goes."""
    return F.map_filter(m, lambda a, _: a != k)


def map_contains(m: Column, k: Column) -> Column:
    return F.map_contains_key(m, k)


def map_keys(m: Column) -> Column:
    """Keys in the order in which they were first put."""
    return F.map_keys(m)


def map_values(m: Column) -> Column:
    return F.map_values(m)


def map_clear(m: Column) -> Column:
    return F.map_filter(m, lambda _, __: F.lit(False))


# --- colours, names and errors --------------------------------------------------------------


def enum_text(names: list[str], index: Column) -> Column:
    """The name at an index, held within the list; empty if there is none."""
    if not names:
        return F.lit("")
    return F.element_at(F.array(*map(F.lit, names)), F.greatest(F.least(index, F.lit(len(names) - 1)), F.lit(0)) + 1)


def runtime_error(condition: Column, message: str, value: Column) -> Column:
    """``value``, but an error that stops the query where ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def with_transparency(color: Column, percent: float) -> Column:
    """A packed colour at another transparency."""
    return color.bitwiseAND(F.lit(0xFFFFFF)).bitwiseOR(F.lit(round(255 * (1 - percent / 100)) << 24))


# --- matrices -------------------------------------------------------------------------------


def matrix(rows: int, columns: int, value: Column) -> Column:
    return F.array_repeat(F.array_repeat(value, columns), rows)


def matrix_row(m: Column, i: int) -> Column:
    return F.element_at(m, i + 1)


def matrix_column(m: Column, j: int) -> Column:
    return F.transform(m, lambda r: F.element_at(r, j + 1))


def matrix_transpose(m: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(m[0])), lambda j: F.transform(m, lambda r: F.element_at(r, j)))


def matrix_reverse(m: Column) -> Column:
    return F.reverse(F.transform(m, F.reverse))


def matrix_submatrix(m: Column, r0: int, r1: int, c0: int, c1: int) -> Column:
    """Rows [r0, r1) and columns [c0, c1)."""
    return F.transform(F.slice(m, r0 + 1, r1 - r0), lambda r: F.slice(r, c0 + 1, c1 - c0))


def matrix_reshape(m: Column, rows: int, columns: int) -> Column:
    flat = F.flatten(m)
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(flat, i * columns + 1, columns))


def matrix_concat(a: Column, b: Column, beside: bool) -> Column:
    return F.zip_with(a, b, lambda x, y: F.concat(x, y)) if beside else F.concat(a, b)


def matrix_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u - v))


def matrix_sum(m: Column) -> Column:
    return F.aggregate(F.flatten(m), F.lit(0.0), lambda s, x: s + x)


def matrix_mult(a: Column, b: Column) -> Column:
    turned = matrix_transpose(b)
    return F.transform(a, lambda r: F.transform(turned, lambda c: F.aggregate(F.zip_with(r, c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))


def matrix_trace(m: Column) -> Column:
    return F.aggregate(F.transform(m, lambda r, i: F.element_at(r, i + 1)), F.lit(0.0), lambda s, x: s + x)


def matrix_sort(m: Column, column: int, rising: bool = True) -> Column:
    keyed = F.transform(m, lambda r, i: F.struct(F.element_at(r, column + 1).alias("k"), i.alias("i"), r.alias("r")))
    rows = F.transform(F.array_sort(keyed), lambda x: x["r"])
    return rows if rising else F.reverse(rows)


def matrix_set(m: Column, i: int, j: int, value: Column) -> Column:
    """``m`` with one cell replaced; cells are numbered from 0."""
    return F.transform(m, lambda r, a: F.transform(r, lambda x, b: F.when((a == i) & (b == j), value).otherwise(x)))


def matrix_fill(m: Column, value: Column) -> Column:
    return F.transform(m, lambda r: F.transform(r, lambda _: value))


def matrix_add_row(m: Column, i: int, row: Column) -> Column:
    return F.array_insert(m, i + 1, row)


def matrix_add_column(m: Column, j: int, column: Column) -> Column:
    return F.zip_with(m, column, lambda r, x: F.array_insert(r, j + 1, x))


def matrix_remove_row(m: Column, i: int) -> Column:
    return F.filter(m, lambda _, a: a != i)


def matrix_remove_column(m: Column, j: int) -> Column:
    return F.transform(m, lambda r: F.filter(r, lambda _, b: b != j))


def _swapped(cells: Column, i: int, j: int) -> Column:
    return F.transform(cells, lambda x, a: F.when(a == i, F.element_at(cells, j + 1)).when(a == j, F.element_at(cells, i + 1)).otherwise(x))


def matrix_swap_rows(m: Column, i: int, j: int) -> Column:
    return _swapped(m, i, j)


def matrix_swap_columns(m: Column, i: int, j: int) -> Column:
    return F.transform(m, lambda r: _swapped(r, i, j))


def matrix_count(m: Column) -> Column:
    return F.size(F.flatten(m))


def matrix_avg(m: Column) -> Column:
    """Mean of all cells; NULL for a matrix without cells."""
    return matrix_sum(m) / F.nullif(matrix_count(m), F.lit(0))


def matrix_min(m: Column) -> Column:
    return F.array_min(F.flatten(m))


def matrix_max(m: Column) -> Column:
    return F.array_max(F.flatten(m))


def matrix_mode(m: Column) -> Column:
    """The commonest cell, of several the smallest; 0 for a matrix without cells."""
    cells = F.flatten(m)
    counted = F.transform(F.array_distinct(cells), lambda x: F.struct((-F.size(F.filter(cells, lambda y: y == x))).alias("n"), x.alias("x")))
    return F.coalesce(F.array_min(counted)["x"], F.lit(0.0))


def matrix_kron(a: Column, b: Column) -> Column:
    """Kronecker product: every cell of ``a`` times the whole of ``b``."""
    return F.flatten(F.transform(a, lambda r: F.transform(b, lambda q: F.flatten(F.transform(r, lambda x: F.transform(q, lambda y: x * y))))))


def matrix_is(m: Column, what: str) -> Column:
    """square, symmetric, diagonal, identity, zero, binary, triangular (upper or lower), stochastic."""
    cells = lambda ok: F.forall(F.transform(m, lambda r, i: F.forall(F.transform(r, lambda x, j: ok(x, i, j)), lambda b: b)), lambda b: b)
    square = F.forall(m, lambda r: F.size(r) == F.size(m))
    near = lambda x, y: F.abs(x - y) < 1e-10
    tests = {
        "square": lambda: square,
        "symmetric": lambda: square & cells(lambda x, i, j: near(x, F.element_at(F.element_at(m, j + 1), i + 1))),
        "antisymmetric": lambda: square & cells(lambda x, i, j: near(x, -F.element_at(F.element_at(m, j + 1), i + 1))),
        "diagonal": lambda: square & cells(lambda x, i, j: (i == j) | near(x, F.lit(0.0))),
        "antidiagonal": lambda: square & cells(lambda x, i, j: (i + j == F.size(m) - 1) | near(x, F.lit(0.0))),
        "identity": lambda: square & cells(lambda x, i, j: near(x, F.when(i == j, 1.0).otherwise(0.0))),
        "zero": lambda: cells(lambda x, i, j: near(x, F.lit(0.0))),
        "binary": lambda: cells(lambda x, i, j: near(x, F.lit(0.0)) | near(x, F.lit(1.0))),
        "triangular": lambda: square & (cells(lambda x, i, j: (i <= j) | near(x, F.lit(0.0))) | cells(lambda x, i, j: (i >= j) | near(x, F.lit(0.0)))),
        "stochastic": lambda: F.forall(m, lambda r: near(F.aggregate(r, F.lit(0.0), lambda s, x: s + x), F.lit(1.0)) & F.forall(r, lambda x: x >= 0)),
    }
    return tests[what]()


def _linear(fn, kind: T.DataType):  # noqa: ANN001, ANN202
    """A pandas UDF that applies ``fn`` to stacks of matrices of one shape, NULL where it can't or a matrix is none."""

    @F.pandas_udf(kind)
    def run(matrices: pd.Series) -> pd.Series:
        shapes: dict[tuple[int, ...], list[int]] = {}
        arrays: dict[int, np.ndarray] = {}
        for k, m in enumerate(matrices):
            if m is not None and len({len(r) for r in m}) <= 1:
                arrays[k] = np.array([list(r) for r in m], dtype=float).reshape(len(m), -1 if len(m) else 0)
                shapes.setdefault(arrays[k].shape, []).append(k)
        out: list = [None] * len(matrices)
        for rows in shapes.values():
            for k, value in zip(rows, _stacked(fn, np.stack([arrays[k] for k in rows]))):
                out[k] = value
        return pd.Series(out, dtype=object)

    return run


def _stacked(fn, stack: np.ndarray) -> list:  # noqa: ANN001
    """``fn`` of a whole stack; one by one if some matrix in it has no result."""
    try:
        return list(fn(stack))
    except (np.linalg.LinAlgError, ValueError):
        if len(stack) == 1:
            return [None]
        return [x for m in stack for x in _stacked(fn, m[None])]


def _square(m: np.ndarray) -> bool:
    return m.shape[-1] == m.shape[-2] and bool(np.isfinite(m).all())


def _powers(m: np.ndarray, n: int) -> list:
    if m.shape[-1] != m.shape[-2]:
        return [[]] * len(m)
    fine = np.isfinite(m).all(axis=(1, 2))
    found = np.linalg.matrix_power(np.where(fine[:, None, None], m, 0.0), max(0, n))
    return [x if ok else [] for x, ok in zip(found.tolist(), fine)]


def _vectors(m: np.ndarray) -> list:
    """Real parts of unit eigenvectors, as columns."""
    return [[] if not _square(x) else (np.linalg.eigh(x)[1] if np.allclose(x, x.T, rtol=0, atol=1e-10) else np.linalg.eig(x)[1].real).tolist() for x in m]


_MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
matrix_det = _linear(lambda m: [None] * len(m) if m.shape[-1] != m.shape[-2] else np.linalg.det(m).tolist(), T.DoubleType())
matrix_rank = _linear(lambda m: np.linalg.matrix_rank(m).astype(int).tolist(), T.IntegerType())
matrix_inv = _linear(lambda m: np.linalg.inv(m).tolist(), _MATRIX)
matrix_pinv = _linear(lambda m: np.linalg.pinv(m).tolist(), _MATRIX)
matrix_eigenvalues = _linear(lambda m: np.sort(np.linalg.eigvals(m).real, axis=-1)[:, ::-1].tolist(), T.ArrayType(T.DoubleType()))


def matrix_pow(m: Column, n: int) -> Column:
    """``m`` multiplied by itself; the identity for n < 1, no rows unless it is square and finite."""
    return _linear(lambda x: _powers(x, n), _MATRIX)(m)


#: Unit eigenvectors as columns (real parts), ascending for symmetric matrices; no rows unless the matrix is square and finite.
matrix_eigenvectors = _linear(_vectors, _MATRIX)


def matrix_rows(m: Column) -> Column:
    return F.size(m)


def matrix_columns(m: Column) -> Column:
    return F.when(F.size(m) == 0, 0).otherwise(F.size(F.try_element_at(m, F.lit(1))))
