"""Several narrow blocks in one job: cross moments, and the exact sweep solved on them.

Coordinate descent over a run of blocks needs, for each feature i in turn, ``Σh²`` and
``Σeh`` *after* the features before it were changed.  Those sums are polynomials in
what the run changes, so one aggregation of the rows gives all of them.

Write a row as ``z = (1, r, x_1, ..)``: ``r`` is the part of ``q = Σ v x`` that comes from
outside the run, ``x_b`` the value of a block whose values vary.  Rows that hold the
same ids in the run form a *cell*; a block whose value is one constant c is part of the
cell.  Within a cell

    h_b = s_b (w·z)      s_b = c or x_b;  w = (Σ c u of the other constant blocks, 1, u_a ..)

with the current values u (for the linear terms ``h_b = s_b``, so ``w = (1)``), and the
error is ``e + z'Kz`` with a matrix K that starts at 0 and grows by ``Δ s_b (w·z)`` at
each change.  So the sums of the monomials of z up to degree four (two for the linear
terms), and of e times those up to degree two, are enough.  They are combined on the
map side and collected: at most ``fmlattice.gramCells`` cells, which ``runs`` makes sure
of by the widths of the blocks, whatever the number of rows.  The sweep is then the
sequential one, vectorised over cells, on the driver; the rows are changed by one
projection with the old and new values as array literals.

Side tables take part by weighted records: a side row stands for its facts, with the
sums of 1, r, r², e, er over them in place of those products (``Moments``).
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectorize import Block

# blocks of varying values in one run: the monomials grow with their number
MAX_VARYING = 2
# a sum of squares below this share of its parts is rounding: h is 0 on every row
ROUNDING = 1e-13


def runs(blocks: list[Block], constants: list[float | None], literal_rows: int, cells: int) -> list[list[int]]:
    """Consecutive blocks whose cells are within the bound; a wide block is a run of its own."""
    out: list[list[int]] = []
    open_, product, varying = False, 1, 0
    for j, b in enumerate(blocks):
        wide = b.size > literal_rows
        ids = 1 if b.size == 1 and constants[j] is None else b.size + 1
        varies = constants[j] is None
        if open_ and not wide and product * ids <= cells and varying + varies <= MAX_VARYING:
            out[-1].append(j)
            product, varying = product * ids, varying + varies
        else:
            out.append([j])
            open_, product, varying = not wide, ids, int(varies)
    return out


@dataclass
class Moments:
    """Per record: the sums of 1, r, r² and of e, er over the rows it stands for."""
    ones: Column
    r: Column | None
    rr: Column | None
    e: Column
    er: Column | None


def row_moments(r: Column | None) -> Moments:
    """A record is one row of error ``e``."""
    e = F.col("e")
    return Moments(F.lit(1.0), r, None if r is None else r * r, e, None if r is None else e * r)


@dataclass
class Run:
    """Blocks of a frame (block j in columns ``l{at[j]}``, ``x{at[j]}``), the constant
    value of each (None: it varies) and the old values of their ids."""
    blocks: list[Block]
    constants: list[float | None]
    thetas: list[list[float]]
    at: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.at = self.at or list(range(len(self.blocks)))
        self.varying = [j for j, c in enumerate(self.constants) if c is None]
        self.keyed = [j for j, b in enumerate(self.blocks) if self.constants[j] is not None or b.size > 1]


def array_literal(values: list, dtype: str = "double") -> Column:
    """A constant array (one JSON string, folded by the optimizer); as an object it
    leaves the generated code, and so its compiled form, the same for other values."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{dtype}>")


def number_literal(value: float) -> Column:
    return F.element_at(array_literal([value]), 1)


def times(run: Run, values: list[float], j: int) -> Column:
    """``x · value of the row's id`` in block j (0 where the row has none)."""
    at = run.at[j]
    v = (number_literal(values[0]) if run.blocks[j].size == 1 else
         F.element_at(array_literal(values), F.col(f"l{at}") + F.lit(1)))
    return F.coalesce(F.col(f"x{at}") * v, F.lit(0.0))


def outside(run: Run, q: Column) -> Column:
    """``q`` without the run's own part."""
    for j in range(len(run.blocks)):
        q = q - times(run, run.thetas[j], j)
    return q


def exponents(n_varying: int, factor: bool) -> tuple[list[tuple], list[tuple]]:
    """Exponents (of r, x_1, ..) of the monomials that are summed, alone and times e."""
    most, e_most, r_most = (4, 2, 2) if factor else (2, 1, 0)
    every = [t for t in itertools.product(range(r_most + 1), *[range(most + 1)] * n_varying) if sum(t) <= most]
    return every, [t for t in every if sum(t) <= e_most and t[0] <= 1]


def cell_sums(frame: DataFrame, run: Run, factor: bool, moments: Moments) -> DataFrame:
    """``l*`` of the keyed blocks and the sums ``m*``, ``n*`` of each cell."""
    plain, with_e = exponents(len(run.varying), factor)
    of_r, of_e = (moments.ones, moments.r, moments.rr), (moments.e, moments.er)

    def powers(t: tuple) -> Column | None:
        out = None
        for a, n in enumerate(t[1:]):
            for _ in range(n):
                x = F.coalesce(F.col(f"x{run.at[run.varying[a]]}"), F.lit(0.0))
                out = x if out is None else out * x
        return out

    def product(first: Column, t: tuple) -> Column:
        p = powers(t)
        return first if p is None else first * p

    sums = [F.sum(product(of_r[t[0]], t)).alias(f"m{i}") for i, t in enumerate(plain)]
    sums += [F.sum(product(of_e[t[0]], t)).alias(f"n{i}") for i, t in enumerate(with_e)]
    return frame.groupBy(*[f"l{run.at[j]}" for j in run.keyed]).agg(*sums)


@dataclass
class Cells:
    """Collected cells: ids of each block (-1: none) and the sums by exponents."""
    ids: list[np.ndarray]
    plain: dict[tuple, np.ndarray]
    with_e: dict[tuple, np.ndarray]


def collected(sums: DataFrame, run: Run, factor: bool) -> Cells:
    t = sums.toArrow()
    plain, with_e = exponents(len(run.varying), factor)

    def numbers(name: str) -> np.ndarray:
        return t.column(name).fill_null(0.0).to_numpy()

    ids = [t.column(f"l{run.at[j]}").fill_null(-1).to_numpy().astype(np.int64) if j in run.keyed else np.zeros(t.num_rows, np.int64)
           for j in range(len(run.blocks))]
    return Cells(ids, {x: numbers(f"m{i}") for i, x in enumerate(plain)}, {x: numbers(f"n{i}") for i, x in enumerate(with_e)})


def solve(run: Run, cells: Cells, reg: float | list[list[float]], factor: bool) -> list[list[float]]:
    """The blocks' new values: block after block, each on the sums as the ones before it
    left them.  ``reg``: one strength, or each block's by id."""
    strengths = [np.array(r, float) for r in reg] if isinstance(reg, list) else [float(reg)] * len(run.blocks)
    m, n_cells = len(run.varying), len(cells.ids[0])
    place = {j: 2 + a for a, j in enumerate(run.varying)}       # index in z = (1, r, x ..)

    def exponent(*z: int) -> tuple:
        out = [0] * (1 + m)
        for i in z:
            if i:
                out[i - 1] += 1
        return tuple(out)

    def of(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, values[np.maximum(ids, 0)], 0.0)

    thetas = [np.array(t, float) for t in run.thetas]
    now = [of(t, i) for t, i in zip(thetas, cells.ids)]         # each cell's current values
    error: dict[tuple[int, int], np.ndarray] = {}               # K
    for j, block in enumerate(run.blocks):
        c, ids = run.constants[j], cells.ids[j]
        s, scale = ((place[j],), 1.0) if c is None else ((), c)
        if factor:
            rest = np.zeros(n_cells)
            for a, other in enumerate(run.constants):
                if other is not None and a != j:
                    rest = rest + other * now[a]
            w = {0: rest, 1: np.ones(n_cells)} | {place[a]: now[a] for a in run.varying if a != j}
        else:
            w = {0: np.ones(n_cells)}
        hh, size, eh = np.zeros(n_cells), np.zeros(n_cells), np.zeros(n_cells)
        for i, k in itertools.product(w, w):
            part = w[i] * w[k] * cells.plain[exponent(*s, *s, i, k)]
            hh, size = hh + part, size + np.abs(part)
        for i in w:
            eh = eh + w[i] * cells.with_e[exponent(*s, i)]
            for (a, b), coefficient in error.items():
                eh = eh + coefficient * w[i] * cells.plain[exponent(*s, i, a, b)]
        held = ids >= 0
        sums = [np.bincount(ids[held], v[held], block.size) for v in (hh * scale * scale, size * scale * scale, eh * scale)]
        seen = np.bincount(ids[held], minlength=block.size) > 0
        none = sums[0] <= ROUNDING * sums[1]
        s_hh, s_eh = np.where(none, 0.0, sums[0]), np.where(none, 0.0, sums[2])
        with np.errstate(all="ignore"):
            new = -(s_eh - thetas[j] * s_hh) / (strengths[j] + s_hh)
        new = np.where(seen & (strengths[j] + s_hh != 0) & np.isfinite(new), new, thetas[j])
        change = of(new - thetas[j], ids) * scale
        for i in w:
            pair = tuple(sorted((s[0] if s else 0, i)))
            error[pair] = error.get(pair, 0.0) + change * w[i]
        thetas[j], now[j] = new, of(new, ids)
    return [t.tolist() for t in thetas]


def changed_rows(frame: DataFrame, run: Run, new: list[list[float]], factor: bool, q: str = "q") -> DataFrame:
    """The rows after the run's changes in order: ``e += h·Δ`` and, for a factor, ``q += x·Δ``."""
    moved = [j for j in range(len(run.blocks)) if new[j] != run.thetas[j]]
    if not moved:
        return frame
    columns = frame.columns
    deltas = {f"_d{j}": times(run, [b - a for a, b in zip(run.thetas[j], new[j])], j) for j in moved}
    olds = {f"_t{j}": times(run, run.thetas[j], j) for j in moved} if factor else {}
    e, qs = F.col("e"), F.col(q) if factor else None
    for j in moved:
        d = F.col(f"_d{j}")
        if factor:
            e = e + d * (qs - F.col(f"_t{j}"))
            qs = qs + d
        else:
            e = e + d
    changed = {"e": e.alias("e")} | ({q: qs.alias(q)} if factor else {})
    return frame.withColumns(deltas | olds).select(*[changed.get(c, c) for c in columns])
