"""A whole parameter family in one step: simultaneous changes, scaled by a line search.

Coordinate descent needs as many dependent steps as blocks; a vocabulary whose ids meet
in every combination has very many.  Here all features of a family are moved at once
along the direction of their single updates, ``d_i = θ_i' − θ_i``, by a step ``t`` that is
the exact minimum of the family's objective ``Σe² + reg Σθ²`` on that line.  On the line a
row's prediction changes by ``αt + βt²``:

    w:   α = Σ x d                           β = 0
    v_f: α = q·Σ x d − Σ v d x²              β = ½ ((Σ x d)² − Σ d² x²)

so the objective is a polynomial of degree four in t with coefficients that are sums over
the rows; its minimum is found from five numbers.  ``t = 0`` is on the line, so the
objective never rises.  Two aggregations a family, whatever the number of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast
from . import als as A
from .model import FMConfig


def direction(entries: DataFrame, params: DataFrame, slot: str, reg: float, dimension: int) -> DataFrame:
    """``feature_id, theta, delta`` of all features that some row holds.  ``entries``:
    ``feature_id, value, e`` (and ``q``).  Sums that need no old value are combined before
    the shuffle and joined to one row per feature."""
    e, x, factor = F.col("e"), F.col("value"), slot != "w"
    q = F.col("q") if factor else None
    sums = ({"s_xx": x * x, "s_ex": e * x} if not factor else
            {"s_hh": x * x * q * q, "s_xq": x * x * x * q, "s_x4": x * x * x * x, "s_eq": e * x * q, "s_exx": e * x * x})
    st = entries.groupBy("feature_id").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    theta = params.select("feature_id", F.col(slot).alias("theta"))
    stats = A.stats_of_sums(st.join(maybe_broadcast(theta, dimension, extra_bytes=16 * dimension), "feature_id", "left"), factor)
    return A.theta_update(stats, reg).select("feature_id", "theta", "delta")


def row_changes(entries: DataFrame, moves: DataFrame, factor: bool, dimension: int) -> DataFrame:
    """``row_id, a, b, g`` of the rows that hold a moved feature: the prediction's change is
    ``at + bt²``, that of q is ``gt``."""
    x, d, v = F.col("value"), F.col("delta"), F.col("theta")
    j = entries.join(maybe_broadcast(moves, dimension, extra_bytes=24 * dimension), "feature_id")
    sums = j.groupBy("row_id").agg(F.sum(x * d).alias("g"), F.sum(v * d * x * x).alias("vd"), F.sum(d * d * x * x).alias("dd"),
                                   *([F.first("q").alias("q")] if factor else []))
    if not factor:
        return sums.select("row_id", F.col("g").alias("a"), F.lit(0.0).alias("b"), "g")
    g = F.col("g")
    return sums.select("row_id", (F.col("q") * g - F.col("vd")).alias("a"), (F.lit(0.5) * (g * g - F.col("dd"))).alias("b"), "g")


def coefficients(errors: DataFrame, changes: DataFrame) -> list[float]:
    """Of ``Σ (e + at + bt²)²`` the coefficients of t, t², t³, t⁴ (the constant is left out)."""
    j = A.placed_join(errors, changes)
    e, a, b = F.col("e"), F.col("a"), F.col("b")
    r = j.agg(F.sum(F.lit(2.0) * e * a), F.sum(a * a + F.lit(2.0) * e * b), F.sum(F.lit(2.0) * a * b), F.sum(b * b)).first()
    return [float(x or 0.0) for x in r]


def best_step(c: list[float]) -> float:
    """The ``t >= 0`` of the least ``c[0] t + c[1] t² + c[2] t³ + c[3] t⁴`` (0 if none is below 0)."""
    slope = np.array([4 * c[3], 3 * c[2], 2 * c[1], c[0]])
    scale = np.abs(slope).max()
    if not np.isfinite(scale) or scale == 0:
        return 0.0
    roots = np.roots(np.trim_zeros(slope / scale, "f"))
    tried = [float(r.real) for r in roots if abs(r.imag) <= 1e-9 * max(1.0, abs(r.real)) and r.real > 0]
    value = {t: sum(x * t ** (i + 1) for i, x in enumerate(c)) for t in tried}
    best = min(value, key=value.get, default=0.0)
    return best if tried and value[best] < 0 else 0.0


def damped_family(train: A.Training, errors: DataFrame, sums: DataFrame, params: DataFrame, slot: str, reg: float,
                  dimension: int) -> tuple[DataFrame, DataFrame, float]:
    """One family: the errors after the step, the new values (``feature_id, new``), the step."""
    scratch, factor = train.scratch, slot != "w"
    state = errors
    if factor:
        state = A.placed_join(errors, sums.select("row_id", F.col(f"q{slot[1:]}").alias("q")))
    entries = A.placed_join(train.rows.select("row_id", "features"), state).select(
        "row_id", "e", *(["q"] if factor else []), F.inline("features"))
    moves = scratch.write(direction(entries, params, slot, reg, dimension), "moves")
    changes = scratch.place(row_changes(entries, moves, factor, dimension), "row_id", train.parts, "changes")
    c = coefficients(errors, changes)
    r = moves.agg(F.sum(F.col("theta") * F.col("delta")), F.sum(F.col("delta") * F.col("delta"))).first()
    c[0] += 2 * reg * float(r[0] or 0.0)
    c[1] += reg * float(r[1] or 0.0)
    t = best_step(c)
    step = A.number_literal(t)
    moved = F.coalesce(F.col("a") * step + F.col("b") * step * step, F.lit(0.0))
    after = errors.join(changes.select("row_id", "a", "b").hint("merge"), "row_id", "left").select(
        "row_id", (F.col("e") + moved).alias("e"))
    new = moves.select("feature_id", (F.col("theta") + F.col("delta") * step).alias("new"))
    return scratch.place(after, "row_id", train.parts, "state", placed=True), new, t


def damped_iteration(train: A.Training, params: DataFrame, w0: float, cfg: FMConfig, dimension: int) -> A.IterationResult:
    """One pass: residuals, w0, every family in one damped step."""
    mark = train.scratch.mark()
    start = A.start_pass(train, params, w0, cfg, dimension)
    updates, errors = A.Updates(train.scratch), start.errors
    for slot, reg in A.families(cfg):
        errors, new, _ = damped_family(train, errors, start.sums, params, slot, reg, dimension)
        updates.tables.append(new.select("feature_id", F.lit(slot).alias("slot"), "new"))
    made = train.scratch.paths[mark:]
    params = train.scratch.write(updates.apply(params, dimension), "params")
    for path in made:
        train.scratch.drop(path)
    return A.IterationResult(params, start.w0, start.rmse)
