"""Scaling laws: optima, joint and robust fits, loss surfaces, schedules, diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import Scratch

FLOPS_PER_TOKEN = 6.0  # a parameter's operations for each token of training


def compute_optimum(budget: Column, ratio: float = 20.0) -> Column:
    """Parameters and tokens that spend ``budget`` at ``ratio`` tokens a parameter."""
    n = F.sqrt(budget / (FLOPS_PER_TOKEN * ratio))
    return F.struct(n.alias("parameters"), (n * ratio).alias("tokens"))


def joint_optimum(budget: Column, a: float, b: float, alpha: float, beta: float) -> Column:
    """The least of E + a / N**alpha + b / D**beta under 6 N D = ``budget``."""
    n = F.pow(F.lit(alpha * a / (beta * b)) * F.pow(budget / FLOPS_PER_TOKEN, F.lit(beta)), F.lit(1 / (alpha + beta)))
    return F.struct(n.alias("parameters"), (budget / (FLOPS_PER_TOKEN * n)).alias("tokens"))


def tier_optima(runs: DataFrame, tie: str) -> DataFrame:
    """The completed run of least loss of each compute tier, a tenth of a power of ten wide.

    ``runs`` has parameters, tokens, loss and status. ``boundary`` says that the best is
    the least or the largest model tried, so that the tier's optimum is only a bound."""
    tier = F.round(F.log10(F.lit(FLOPS_PER_TOKEN) * F.col("parameters") * F.col("tokens")), 1)
    best = runs.where("status = 'completed'").groupBy(tier.alias("tier")).agg(
        F.min_by(F.struct("parameters", "tokens", "loss"), F.struct("loss", tie)).alias("b"), F.min("parameters").alias("low"), F.max("parameters").alias("high")
    )
    return best.select("tier", "b.*", ((F.col("b.parameters") == F.col("low")) | (F.col("b.parameters") == F.col("high"))).alias("boundary"))


def _moments(exponents: np.ndarray):
    """Sums over a partition's rows that the normal equations of every exponent pair need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = len(exponents)
        sums = np.zeros(3 + 6 * g + g * g)
        for b in batches:
            n, d, y = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            p, q = n[:, None] ** -exponents, d[:, None] ** -exponents
            one = [p.sum(0), (p * p).sum(0), y @ p, q.sum(0), (q * q).sum(0), y @ q]
            sums += np.concatenate([[len(y), y.sum(), y @ y], *one, (p.T @ q).ravel()])
        yield pa.record_batch([pa.array(np.arange(len(sums))), pa.array(sums)], ["k", "s"])

    return run


def floor_law_fit(points: DataFrame, x: str, y: str, starts: int = 10, rounds: int = 200, seed: int = 42) -> DataFrame:
    """``(floor, coefficient, exponent, sse, rounds)`` of y = floor + coefficient * x ** -exponent by least squares.

    Damped Gauss-Newton steps from several seeded starts: a round's scan sums, for all starts at
    once, the squares, gradients and products of derivatives (ten numbers a start), from which
    the driver takes each start's next step; a step that does not lower the error is taken
    back with more damping. x is scaled by its geometric mean; the floor stays at 0 or more, the
    exponent within 0.001 and 10. It ends when no start moves any more; the best one counts.

    The points are stored once, so that a round reads them and not what they were made from.
    Rows with a null, or with x not above 0, take no part; without rows the result is empty."""
    own = points.select(F.log(F.col(x).cast("double")).alias("u"), F.col(y).cast("double").alias("y")).where("u is not null and y is not null and u > double('-inf')")
    own = Scratch(points.sparkSession, "floorlaw").save(own, "points")
    seen = own.agg(F.avg("u").alias("u"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).first()
    names = "floor double, coefficient double, exponent double, sse double, rounds int"
    if not seen["n"]:
        return points.sparkSession.createDataFrame([], names)
    rng = np.random.default_rng(seed)
    at = np.array([[max(seen["lo"], 0.0) * rng.uniform(0.5, 0.9), math.log(max(seen["hi"] - seen["lo"], 1e-8)), rng.uniform(0.2, 1.0)] for _ in range(starts)])
    low, high = np.array([0.0, -np.inf, 1e-3]), np.array([np.inf, np.inf, 10.0])
    u, e = F.col("u") - F.lit(seen["u"]), F.exp(F.col("s")[1] - F.col("s")[2] * (F.col("u") - F.lit(seen["u"])))
    slopes = [F.lit(1.0), e, -u * e]
    off = F.col("s")[0] + e - F.col("y")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = [F.sum(off * off).alias("c"), *[F.sum(slopes[i] * off).alias(f"g{i}") for i in range(3)], *[F.sum(slopes[i] * slopes[j]).alias(f"h{i}{j}") for i, j in pairs]]
    kept, best, damp, tried, still = at.copy(), np.full(starts, np.inf), np.full(starts, 1e-3), at, np.zeros(starts, dtype=bool)
    exact = 1e-26 * seen["n"] * max(abs(seen["lo"]), abs(seen["hi"])) ** 2
    grads, curves, done = np.zeros((starts, 3)), np.zeros((starts, 3, 3)), 0
    while done < rounds and not still.all():
        told = F.array(*[F.array(*[F.lit(float(v)) for v in t]) for t in tried])
        for r in own.select("u", "y", F.posexplode(told).alias("k", "s")).groupBy("k").agg(*sums).collect():
            k = r["k"]
            if still[k]:
                continue
            if r["c"] is not None and r["c"] < best[k]:
                gain = best[k] - r["c"]
                still[k] = r["c"] <= exact or gain <= 1e-12 * r["c"]
                kept[k], best[k], damp[k] = tried[k], r["c"], max(damp[k] / 5, 1e-12)
                grads[k] = [r[f"g{i}"] for i in range(3)]
                for i, j in pairs:
                    curves[k, i, j] = curves[k, j, i] = r[f"h{i}{j}"]
            else:
                damp[k] *= 5
                still[k] = damp[k] > 1e12
        tried = kept.copy()
        for k in np.flatnonzero(~still):
            h = curves[k] + damp[k] * np.diag(np.maximum(np.diag(curves[k]), 1e-30))
            tried[k] = np.clip(kept[k] - np.linalg.solve(h, grads[k]), low, high)
        done += 1
    k = int(best.argmin())
    floor, log_c, exponent = map(float, kept[k])
    return points.sparkSession.createDataFrame([(floor, math.exp(log_c + exponent * seen["u"]), exponent, float(best[k]), done)], names)


def joint_law_fit(runs: DataFrame, steps: int = 80, low: float = 0.05, high: float = 1.0) -> DataFrame:
    """One row: floor, a, alpha, b, beta and rmse of loss = floor + a / N**alpha + b / D**beta.

    Every exponent pair of a ``steps`` x ``steps`` grid is fitted by least squares. One
    scan gathers the sums all pairs need, so rows are never multiplied with the grid;
    the driver solves 3 x 3 systems, ``steps``**2 of them whatever the input. Rows with a
    null or a value that is not positive take no part; without any there is no row."""
    spark, e = runs.sparkSession, np.linspace(low, high, steps)
    schema = "floor double, a double, alpha double, b double, beta double, rmse double"
    own = runs.select(*[F.col(c).cast("double") for c in ("parameters", "tokens", "loss")]).where("parameters > 0 and tokens > 0 and loss is not null")
    got = own.mapInArrow(_moments(e), "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toPandas().sort_values("k")["s"].to_numpy()
    if not len(got) or not got[0]:
        return spark.createDataFrame([], schema)
    m, y, yy = got[:3]
    p, p2, py, q, q2, qy = got[3 : 3 + 6 * steps].reshape(6, steps)
    pq = got[3 + 6 * steps :].reshape(steps, steps)
    best = None
    for i in range(steps):
        for j in range(steps):
            left = np.array([[m, p[i], q[j]], [p[i], p2[i], pq[i, j]], [q[j], pq[i, j], q2[j]]])
            scale = np.sqrt(np.diag(left))
            right = np.array([y, py[i], qy[j]])
            theta = np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-13)[0] / scale
            rmse = math.sqrt(max(yy - 2 * theta @ right + theta @ left @ theta, 0.0) / m)
            if best is None or rmse < best[-1]:
                best = (*map(float, (theta[0], theta[1], e[i], theta[2], e[j])), rmse)
    return spark.createDataFrame([best], schema)


def robust_power_law(df: DataFrame, x: str, y: str, floor: float = 0.0, delta: float = 1.0, rounds: int = 100) -> DataFrame:
    """One row ``(coefficient, exponent)`` of y = floor + coefficient * x ** -exponent: a
    fit of the logs by reweighted least squares, residuals above ``delta`` weighing less.
    A round is one aggregation to five sums. ``y`` at or below the floor is an error."""
    if df.where(F.col(y) <= floor).limit(1).count():
        raise ValueError("observations at or below the floor")
    lx, ly = F.log(F.col(x).cast("double")), F.log(F.col(y).cast("double") - floor)
    logs = df.select(lx.alias("u"), ly.alias("v")).where("u is not null and v is not null")
    level, slope = float(logs.agg(F.avg("v")).first()[0] or 0.0), 0.5
    for _ in range(rounds):
        far = F.abs(F.col("v") - (F.lit(level) - F.lit(slope) * F.col("u")))
        w = F.when(far <= delta, 1.0).otherwise(delta / far)
        s = logs.select(w.alias("w"), "u", "v").agg(
            F.sum("w"), F.sum(F.expr("w * u")), F.sum(F.expr("w * u * u")), F.sum(F.expr("w * v")), F.sum(F.expr("w * u * v"))
        ).first()
        if s[0] is None or s[0] * s[2] == s[1] ** 2:
            break
        new_slope = -(s[0] * s[4] - s[1] * s[3]) / (s[0] * s[2] - s[1] ** 2)
        new_level = (s[3] + new_slope * s[1]) / s[0]
        moved = max(abs(new_level - level), abs(new_slope - slope))
        level, slope = new_level, new_slope
        if moved < 1e-10:
            break
    return df.sparkSession.createDataFrame([(math.exp(level), slope)], "coefficient double, exponent double")


def kernel_surface(points: DataFrame, xs: list[float], ys: list[float], width: float = 1.5) -> DataFrame:
    """``(x, y, z)`` on a grid: the mean of ``points`` (x, y, z) under Gaussian weights of the
    squared distance of logs. Partial sums a partition replace the product of rows and grid."""
    gx, gy = np.log(np.array(xs)), np.log(np.array(ys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, below = np.zeros((len(gx), len(gy))), np.zeros((len(gx), len(gy)))
        for b in batches:
            x, y, z = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            wx = np.exp(-((np.log(x)[:, None] - gx) ** 2) / width)
            wy = np.exp(-((np.log(y)[:, None] - gy) ** 2) / width)
            top += wx.T @ (wy * z[:, None])
            below += wx.T @ wy
        i, j = np.indices(top.shape)
        yield pa.record_batch([pa.array(v.ravel()) for v in (i, j, top, below)], ["i", "j", "t", "w"])

    own = points.select(*[F.col(c).cast("double") for c in ("x", "y", "z")]).where("x > 0 and y > 0 and z is not null")
    sums = own.mapInArrow(run, "i long, j long, t double, w double").groupBy("i", "j").agg(F.sum("t").alias("t"), F.sum("w").alias("w"))
    at = lambda values, k: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col(k) + 1).cast("int"))
    return sums.where("w > 0").select(at(xs, "i").alias("x"), at(ys, "j").alias("y"), (F.col("t") / F.col("w")).alias("z"))


def training_steps(budget: Column, parameters: Column, batch: int = 32, context: int = 256) -> Column:
    """Steps, warm-up and evaluation interval of a run that spends ``budget``."""
    steps = F.greatest(F.lit(100), F.ceil(budget / (FLOPS_PER_TOKEN * parameters) / (batch * context))).cast("long")
    part = F.floor(steps / 20)
    return F.struct(steps.alias("steps"), F.least(F.lit(100), F.greatest(F.lit(10), part)).alias("warmup"), F.greatest(F.lit(25), part).alias("interval"))


def cosine_rate(step: Column, high: float, low: float, warmup: int, cycle: int) -> Column:
    """Learning rate at a step: linear warm-up, cosine fall to ``low``, then ``low``."""
    fall = 0.5 * (1 + F.cos(math.pi * (step - warmup) / (cycle - warmup)))
    return F.when(step < warmup, high * step / warmup).when(step > cycle, low).otherwise(low + fall * (high - low))


def extrapolation_report(residuals: DataFrame, rising: float = 0.5) -> DataFrame:
    """Residuals ``(compute, residual)`` to ``(compute, bias, biased, correlation, rising)``: a
    tier is biased if its mean is over three deviations of all residuals; ``rising`` warns
    that residuals grow with the log of compute."""
    whole = residuals.agg(F.stddev_pop("residual").alias("s"), F.corr(F.log("compute"), F.col("residual")).alias("correlation"))
    tiers = residuals.groupBy("compute").agg(F.avg("residual").alias("bias"))
    return tiers.crossJoin(F.broadcast(whole)).select(
        "compute", "bias", (F.abs("bias") > 3 * F.col("s")).alias("biased"), "correlation", (F.col("correlation") > rising).alias("rising")
    )
