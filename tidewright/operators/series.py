"""Whole-series estimates as grouped sums: Hurst exponents over scales, the Dickey-Fuller regression, log-periodic scans.

Each spreads a row to the groups that it belongs to (scales and segments; windows and grid points) and adds up moments,
which combine before the shuffle; small systems are then solved as Columns. No series, segment or window is gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import normal_cdf
from .windows import by_seq, last_rows

# ---- Hurst exponents --------------------------------------------------------------------------


def _numbered(df: DataFrame, column: str) -> DataFrame:
    """symbol, pos (0, 1, ... among rows with a value), x, and n (the symbol's number of values)."""
    rows = df.where(F.col(column).isNotNull()).select("symbol", F.col("seq"), F.col(column).cast("double").alias("x"))
    rows = rows.withColumn("pos", F.row_number().over(by_seq()) - 1)
    counts = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("x").alias("mean"))
    return rows.join(counts, "symbol")


def scales(n: Column, least: int = 10, number: int = 20) -> Column:
    """The different whole numbers of a geometric range from `least` to a quarter of n, both ends included."""
    top = F.floor(n / 4)
    inner = F.transform(F.sequence(F.lit(1), F.lit(number - 2)), lambda i: F.floor(least * F.pow(top / least, i / (number - 1))))
    return F.array_distinct(F.concat(F.array(F.lit(least).cast("long")), inner, F.array(top)))


def _fitted(points: DataFrame, counts: DataFrame) -> DataFrame:
    """symbol, hurst (slope of log value over log scale, within 0 and 1), r2, scales and regime. points: symbol, scale, value."""
    x, y = F.log("scale"), F.log("value")
    sums = points.where("value > 0").select("symbol", x.alias("x"), y.alias("y")).groupBy("symbol").agg(F.count("*").alias("k"), F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"))
    slope = F.try_divide("sxy", "sxx")
    r2 = F.when(F.col("syy") > 0, 1 - (F.col("syy") - slope * F.col("sxy")) / (F.col("syy") + 1e-10)).otherwise(0.0)
    enough = (F.col("k") >= 3) & slope.isNotNull()
    out = counts.join(sums, "symbol", "left").select(
        "symbol",
        F.when(enough, F.least(F.lit(1.0), F.greatest(F.lit(0.0), slope))).otherwise(0.5).alias("hurst"),
        F.when(enough, F.greatest(F.lit(0.0), r2)).otherwise(0.0).alias("r2"),
        F.coalesce("k", F.lit(0)).cast("int").alias("scales"),
    )
    return out.withColumn("regime", F.when(F.col("hurst") > 0.55, "trending").when(F.col("hurst") < 0.45, "mean_reverting").otherwise("random_walk"))


def hurst_scales(df: DataFrame, column: str, least: int = 10, number: int = 20) -> DataFrame:
    """symbol, hurst, r2, scales and regime by rescaled ranges: for each scale the mean, over whole segments from the start, of the range of the running sum less its mean over the deviation.

    With fewer than 2 `least` values or three scales: 0.5, r2 0, a random walk. A segment without deviation is left out.
    """
    rows = _numbered(df, column).withColumn("total", F.sum("x").over(Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    spread = rows.where(F.col("n") >= 2 * least).withColumn("scale", F.explode(scales(F.col("n"), least, number))).where("scale >= 2 AND pos < scale * floor(n / scale)")
    spread = spread.withColumn("segment", F.floor(F.col("pos") / F.col("scale")))
    mean = F.avg("x").over(Window.partitionBy("symbol", "scale", "segment"))
    # the running sum from the segment's start differs from the series' own by a constant, which a range doesn't see
    spread = spread.withColumn("walk", F.col("total") - F.col("pos") * mean)
    segments = spread.groupBy("symbol", "scale", "segment").agg((F.max("walk") - F.min("walk")).alias("r"), F.stddev_samp("x").alias("s"))
    points = segments.where("s > 1e-10").groupBy("symbol", "scale").agg(F.avg(F.col("r") / F.col("s")).alias("value"))
    return _fitted(points, rows.select("symbol").distinct())


def hurst_dfa(df: DataFrame, column: str, least: int = 10, number: int = 20) -> DataFrame:
    """symbol, hurst, r2, scales and regime by detrended fluctuations: the root mean, over whole segments from the start and from the end, of the mean square left by a line through the running sum of deviations."""
    rows = _numbered(df, column)
    profile = F.sum(F.col("x") - F.col("mean")).over(Window.partitionBy("symbol").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("y", profile)
    spread = rows.where(F.col("n") >= 2 * least).withColumn("scale", F.explode(scales(F.col("n"), least, number))).where("scale >= 3")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("pos").cast("long").alias("at")), F.struct(F.lit(1).alias("side"), (F.col("n") - 1 - F.col("pos")).cast("long").alias("at")))
    spread = spread.withColumn("e", F.explode(sides)).withColumn("segment", F.floor(F.col("e.at") / F.col("scale"))).where("segment < floor(n / scale)")
    x = (F.col("pos") - F.col("segment") * F.col("scale")).cast("double")
    sums = spread.groupBy("symbol", "scale", "e.side", "segment").agg(F.regr_sxx("y", x).alias("sxx"), F.regr_sxy("y", x).alias("sxy"), F.regr_syy("y", x).alias("syy"))
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0)) / F.col("scale")
    points = sums.groupBy("symbol", "scale").agg(F.sqrt(F.avg(left)).alias("value"))
    return _fitted(points, rows.select("symbol").distinct())


def hurst_rolling(df: DataFrame, column: str, n: int = 100, least: int = 50, method: str = "dfa", smallest: int = 10, number: int = 20) -> DataFrame:
    """df with hurst, r2 and regime of each row's last n values, null with fewer than `least`: detrended fluctuations (dfa) or rescaled ranges (rs), as hurst_dfa and hurst_scales of that window.

    A window is an array of at most n numbers. Windows of one length are rows of a matrix, and each scale's segments are
    detrended at once by one projection, so no window is looped over.
    """
    values = F.collect_list(F.col(column).cast("double")).over(last_rows(n))
    rows = df.select("symbol", "seq", values.alias("v")).where(F.size("v") >= least)

    def estimated(batches):
        for pdf in batches:
            lengths = np.array([len(v) for v in pdf["v"]])
            hurst, r2 = np.full(len(pdf), 0.5), np.zeros(len(pdf))
            for length in np.unique(lengths):
                rows_ = np.flatnonzero(lengths == length)
                if length >= 2 * smallest:
                    hurst[rows_], r2[rows_] = _of_windows(np.stack(pdf["v"].iloc[rows_].to_numpy()), method, smallest, number)
            yield pd.DataFrame({"symbol": pdf["symbol"], "seq": pdf["seq"], "hurst": hurst, "r2": r2})

    found = rows.mapInPandas(estimated, "symbol string, seq long, hurst double, r2 double")
    out = df.drop("hurst", "r2", "regime").join(found, ["symbol", "seq"], "left")
    return out.withColumn("regime", F.when(F.col("hurst") > 0.55, "trending").when(F.col("hurst") < 0.45, "mean_reverting").when(F.col("hurst").isNotNull(), "random_walk"))


def _of_windows(x: np.ndarray, method: str, smallest: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Exponents and r2 of the rows of x."""
    n = x.shape[1]
    top = n // 4
    sizes = sorted({smallest, top, *(int(np.floor(smallest * (top / smallest) ** (i / (number - 1)))) for i in range(1, number - 1))})
    profile = np.cumsum(x - x.mean(axis=1, keepdims=True), axis=1)
    points = []
    for size in (s for s in sizes if s >= (3 if method == "dfa" else 2)):
        count = n // size
        if method == "dfa":
            t = np.arange(size) - (size - 1) / 2
            parts = np.concatenate([profile[:, : count * size].reshape(len(x), count, size), profile[:, n - count * size :].reshape(len(x), count, size)], axis=1)
            parts = parts - parts.mean(axis=2, keepdims=True)
            left = parts - (parts @ t / (t @ t))[..., None] * t
            value = np.sqrt((left * left).mean(axis=(1, 2)))
        else:
            parts = x[:, : count * size].reshape(len(x), count, size)
            walk = np.cumsum(parts - parts.mean(axis=2, keepdims=True), axis=2)
            sd = parts.std(axis=2, ddof=1)
            ratio = np.where(sd > 1e-10, (walk.max(axis=2) - walk.min(axis=2)) / np.where(sd > 1e-10, sd, 1), np.nan)
            good = ~np.isnan(ratio)
            value = np.where(good.any(axis=1), np.nansum(ratio, axis=1) / np.maximum(good.sum(axis=1), 1), 0.0)
        points.append((np.full(len(x), np.log(size)), value))
    a, v = (np.stack(p, axis=1) for p in zip(*points))
    ok = v > 0
    b = np.log(np.where(ok, v, 1.0))
    k = ok.sum(axis=1)
    ma, mb = (np.where(ok, z, 0).sum(axis=1) / np.maximum(k, 1) for z in (a, b))
    da, db = np.where(ok, a - ma[:, None], 0), np.where(ok, b - mb[:, None], 0)
    sxx, sxy, syy = (da * da).sum(axis=1), (da * db).sum(axis=1), (db * db).sum(axis=1)
    fine = (k >= 3) & (sxx > 0)
    slope = np.where(fine, sxy / np.where(sxx > 0, sxx, 1), 0.5)
    r2 = np.where(fine & (syy > 0), np.maximum(0.0, 1 - (syy - slope * sxy) / (syy + 1e-10)), 0.0)
    return np.where(fine, np.clip(slope, 0, 1), 0.5), r2


# ---- stationarity -----------------------------------------------------------------------------

# Coefficients of the asymptotic distribution of the statistic with a constant (MacKinnon 1994), by which
# p is the normal distribution at a polynomial; below the first bound and above the second other coefficients hold.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
# Asymptotic critical values at 1, 5 and 10 per cent.
ADF_CRITICAL = (-3.43035, -2.86154, -2.56677)


def adf_p_value(statistic: Column) -> Column:
    def poly(c):
        return sum((F.lit(a) * F.pow(statistic, F.lit(i)) for i, a in enumerate(c)), F.lit(0.0))

    return F.when(statistic > ADF_MAX, 1.0).when(statistic < ADF_MIN, 0.0).when(statistic <= ADF_STAR, normal_cdf(poly(ADF_SMALL))).otherwise(normal_cdf(poly(ADF_LARGE)))


def adf(df: DataFrame, column: str, lags: int = 1, least: int = 20) -> DataFrame:
    """symbol, adf_statistic (the t value of the level before in a regression of the step on it, a constant and `lags` steps before), p_value, n_obs and stationary (p below 0.05).

    The number of lags is given, not searched for. Cross products are summed in one pass; each symbol's are a small
    system. Nulls are left out before steps are taken; a symbol with fewer than `least` values has nulls, and so has one
    whose regression has no single answer.
    """
    rows = df.where(F.col(column).isNotNull()).select("symbol", "seq", F.col(column).cast("double").alias("y"))
    rows = rows.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("symbol")))  # the constant takes what is taken off
    w = by_seq()
    rows = rows.withColumns({"before": F.lag("y").over(w), "step": F.col("y") - F.lag("y").over(w), "values": F.count("*").over(Window.partitionBy("symbol"))})
    names = ["before", *[f"step{i}" for i in range(1, lags + 1)], "step"]
    rows = rows.withColumns({f"step{i}": F.lag("step", i).over(w) for i in range(1, lags + 1)})
    usable = F.col(names[-2] if lags else "before").isNotNull()
    pairs = [(a, b) for i, a in enumerate(["one", *names]) for b in ["one", *names][i:]]
    sums = rows.withColumn("one", F.lit(1.0)).groupBy("symbol").agg(F.max("values").alias("values"), F.array(*[F.sum(F.when(usable, F.col(a) * F.col(b))) for a, b in pairs]).alias("m"))
    k = lags + 2

    @F.pandas_udf("double")
    def t_value(m: pd.Series) -> pd.Series:
        out = []
        for flat in m:
            if flat is None or any(v is None or v != v for v in flat):
                out.append(None)
                continue
            full = np.zeros((k + 1, k + 1))
            full[np.triu_indices(k + 1)] = flat
            full = full + np.triu(full, 1).T
            x, xy, yy, n = full[:k, :k], full[:k, k], full[k, k], full[0, 0]
            if n <= k or np.linalg.matrix_rank(x) < k:
                out.append(None)
                continue
            inverse = np.linalg.inv(x)
            b = inverse @ xy
            left = max(yy - b @ xy, 0.0) / (n - k)
            out.append(b[1] / np.sqrt(left * inverse[1, 1]) if left > 0 else None)
        return pd.Series(out, dtype="float64")

    found = sums.withColumn("adf_statistic", F.when(F.col("values") >= least, F.nanvl(t_value("m"), F.lit(None).cast("double"))))
    p = adf_p_value(F.col("adf_statistic"))
    return found.select("symbol", "adf_statistic", F.when(F.col("adf_statistic").isNotNull(), p).alias("p_value"), F.greatest(F.col("values") - 1 - lags, F.lit(0)).alias("n_obs"), F.coalesce(p < 0.05, F.lit(False)).alias("stationary"))


# ---- log-periodic scans -----------------------------------------------------------------------

AHEAD, POWERS, FREQUENCIES = (1, 5, 10, 20, 40, 60), (0.1, 0.3, 0.5, 0.7, 0.9), (4.0, 6.0, 8.0, 10.0, 13.0, 19.0, 25.0)


def bubble_fits(df: DataFrame, windows: tuple[int, ...] = tuple(range(120, 751, 5)), every: int = 24, ahead=AHEAD, powers=POWERS, frequencies=FREQUENCIES) -> DataFrame:
    """The best fit of each (symbol, end, window): ahead (the critical time is ahead + 1 bars after the end), m, omega, a, b, c1, c2, ssr, r2, damping and oscillations.

    ln price = a + b d^m + c1 d^m cos(omega ln d) + c2 d^m sin(omega ln d), d the bars to the critical time. Ends are every
    `every` bars. d depends on the distance from the end alone, so a row meets an end and a grid point once whatever the
    windows: moments are summed by ring between two window lengths, and a window is the sum of its rings. The four
    coefficients of each grid point come from the normal equations as Columns, and the least sum of squares wins; of equal
    ones the smallest ahead, m and omega.
    """
    windows = tuple(sorted(windows))
    longest = windows[-1]
    w = by_seq()
    rows = df.where("close > 0").select("symbol", "seq", F.log("close").alias("y"))
    # the ends that a row lies before: multiples of `every` less than `longest` bars ahead
    first = F.ceil(F.col("seq") / every) * every
    rows = rows.withColumn("end", F.explode(F.sequence(first, first + ((longest - 1) // every) * every, F.lit(every).cast("long"))))
    rows = rows.withColumn("back", F.col("end") - F.col("seq")).where(F.col("back") < longest)
    rings = F.lit(0)
    for n in windows[:-1]:
        rings = rings + (F.col("back") >= n).cast("int")
    last = df.groupBy("symbol").agg(F.max("seq").alias("last"))
    rows = rows.withColumn("ring", rings).join(last, "symbol").where("end <= last")
    grid = F.array(*[F.struct(F.lit(float(a)).alias("ahead"), F.lit(float(m)).alias("m"), F.lit(float(o)).alias("omega")) for a in ahead for m in powers for o in frequencies])
    rows = rows.withColumn("g", F.explode(grid)).select("symbol", "end", "ring", "y", "g.*", "back")
    d = F.col("back") + 1 + F.col("ahead")
    rows = rows.withColumns({"f": F.pow(d, F.col("m")), "turn": F.col("omega") * F.log(d)}).withColumns({"p": F.col("f") * F.cos("turn"), "q": F.col("f") * F.sin("turn"), "one": F.lit(1.0)})
    names = ["one", "f", "p", "q", "y"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    keys = ["symbol", "end", "ahead", "m", "omega"]
    sums = rows.groupBy(*keys, "ring").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    # a window has its own ring and those within
    inwards = Window.partitionBy(*keys).orderBy("ring").rowsBetween(Window.unboundedPreceding, 0)
    whole = sums.select(*keys, "ring", *[F.sum(f"{a}_{b}").over(inwards).alias(f"{a}_{b}") for a, b in pairs])
    whole = whole.withColumn("window", F.element_at(F.array(*[F.lit(n) for n in windows]), F.col("ring") + 1)).where("one_one = window")
    solved = solve(whole, names[:4], "y")
    # what is left of the squares about the mean
    fits = solved.withColumn("ssr", F.col("_y_y") - sum((F.col(f"x_{n}") * F.col(f"_{n}_y") for n in names[1:4]), F.lit(0.0))).where("ssr IS NOT NULL AND NOT isnan(ssr)").withColumn("ssr", F.greatest("ssr", F.lit(0.0)))
    best = fits.groupBy("symbol", "end", "window").agg(F.min(F.struct("ssr", "ahead", "m", "omega", *[F.col(f"x_{n}").alias(c) for n, c in zip(names, ("a", "b", "c1", "c2"))], "one_y", "y_y")).alias("s")).select("symbol", "end", "window", "s.*")
    c = F.sqrt(F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2"))
    total = F.col("y_y") - F.col("one_y") * F.col("one_y") / F.col("window")
    return best.withColumns({
        "r2": F.when(total > 0, 1 - F.col("ssr") / total).otherwise(0.0),
        "damping": F.when(c > 0, F.col("m") * F.abs("b") / (F.col("omega") * c)).otherwise(float("inf")),
        "oscillations": F.col("omega") / (2 * np.pi) * F.log((F.col("window") + F.col("ahead")) / (F.col("ahead") + 1)),
    }).drop("one_y", "y_y")


def solve(df: DataFrame, names: list[str], y: str) -> DataFrame:
    """df with x_<name> for a constant and three more names: the least-squares solution, by determinants of what the constant leaves of the moments.

    Moments are columns <a>_<b>, a before b in [*names, y], and the constant's own is the number of rows. Null where the
    three are not independent.
    """
    one, *three = names
    every = [one, *three, y]
    m = lambda a, b: F.col(f"{a}_{b}" if every.index(a) <= every.index(b) else f"{b}_{a}")
    n = m(one, one)
    pairs = [(a, b) for i, a in enumerate(every[1:]) for b in every[1:][i:]]
    df = df.withColumns({f"_{a}_{b}": m(a, b) - m(one, a) * m(one, b) / n for a, b in pairs})
    left = lambda a, b: F.col(f"_{a}_{b}" if every.index(a) <= every.index(b) else f"_{b}_{a}")

    def determinant(columns):
        """Of the three rows of moments with the given names as columns."""
        r = [[left(a, c) for c in columns] for a in three]
        return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

    df = df.withColumns({"_d": determinant(three)} | {f"_d_{i}": determinant([y if j == i else c for j, c in enumerate(three)]) for i in range(3)})
    whole = F.when(F.abs("_d") > 1e-13 * F.abs(left(three[0], three[0]) * left(three[1], three[1]) * left(three[2], three[2])), F.col("_d"))
    df = df.withColumns({f"x_{c}": F.col(f"_d_{i}") / whole for i, c in enumerate(three)})
    df = df.withColumn(f"x_{one}", (m(one, y) - sum((F.col(f"x_{c}") * m(one, c) for c in three), F.lit(0.0))) / n)
    return df.drop("_d", *[f"_d_{i}" for i in range(3)])


def fit_filters(fits: DataFrame, rising: bool = True, strict: bool = False) -> DataFrame:
    """fits with failed (names of the checks that fail, in order), passed and quality (the mean of six scores)."""
    sign = F.col("b") < 0 if rising else F.col("b") > 0
    low, high = (0.3, 0.7) if strict else (0.1, 0.9)
    checks = {
        "tc_range": (F.col("ahead") + 1).between(1, 60),
        "m_range": F.col("m").between(low, high),
        "omega_range": F.col("omega").between(6, 13),
        "B_sign": sign,
        "damping": F.col("damping") >= 1,
        "oscillations": F.col("oscillations") >= 2.5,
        "r_squared": F.col("r2") >= 0.5,
    }
    score = lambda *steps: F.coalesce(*[F.when(c, v) for c, v in steps], F.lit(0.0))
    m, o, d, n, r2 = (F.col(c) for c in ("m", "omega", "damping", "oscillations", "r2"))
    scores = [
        score((m.between(0.4, 0.6), 1.0), (m.between(0.3, 0.7), 0.8), (m.between(0.1, 0.9), 0.5)),
        score((o.between(6, 13), 1.0), (o.between(4, 25), 0.5)),
        score((d >= 1.5, 1.0), (d >= 1, 0.8), (d >= 0.5, 0.5)),
        score((n >= 3, 1.0), (n >= 2.5, 0.8), (n >= 2, 0.5)),
        score((r2 >= 0.8, 1.0), (r2 >= 0.6, 0.7), (r2 >= 0.4, 0.4)),
        score((sign, 1.0)),
    ]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n_) for n_, c in checks.items()]))
    return fits.withColumn("failed", failed).withColumns({"passed": F.size("failed") == 0, "quality": sum(scores) / len(scores)})


def bubble_confidence(filtered: DataFrame) -> DataFrame:
    """symbol, end, confidence (the share of windows that pass), windows, and the mean, deviation and median of the critical time of those that pass."""
    tc = F.when(F.col("passed"), F.col("end") + F.col("ahead") + 1)
    return filtered.groupBy("symbol", "end").agg(F.avg(F.col("passed").cast("double")).alias("confidence"), F.count("*").alias("windows"), F.avg(tc).alias("tc_mean"), F.stddev_pop(tc).alias("tc_std"), F.percentile(tc, F.lit(0.5)).alias("tc_median"))
