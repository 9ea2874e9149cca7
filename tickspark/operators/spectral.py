"""Fourier, wavelet and seasonal transforms of series of any length.

A series of at most `longest` rows is transformed in one group.  A longer one is dealt out: its Fourier transform is a
convolution with a chirp (any length, prime ones too), whose transforms of R x R points are two rounds of
short transforms by columns and by rows with twiddle factors between them, so that a group holds a block of columns only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import carried, join_keys, largest_key, ranked, time_cuts
from ..functions.scratch import stored

#: Values that a group holds at least, if the series has as many; a power of two.
GROUP = 65_536


def positions(df: DataFrame, col: str = "close", by: str = "symbol", order: str = "ts", longest: int = 1_000_000) -> DataFrame:
    """(by, order, i, x, n): the place of each value in its series, from 0, and the series' length; null values are left out."""
    return _placed(df, col, by, order, longest)[0]


def _placed(df: DataFrame, col: str, by: str, order: str, longest: int = 1_000_000) -> tuple[DataFrame, int]:
    """As positions, from values that are stored once, and the length of the longest series."""
    base = stored(df.select(by, order, F.col(col).cast("double").alias("x")).filter("x is not null"), "series")
    most = largest_key(base, [by])
    if most <= longest:
        w = Window.partitionBy(by)
        return base.withColumns({"i": F.row_number().over(w.orderBy(order)).cast("long") - 1, "n": F.count("*").over(w)}).select(by, order, "x", "i", "n"), most
    sizes = base.groupBy(by).agg(F.count("*").alias("n"))
    return join_keys(ranked(base, [by], [order], _cuts(base, by, order, longest), "i"), sizes, [by]), most


def _cuts(rows: DataFrame, by: str, order: str, longest: int = 1_000_000) -> list[int]:
    """Time cuts if a series has more than `longest` rows."""
    most = largest_key(rows, [by])
    return time_cuts(rows, order, min(2 + 2 * most // longest, 1000)) if most > longest else []


def _chirp(j: np.ndarray, n: int) -> np.ndarray:
    return np.exp(-1j * np.pi * ((j.astype(np.int64) * j) % (2 * n)) / n)


def _side(n: int) -> int:
    """R of the R x R points that the convolution of n values with a chirp takes: a power of two."""
    r = 4
    while r * r < 2 * n - 1:
        r *= 2
    return r


def _alone(n: int, longest: int) -> bool:
    """Whether a series is transformed in one group: a short one, or one whose R x R points are a single block of columns."""
    return n <= longest or _side(n) ** 2 <= GROUP


def fourier(rows: DataFrame, by: str = "symbol", longest: int = GROUP, most: int | None = None) -> DataFrame:
    """(by, n, i, re, im) -> the same columns of the discrete Fourier transform of each series, as numpy's fft.

    `most`, the length of the longest series, leaves out the steps for long ones where there is none.
    """
    kind = dict(rows.dtypes)[by]
    rows = rows.select(by, F.col("n").cast("long"), F.col("i").cast("long"), F.col("re").cast("double"), F.col("im").cast("double"))
    out = f"`{by}` {kind}, n long, i long, re double, im double"

    def whole(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("i")
        z, n = t["re"].to_numpy() + 1j * t["im"].to_numpy(), int(t["n"].iloc[0])
        if n <= longest:
            z = np.fft.fft(z)
        else:
            # the convolution with a chirp, all of its points at once
            size, j = _side(n) ** 2, np.arange(n)
            b = np.zeros(size, complex)
            b[:n] = np.conj(_chirp(j, n))
            b[size - n + 1 :] = b[n - 1 : 0 : -1]
            z = np.fft.ifft(np.fft.fft(z * _chirp(j, n), size) * np.fft.fft(b))[:n] * _chirp(j, n)
        return t.assign(re=z.real, im=z.imag)

    if most is not None and _alone(most, longest):
        return rows.groupBy(by).applyInPandas(whole, out)
    # r is a power of two, so that R x R points are a block up to half of them
    alone = (F.col("n") <= longest) | (F.col("n") * 2 - 1 <= 4 ** int(np.log2(GROUP) // 2))
    short = rows.filter(alone).groupBy(by).applyInPandas(whole, out)
    return short.unionByName(_long_fourier(rows.filter(~alone), by, kind, out))


def _long_fourier(rows: DataFrame, by: str, kind: str, out: str) -> DataFrame:
    def frame(t: pd.DataFrame, n: int, **columns) -> pd.DataFrame:
        keep = {c: v.ravel() for c, v in columns.items()}
        return pd.DataFrame({by: [t[by].iloc[0]] * len(keep["p"]), "n": n, **keep})

    def width(r: int) -> int:
        return max(1, GROUP // r)

    # values and chirp, column by column: j = p r + q
    def columns(t: pd.DataFrame) -> pd.DataFrame:
        n = int(t["n"].iloc[0])
        r = _side(n)
        w = min(width(r), r)
        q0 = int(t["block"].iloc[0]) * w
        j = t["i"].to_numpy()
        a, at = np.zeros((r, w), complex), np.arange(r)[:, None] * r + np.arange(q0, q0 + w)[None, :]
        a[j // r, j % r - q0] = (t["re"].to_numpy() + 1j * t["im"].to_numpy()) * _chirp(j, n)
        far = np.minimum(at, r * r - at)
        b = np.where(far < n, np.conj(_chirp(np.minimum(far, n), n)), 0)
        p, q = np.broadcast_arrays(np.arange(r)[:, None], np.arange(q0, q0 + w)[None, :])
        twist = np.exp(-2j * np.pi * ((p * q) % (r * r)) / (r * r))
        a, b = np.fft.fft(a, axis=0) * twist, np.fft.fft(b, axis=0) * twist
        return frame(t, n, p=p, q=q, ar=a.real, ai=a.imag, br=b.real, bi=b.imag)

    # rows of the forward transforms; their product is at k = p + r k2, whose column in the backward one is p again
    def product(t: pd.DataFrame) -> pd.DataFrame:
        n = int(t["n"].iloc[0])
        r = _side(n)
        w = min(width(r), r)
        p0 = int(t["block"].iloc[0]) * w
        at = (t["p"].to_numpy() - p0, t["q"].to_numpy())
        a, b = np.zeros((w, r), complex), np.zeros((w, r), complex)
        a[at], b[at] = t["ar"].to_numpy() + 1j * t["ai"].to_numpy(), t["br"].to_numpy() + 1j * t["bi"].to_numpy()
        c = np.conj(np.fft.fft(a, axis=1) * np.fft.fft(b, axis=1))
        p, q = np.broadcast_arrays(np.arange(r)[None, :], np.arange(p0, p0 + w)[:, None])
        c = np.fft.fft(c, axis=1) * np.exp(-2j * np.pi * ((p * q) % (r * r)) / (r * r))
        return frame(t, n, p=p, q=q, ar=c.real, ai=c.imag)

    def values(t: pd.DataFrame) -> pd.DataFrame:
        n = int(t["n"].iloc[0])
        r = _side(n)
        w = min(width(r), r)
        p0 = int(t["block"].iloc[0]) * w
        c = np.zeros((w, r), complex)
        c[t["p"].to_numpy() - p0, t["q"].to_numpy()] = t["ar"].to_numpy() + 1j * t["ai"].to_numpy()
        i = np.arange(p0, p0 + w)[:, None] + r * np.arange(r)[None, :]
        keep = i < n
        i, z = i[keep], (np.conj(np.fft.fft(c, axis=1)) / (r * r))[keep]
        z = z * _chirp(i, n)
        return pd.DataFrame({by: [t[by].iloc[0]] * len(i), "n": n, "i": i, "re": z.real, "im": z.imag})

    side = F.greatest(F.lit(4), F.pow(F.lit(2), F.ceil(F.log2(F.col("n") * 2 - 1) / 2))).cast("long")
    wide = F.least(F.greatest(F.lit(1), F.floor(F.lit(GROUP) / side)), side).cast("long")
    block = lambda c: F.floor(c / wide).cast("long")
    cells = f"`{by}` {kind}, n long, p long, q long, ar double, ai double"
    first = rows.withColumn("block", block(F.col("i") % side)).groupBy(by, "block").applyInPandas(columns, cells + ", br double, bi double")
    second = first.withColumn("block", block(F.col("p"))).groupBy(by, "block").applyInPandas(product, cells)
    return second.withColumn("block", block(F.col("p"))).groupBy(by, "block").applyInPandas(values, out)


def analytic_signal(df: DataFrame, col: str = "close", by: str = "symbol", order: str = "ts", longest: int = GROUP) -> DataFrame:
    """(by, order, amplitude, phase) of the analytic signal: the inverse transform of the spectrum without its negative frequencies."""
    placed, most = _placed(df, col, by, order)
    spectrum = fourier(placed.select(by, "n", "i", F.col("x").alias("re"), F.lit(0.0).alias("im")), by, longest, most)
    alone = (F.col("i") == 0) | (2 * F.col("i") == F.col("n"))
    weight = F.when(alone, 1.0).when(2 * F.col("i") < F.col("n"), 2.0).otherwise(0.0)
    back = fourier(spectrum.select(by, "n", "i", (F.col("re") * weight).alias("re"), (-F.col("im") * weight).alias("im")), by, longest, most)
    z = back.select(by, "i", (F.col("re") / F.col("n")).alias("re"), (-F.col("im") / F.col("n")).alias("im"))
    both = join_keys(placed.select(by, order, "i"), z, [by, "i"])
    return both.select(by, order, F.hypot("re", "im").alias("amplitude"), F.atan2("im", "re").alias("phase"))


def power(df: DataFrame, col: str = "close", by: str = "symbol", order: str = "ts", longest: int = GROUP) -> DataFrame:
    """(by, n, i, f, p): the power at the frequencies i / n up to one half, of the values less their mean; null at zero."""
    placed, most = _placed(df, col, by, order)
    mean = placed.groupBy(by).agg(F.avg("x").alias("mean"))
    level = join_keys(placed, mean, [by]).select(by, "n", "i", (F.col("x") - F.col("mean")).alias("re"), F.lit(0.0).alias("im"))
    spectrum = fourier(level, by, longest, most).filter("2 * i <= n")
    own = F.when(F.col("i") > 0, F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    return spectrum.select(by, "n", "i", (F.col("i") / F.col("n")).alias("f"), own.alias("p"))


def spectral_features(df: DataFrame, col: str = "close", by: str = "symbol", order: str = "ts", longest: int = GROUP) -> DataFrame:
    """Per series: centroid, spread, skew, kurtosis and entropy (bits) of the power over positive frequencies; null without power."""
    p = power(df, col, by, order, longest)
    total = p.groupBy(by).agg(F.sum("p").alias("s"), F.sum(F.col("f") * F.col("p")).alias("fp"), F.sum(F.when(F.col("p") > 0, F.col("p") * F.log2("p"))).alias("plogp"))
    total = total.select(by, F.nullif("s", F.lit(0.0)).alias("s"), "fp", "plogp").withColumn("centroid", F.col("fp") / F.col("s"))
    off = F.col("f") - F.col("centroid")
    moments = join_keys(p, total, [by]).groupBy(by, "s", "centroid", "plogp").agg(*(F.sum(F.pow(off, F.lit(float(k))) * F.col("p")).alias(f"m{k}") for k in (2, 3, 4)))
    spread = F.sqrt(F.col("m2") / F.col("s"))
    shape = lambda k: F.col(f"m{k}") / F.col("s") / F.pow(F.nullif(F.col("spread"), F.lit(0.0)), F.lit(float(k)))
    out = moments.withColumn("spread", spread)
    return out.select(by, "centroid", "spread", shape(3).alias("skew"), shape(4).alias("kurtosis"), (F.log2("s") - F.col("plogp") / F.col("s")).alias("entropy"))


def strongest_period(df: DataFrame, col: str = "close", by: str = "symbol", order: str = "ts", longest: int = GROUP) -> DataFrame:
    """(by, period): the rounded period, two at least, of the frequency with the most power (the lowest of equal ones)."""
    p = power(df, col, by, order, longest)
    best = p.filter("i > 0").groupBy(by).agg(F.max_by(F.struct("n", "i"), F.struct(F.round("p", 9), -F.col("i"))).alias("b"))
    return best.select(by, F.greatest(F.lit(2), F.rint(F.col("b.n") / F.col("b.i")).cast("int")).alias("period"))


def seasonal_decompose(df: DataFrame, period: int | None = None, multiplicative: bool = False, col: str = "close", by: str = "symbol", order: str = "ts") -> DataFrame:
    """(by, order, trend, seasonal, residual): centred moving average, means by phase, and what is left.

    The average over an even period has half weights at its ends; before the first and after the last full window the trend keeps
    its value there, a series without a full window has its mean.  Without a period each series takes its strongest one.
    Window sums are differences of running sums, which every row sends to the rows whose windows begin or end at it.
    """
    placed = positions(df, col, by, order)
    if period is None:
        placed = join_keys(placed, strongest_period(df, col, by, order), [by]).withColumn("period", F.coalesce("period", F.lit(2)))
    else:
        placed = placed.withColumn("period", F.lit(period))
    mean = placed.groupBy(by).agg(F.avg("x").alias("mean"))
    level = join_keys(placed, mean, [by]).withColumn("half", F.floor(F.col("period") / 2).cast("long"))
    # running sums of the values less their mean lose no digits
    summed = carried(level, [by], [order], {"c": F.col("x") - F.col("mean")}, _cuts(placed, by, order))
    half, i = F.col("half"), F.col("i")
    ends = {"hi": i - half, "hi1": i - half + 1, "lo": i + half, "lo1": i + half + 1}
    sent = summed.select(by, "c", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), to.alias("i")) for k, to in ends.items()))).alias("s"))
    met = sent.select(by, F.col("s.i").alias("i"), F.col("s.k").alias("k"), "c").groupBy(by, "i").agg(*(F.max(F.when(F.col("k") == k, F.col("c"))).alias(k) for k in ends))
    both = join_keys(level, met, [by, "i"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # sum from i - half to i + half, the ends of an even period at half weight
    full = F.col("hi") - zero("lo1")
    twice = F.when(F.col("period") % 2 == 0, ((F.col("hi") - zero("hi1")) + (F.col("lo") - zero("lo1"))) / 2).otherwise(0.0)
    inside = (i >= half) & (i + half < F.col("n"))
    own = both.withColumn("t", F.when(inside & (F.col("n") > F.col("period") + (F.col("period") % 2 == 0).cast("int")), (full - twice) / F.col("period") + F.col("mean")))
    edges = own.groupBy(by).agg(F.min_by("t", F.when(F.col("t").isNotNull(), i)).alias("t0"), F.max_by("t", F.when(F.col("t").isNotNull(), i)).alias("t1"))
    trend = F.coalesce("t", F.when(i < half, F.col("t0")).otherwise(F.col("t1")), "mean")
    rest = F.col("x") / F.col("trend") if multiplicative else F.col("x") - F.col("trend")
    out = join_keys(own, edges, [by]).withColumn("trend", trend).withColumn("rest", rest).withColumn("phase", i % F.col("period"))
    phases = out.groupBy(by, "phase").agg(F.avg("rest").alias("m"), F.first("period").alias("length"))
    # phases that a short series does not reach count as zero
    mid = phases.groupBy(by).agg((F.sum("m") / F.first("length")).alias("mid"))
    phases = join_keys(phases.drop("length"), mid, [by])
    seasonal = F.col("m") / F.col("mid") if multiplicative else F.col("m") - F.col("mid")
    out = join_keys(out, phases.select(by, "phase", seasonal.alias("seasonal")), [by, "phase"])
    residual = F.col("rest") / F.col("seasonal") if multiplicative else F.col("rest") - F.col("seasonal")
    return out.select(by, order, "trend", "seasonal", residual.alias("residual"))


#: The db4 scaling filter.
DB4 = (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278)
HIGH = tuple(x * (-1.0) ** k for k, x in enumerate(reversed(DB4)))


def _dealt(rows: DataFrame, reach: int, block_rows: int) -> DataFrame:
    """Rows in blocks (_block, _at), each with the `reach` rows behind its end; the first rows of a series stand once more behind its end. _own marks the others."""
    # a series shorter than the reach goes round several times
    turns = F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(reach) / F.col("n")).cast("long"))
    wrapped = rows.withColumn("_q", F.explode(turns)).withColumn("_at", F.col("i") + F.col("_q") * F.col("n")).filter(F.col("_at") < F.col("n") + reach)
    block = F.floor(F.col("_at") / block_rows).cast("long")
    begins = F.sequence(F.greatest(F.floor((F.col("_at") - reach) / block_rows).cast("long"), F.lit(0).cast("long")), block)
    dealt = wrapped.withColumn("_block", F.explode(begins))
    return dealt.withColumn("_own", (F.col("_q") == 0) & (block == F.col("_block"))).drop("_q")


def _taps(dealt: DataFrame, by: str, step: int, filters: dict[str, tuple[float, ...]]) -> DataFrame:
    """Adds sum of filter[m] a[at + step m] for each filter; null where a block ends before."""
    w = Window.partitionBy(by, "_block").orderBy("_at")
    ahead = dealt.withColumns({f"_v{m}": F.lead("a", step * m).over(w) for m in range(len(DB4))})

    def fold(weights: tuple[float, ...]) -> Column:
        return reduce(lambda s, m: s + F.col(f"_v{m}") * F.lit(weights[m] / float(np.sqrt(2))), range(len(DB4)), F.lit(0.0))

    return ahead.withColumns({name: fold(weights) for name, weights in filters.items()}).drop(*(f"_v{m}" for m in range(len(DB4))))


def wavelet_bank(df: DataFrame, levels: int = 3, col: str = "close", by: str = "symbol", order: str = "ts", block_rows: int = 100_000) -> DataFrame:
    """(by, order, detail_1, ..., approximation): undecimated db4 details and the last approximation, periodic ends, any length.

    Each level filters the approximation before it at twice the distance; blocks of a series overlap by the reach of all levels'
    filters, so that rows are dealt and sorted once for all of them.
    """
    rows = positions(df, col, by, order).withColumnRenamed("x", "a")
    rows = _dealt(rows, ((1 << levels) - 1) * (len(DB4) - 1), block_rows)
    for k in range(1, levels + 1):
        rows = _taps(rows, by, 1 << (k - 1), {f"detail_{k}": HIGH, "_next": DB4}).drop("a").withColumnRenamed("_next", "a")
    return rows.filter("_own").select(by, order, *(f"detail_{k}" for k in range(1, levels + 1)), F.col("a").alias("approximation"))
