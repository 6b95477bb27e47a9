"""Statistics: summary (A8), percentile bootstrap of the mean (A9), bootstrap of a difference of
means (A10), and the bootstrap quantile pick (L7).

Groups can be huge (one judge may own a third of all rows), so nothing here windows a
whole group in one task: the median comes from value counts, dense ranks from the
sliced running count, and a bootstrap resample is drawn as multinomial counts over the value
histogram instead of as values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import bound
from assay.operators.cumulative import materialised, running_sum


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Interpolated median (mean of the two middle order statistics) from cumulative value counts."""
    from assay.operators.metrics import cumulative_counts

    g = list(group)
    h = cumulative_counts(df, g, value)
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)
    # value at 0-based rank k is the one whose [cum - c, cum) range holds k
    at = lambda k: (F.col("_cum") - F.col("_c") <= k) & (k < F.col("_cum"))
    return h.groupBy(*g).agg(
        ((F.max(F.when(at(lo), F.col(value))) + F.max(F.when(at(hi), F.col(value)))) / 2.0).alias(out))


def summary_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Count, mean, interpolated median, sample variance (0 when n = 1), std dev."""
    g = list(group)
    base = df.where(F.col(value).isNotNull()).groupBy(*g).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))
    med = exact_median(df, g, value, "median")
    return base.join(med, g).select(
        *g, "count", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"),
        F.round("variance", 6).alias("variance"), F.round(F.sqrt("variance"), 6).alias("std_dev"))


def dense_index(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "_idx") -> DataFrame:
    """0-based position of each row inside its group in ``order`` (must be total), computed with the
    sliced running count - no whole-group window."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_sum(ones, list(group), list(order), "_one", "_rn")
    return ranked.withColumn(out, F.col("_rn") - 1).drop("_one", "_rn")


def quantile_index(confidence: float, iterations: int) -> tuple[int, int]:
    """lower = int(a/2 * B), upper = min(int((1 - a/2) * B), B - 1), computed in Python float."""
    alpha = 1.0 - confidence
    return int((alpha / 2.0) * iterations), min(int((1.0 - alpha / 2.0) * iterations), iterations - 1)


# --- multinomial bootstrap -------------------------------------------------------------

# Heights of the value tree that one array holds: 2**BLOCK_BITS children.
BLOCK_BITS = 10
# Splits with a smaller mean are drawn by the exact inverse of the distribution function.
SMALL_MEAN = 12.0
UNIFORM_BITS = 52
# Coefficients of the rational approximation of the normal quantile (P. Acklam; fixed values).
QUANTILE_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
              -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
              4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
QUANTILE_LOW = 0.02425


def _horner(x: Column, coefficients: Sequence[float], one: bool) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out * x + F.lit(1.0) if one else out


def normal_quantile(u: Column) -> Column:
    """z with Phi(z) = u, for 0 < u < 1."""
    def low(v: Column) -> Column:
        t = F.sqrt(F.lit(-2.0) * F.log(v))
        return _horner(t, QUANTILE_C, False) / _horner(t, QUANTILE_D, True)

    d = u - F.lit(0.5)
    middle = _horner(d * d, QUANTILE_A, False) * d / _horner(d * d, QUANTILE_B, True)
    return F.when(u < QUANTILE_LOW, low(u)).when(u > 1.0 - QUANTILE_LOW, -low(F.lit(1.0) - u)).otherwise(middle)


def binomial_quantile(n: Column, p: Column, u: Column) -> Column:
    """The u-quantile of Binomial(n, p): by summing the mass function where the smaller side's mean is
    below ``SMALL_MEAN``, else from the normal quantile with the skewness term (error below one draw)."""
    one = F.lit(1.0)

    def summed(s: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            return bound({"f": a["f"] * ((s["n"] - i + 1) / i) * s["odds"], "c": a["c"], "x": a["x"]}, lambda t: F.struct(
                t["f"].alias("f"), (t["c"] + t["f"]).alias("c"), (t["x"] + F.when(s["u"] > t["c"] + t["f"], 1).otherwise(0)).alias("x")))

        start = F.struct(s["first"].alias("f"), s["first"].alias("c"), F.when(s["u"] > s["first"], 1).otherwise(0).cast("bigint").alias("x"))
        last = F.least(s["n"].cast("bigint"), F.ceil(s["mean"] + F.lit(8.0) * F.sqrt(s["mean"]) + F.lit(12.0)))
        return F.aggregate(F.sequence(F.lit(1).cast("bigint"), last), start, step, lambda a: a["x"])

    def near(s: Column) -> Column:
        skew = lambda z: (z * z - one) * (one - F.lit(2.0) * s["r"]) / F.lit(6.0)
        return bound({"z": normal_quantile(s["u"])}, lambda t: F.floor(
            s["mean"] + F.sqrt(s["mean"] * (one - s["r"])) * t["z"] + skew(t["z"]) + F.lit(0.5)))

    def smaller(s: Column) -> Column:
        draws = F.when(s["mean"] < SMALL_MEAN, bound({"n": s["n"], "u": s["u"], "mean": s["mean"], "odds": s["r"] / (one - s["r"]),
                                                      "first": F.pow(one - s["r"], s["n"])}, summed)).otherwise(near(s))
        return F.least(F.greatest(draws, F.lit(0).cast("bigint")), s["n"].cast("bigint"))

    def drawn(s: Column) -> Column:
        own = bound({"n": s["n"], "u": s["u"], "r": s["r"], "mean": s["n"] * s["r"]}, smaller)
        return bound({"n": s["n"], "p": s["p"], "x": own}, lambda t: F.when(t["p"] <= 0.5, t["x"]).otherwise(t["n"].cast("bigint") - t["x"]))

    return bound({"n": n, "u": u, "p": p}, lambda s: bound(
        {"n": s["n"], "u": s["u"], "p": s["p"], "r": F.least(s["p"], one - s["p"])}, drawn))


def _uniform(seed: int, tag: Column, b: Column, height: Column, node: Column) -> Column:
    """A number in (0, 1) for a node of the value tree in an iteration."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), tag, b.cast("string"), height.cast("string"), node.cast("string")))
    return (F.conv(F.substring(h, 1, UNIFORM_BITS // 4), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2 ** UNIFORM_BITS))


def _split(draws: Column, pyramid: Column, seed: int, tag: Column, b: Column, parent: Column, base: int, levels: int) -> Column:
    """Draws of a block's children from the draws of the block, halving it level by level.

    ``pyramid[l]`` holds the counts of the 2**l nodes at depth l; a node's children are 2i and 2i + 1.
    """
    def level(current: Column, depth: Column) -> Column:
        def halves(m: Column, i: Column) -> Column:
            left, total = F.get(F.get(pyramid, depth + 1), 2 * i), F.get(F.get(pyramid, depth), i)
            u = _uniform(seed, tag, b, F.lit(base + levels) - depth, F.call_function("shiftleft", parent, depth) + i)
            x = F.when((m == 0) | (left == total), m).otherwise(
                binomial_quantile(m.cast("double"), left.cast("double") / total.cast("double"), u))
            return bound({"m": m, "x": x}, lambda s: F.array(s["x"], s["m"] - s["x"]))

        return F.flatten(F.transform(current, halves))

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), F.array(draws.cast("bigint")), level)


def _sum_of(counts: Column, span: int) -> Callable[[Column], Column]:
    return lambda at: F.aggregate(F.slice(counts, at, span), F.lit(0).cast("bigint"), lambda a, c: a + c)


def _pyramid(counts: Column, levels: int) -> Column:
    """Counts of the nodes above an array of at most 2**levels counts, from the root down to the array itself."""
    rows = [F.concat(counts, F.array_repeat(F.lit(0).cast("bigint"), F.lit(1 << levels) - F.size(counts)))]
    for height in range(1, levels + 1):
        span = 1 << height
        starts = F.sequence(F.lit(1), F.lit((1 << levels) - span + 1), F.lit(span))
        rows.append(F.transform(starts, _sum_of(rows[0], span)))
    return F.array(*rows[::-1])


def bootstrap_means(df: DataFrame, group: str, value: str, iterations: int = 1000, seed: int = 42,
                    tag: str | None = None) -> DataFrame:
    """Per (group, iteration) the mean of a resample of the group's n values, without drawing values.

    A resample is a multinomial count over the histogram of the D distinct values.  The n draws go
    down a binary tree over the values in order: a node's draws are split between its halves by a
    binomial whose uniform is a hash of (seed, group, iteration, height, node), so work is D * B
    however large n is, and results don't depend on how rows are laid out.  Blocks of
    2**BLOCK_BITS children are split inside one row; only blocks that received draws go on to
    the next stage, joined to their children.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    ranked = materialised(dense_index(hist, ["_g"], ["_v"], "_idx"), "value-counts")
    label = F.col("_g").cast("string") if tag is None else F.lit(tag)
    bits = max(1, int(ranked.agg(F.max("_idx")).first()[0] or 0).bit_length())
    bases = list(range(0, bits, BLOCK_BITS))[::-1]
    sizes = ranked.groupBy("_g").agg(F.sum("_c").alias("_n"))
    # few rows, much work in each: dealt by (group, iteration) over all task slots
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    draws = sizes.select("_g", F.col("_n").alias("_m"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("_b"),
                         F.lit(0).cast("bigint").alias("_p")).repartition(parts, "_g", "_b")
    for base in bases:
        levels = min(BLOCK_BITS, bits - base)
        nodes = ranked.groupBy("_g", F.shiftright("_idx", base).alias("_k")).agg(
            F.sum("_c").alias("_c"), F.min("_v").alias("_v")) if base else ranked.select("_g", F.col("_idx").alias("_k"), "_c", "_v")
        blocks = nodes.groupBy("_g", F.shiftright("_k", levels).alias("_p")).agg(
            F.array_sort(F.collect_list(F.struct("_k", "_c", "_v"))).alias("_s")).select(
            "_g", "_p", F.col("_s._c").alias("_s"), F.col("_s._v").alias("_v")).select(
            "_g", "_p", _pyramid(F.col("_s"), levels).alias("_t"), "_v")
        split = draws.join(blocks, ["_g", "_p"]).select(
            "_g", "_b", "_p", "_v", _split(F.col("_m"), F.col("_t"), seed, label, F.col("_b"), F.col("_p"), base, levels).alias("_x"))
        if base:
            child = split.select("_g", "_b", "_p", F.posexplode("_x").alias("_i", "_m")).where("_m > 0")
            draws = child.select("_g", "_b", "_m", (F.col("_p") * (1 << levels) + F.col("_i")).alias("_p"))
    product = F.zip_with("_x", "_v", lambda x, v: F.coalesce(x * v, F.lit(0.0)))
    sums = split.select("_g", "_b", F.aggregate(product, F.lit(0.0), lambda a, x: a + x).alias("_s")).groupBy("_g", "_b").agg(
        F.sum("_s").alias("_s"))
    return sums.join(sizes, "_g").select("_g", "_b", (F.col("_s") / F.col("_n")).alias("_mean"))


def bootstrap_ci(df: DataFrame, group: str, value: str, id_col: str, confidence: float = 0.95,
                 iterations: int = 1000, seed: int = 42, mode: str = "hash") -> DataFrame:
    """A9 (+L7): percentile bootstrap interval of the mean per group.

    ``mode="hash"`` (default, at every size) - hash-seeded multinomial counts over the value histogram;
    ``mode="poisson"`` - Poisson(1) weights per row, B running sums per partition.
    n = 1 gives a point interval; n < 10 adds a warning.
    """
    lo, hi = quantile_index(confidence, iterations)
    if mode == "hash":
        means = bootstrap_means(df, group, value, iterations, seed)
    elif mode == "poisson":
        means = poisson_means(df, group, value, id_col, iterations, seed)
    else:
        raise ValueError(f"unknown bootstrap mode {mode!r}")
    ends = means.groupBy("_g").agg(F.array_sort(F.collect_list("_mean")).alias("_m")).select(
        F.col("_g").alias(group), F.try_element_at("_m", F.lit(lo + 1)).alias("_lo"), F.try_element_at("_m", F.lit(hi + 1)).alias("_hi"))
    summ = df.where(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("sample_size"), F.avg(value).alias("_mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"), F.first(value).alias("_only"))
    j = summ.join(ends, group, "left")
    one = F.col("sample_size") == 1
    warn = F.when(F.col("sample_size") < 10, F.concat(
        F.lit("Small sample size ("), F.col("sample_size").cast("string"),
        F.lit(" < 10); confidence intervals may be wide or unstable."))).otherwise(F.lit(""))
    return j.select(
        group, "sample_size",
        F.round("_mean", 6).alias("mean"),
        F.round(F.when(one, F.col("_only")).otherwise(F.col("_lo")), 6).alias("ci_lower"),
        F.round(F.when(one, F.col("_only")).otherwise(F.col("_hi")), 6).alias("ci_upper"),
        F.lit(float(confidence)).alias("confidence_level"),
        F.round(F.when(one, F.lit(0.0)).otherwise(F.col("_sd")), 6).alias("std_dev"),
        warn.alias("warning"), F.lit(mode).alias("mode"))


def pairwise_delta_ci(df: DataFrame, group: str, value: str, id_col: str, a: str, b: str,
                      confidence: float = 0.95, iterations: int = 1000, seed: int = 42) -> DataFrame:
    """A10: bootstrap interval of mean(a) - mean(b); both samples resampled in every iteration
    (independent hash streams 'a' and 'b')."""
    lo, hi = quantile_index(confidence, iterations)
    sa = df.where(F.col(group) == a)
    sb = df.where(F.col(group) == b)
    ma = bootstrap_means(sa, group, value, iterations, seed, tag="a").select("_b", F.col("_mean").alias("_ma"))
    mb = bootstrap_means(sb, group, value, iterations, seed, tag="b").select("_b", F.col("_mean").alias("_mb"))
    deltas = ma.join(mb, "_b").select((F.col("_ma") - F.col("_mb")).alias("_d"))
    ends = deltas.agg(F.array_sort(F.collect_list("_d")).alias("_s")).select(
        F.element_at("_s", lo + 1).alias("ci_lower"), F.element_at("_s", hi + 1).alias("ci_upper"))
    means = df.where(F.col(group).isin(a, b)).agg(
        (F.avg(F.when(F.col(group) == a, F.col(value))) - F.avg(F.when(F.col(group) == b, F.col(value))))
        .alias("delta_mean"))
    # two one-row results: stack them and take the non-null field of each (no join needed)
    both = means.select("delta_mean", F.lit(None).cast("double").alias("ci_lower"),
                        F.lit(None).cast("double").alias("ci_upper")).unionByName(
        ends.select(F.lit(None).cast("double").alias("delta_mean"), "ci_lower", "ci_upper"))
    one = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("delta_mean", "ci_lower", "ci_upper")])
    return one.select(
        F.lit(a).alias("sample_a"), F.lit(b).alias("sample_b"), F.round("delta_mean", 6).alias("delta_mean"),
        F.round("ci_lower", 6).alias("ci_lower"), F.round("ci_upper", 6).alias("ci_upper"))


# --- Poisson bootstrap -----------------------------------------------------------------

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)) & _MASK
    x = ((x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)) & _MASK
    return x ^ (x >> np.uint64(31))


# Poisson(1) cumulative probabilities for k = 0..15.
_POIS_CDF = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) if k else np.exp(-1.0) for k in range(16)])


def _poisson_fn(iterations: int, seed: int):
    def fn(batches):
        acc: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            keys = pd.util.hash_pandas_object(pdf["_id"].astype(str), index=False).to_numpy(dtype=np.uint64)
            b = np.arange(iterations, dtype=np.uint64)
            with np.errstate(over="ignore"):
                h = _splitmix(keys[:, None] * np.uint64(1_000_003) + b[None, :] + np.uint64(seed))
            u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            w = np.searchsorted(_POIS_CDF, u).astype(np.float64)
            v = pdf["_v"].to_numpy(dtype=np.float64)
            for g, idx in pdf.groupby("_g", sort=False).indices.items():
                sw, swv = w[idx].sum(axis=0), (w[idx] * v[idx, None]).sum(axis=0)
                if g in acc:
                    acc[g][0] += sw
                    acc[g][1] += swv
                else:
                    acc[g] = [sw, swv]
        if acc:
            yield pd.DataFrame({"_g": list(acc), "_sw": [a[0].tolist() for a in acc.values()],
                                "_swv": [a[1].tolist() for a in acc.values()]})

    return fn


def poisson_means(df: DataFrame, group: str, value: str, id_col: str, iterations: int = 1000,
                  seed: int = 42) -> DataFrame:
    """Per (group, iteration) the Poisson-weighted mean.  Each partition emits one row of B weight
    sums per group it holds; the rows are summed element-wise - no per-row explosion is shuffled."""
    vals = df.where(F.col(value).isNotNull()).select(
        F.col(group).cast("string").alias("_g"), F.col(value).cast("double").alias("_v"),
        F.col(id_col).cast("string").alias("_id"))
    schema = T.StructType([T.StructField("_g", T.StringType()),
                           T.StructField("_sw", T.ArrayType(T.DoubleType())),
                           T.StructField("_swv", T.ArrayType(T.DoubleType()))])
    part = vals.mapInPandas(_poisson_fn(iterations, seed), schema)
    exploded = part.select("_g", F.posexplode(F.arrays_zip("_sw", "_swv")).alias("_b", "_z"))
    sums = exploded.groupBy("_g", "_b").agg(F.sum("_z._sw").alias("_sw"), F.sum("_z._swv").alias("_swv"))
    # an all-zero-weight resample is empty: its mean is undefined and skipped
    out = sums.select("_g", "_b", F.try_divide(F.col("_swv"), F.col("_sw")).alias("_mean"))
    # restore the caller's group type for the join in bootstrap_ci
    return out.withColumn("_g", F.col("_g").cast(df.schema[group].dataType))
