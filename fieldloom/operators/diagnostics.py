"""Dataset diagnostics as queries: background models, clusters, misdetections, radial shapes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import robust_stats


def votes(pixels: DataFrame, value: str, by: list[str], bins: int) -> DataFrame:
    """AGG-VOTE: one vote per pixel at its rounded value (half to even): a histogram for ``robust_stats``."""
    at = F.least(F.greatest(F.rint(value), F.lit(0)), F.lit(bins - 1)).cast("int")
    return pixels.select(*by, at.alias("bin")).groupBy(*by, "bin").agg(F.count("*").alias("w"))


def circular_resultant(df: DataFrame, value: str, weight: str, by: list[str], period: float) -> DataFrame:
    """AGG-CIRC: weighted circular mean and deviation; zero weight gives (0, 0)."""
    theta = F.col(value) * (2 * math.pi / period)
    sums = df.groupBy(*by).agg(F.sum(weight).alias("w"), F.sum(F.col(weight) * F.cos(theta)).alias("c"), F.sum(F.col(weight) * F.sin(theta)).alias("s"))
    c, s, safe = F.col("c") / F.col("safe"), F.col("s") / F.col("safe"), F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)
    r = F.least(F.greatest(F.sqrt(c * c + s * s), F.lit(1e-12)), F.lit(1.0))
    mean = F.pmod(F.atan2(s, c), F.lit(2 * math.pi)) * (period / (2 * math.pi))
    std = F.sqrt(-2 * F.log(r)) * (period / (2 * math.pi))
    return sums.withColumn("safe", safe).select(*by, F.when(F.col("w") > 0, mean).otherwise(0.0).alias("circ_mean"), F.when(F.col("w") > 0, std).otherwise(0.0).alias("circ_std"))


def variance_partition(pixels: DataFrame, circular: bool, period: int, min_count: int) -> DataFrame:
    """AGG-VARPART over ``(mu, sigma, n)`` of pixels: variance over time within pixels, and between them.

    One row; with no valid pixel only ``valid_px`` (0) is set.
    """
    own = pixels.where(F.col("n") >= max(min_count, 1))
    n, mu, sd = F.col("n"), F.col("mu"), F.col("sigma")
    theta = mu * (2 * math.pi / period)
    a = own.agg(
        F.count("*").alias("valid_px"), F.sum(n).alias("w"), (F.sum(n * sd * sd) / F.sum(n)).alias("within"), (F.sum(n * mu) / F.sum(n)).alias("m"), (F.sum(n * mu * mu) / F.sum(n)).alias("m2"),
        (F.sum(n * F.cos(theta)) / F.sum(n)).alias("c"), (F.sum(n * F.sin(theta)) / F.sum(n)).alias("s"), F.percentile("sigma", F.lit(0.5)).alias("median_pixel_std"),
    )
    if circular:
        r = F.least(F.greatest(F.sqrt(F.col("c") ** 2 + F.col("s") ** 2), F.lit(1e-12)), F.lit(1.0))
        between = -2 * F.log(r) * (period / (2 * math.pi)) ** 2
        mean = F.pmod(F.atan2("s", "c"), F.lit(2 * math.pi)) * (period / (2 * math.pi))
    else:
        between, mean = F.greatest(F.col("m2") - F.col("m") ** 2, F.lit(0.0)), F.col("m")
    a = a.withColumn("between", between).withColumn("total", F.col("within") + F.col("between"))
    return a.select("valid_px", F.sqrt("within").alias("within_std"), F.sqrt("between").alias("between_std"), F.when(F.col("total") > 0, F.col("between") / F.col("total")).when(F.col("valid_px") > 0, 0.0).alias("spatial_fraction"), F.when(F.col("valid_px") > 0, mean).alias("weighted_mean"), "median_pixel_std")


def pixel_stats(hist: DataFrame, bins: int, circular: bool) -> DataFrame:
    """AGG-PXSTATS: robust statistics and count per pixel from ``(y, x, bin, w)``."""
    n = hist.groupBy("y", "x").agg(F.sum("w").alias("n"))
    return robust_stats(hist, ["y", "x"], bins, circular).join(n, ["y", "x"])


def global_stats(hist: DataFrame, bins: int, circular: bool) -> DataFrame:
    """AGG-GLOBAL: robust statistics of the histogram summed over the frame."""
    total = hist.groupBy("bin").agg(F.sum("w").alias("w")).withColumn("one", F.lit(1))
    return robust_stats(total, ["one"], bins, circular).drop("one")


def chroma_diagnosis(hist: DataFrame, channels: dict[str, tuple[int, bool]], min_count: int = 10) -> DataFrame:
    """ANA-CHROMA: one row per channel from ``(y, x, channel, bin, w)``.

    The contamination flag tells that the global and the vote-robust mean differ by over 5 % of the bins.
    """
    n = hist.groupBy("y", "x", "channel").agg(F.sum("w").alias("n")).groupBy("y", "x").agg(F.min("n").alias("n"))
    out = None
    for name, (bins, circular) in channels.items():
        own = hist.where(F.col("channel") == name).select("y", "x", "bin", "w")
        px = robust_stats(own, ["y", "x"], bins, circular).join(n, ["y", "x"])
        valid = px.where(F.col("n") >= max(min_count, 1)).withColumn("one", F.lit(1))
        vote = robust_stats(votes(valid, "mu", ["one"], bins), ["one"], bins, circular).select("one", F.col("mu").alias("vote_mean"))
        one = global_stats(own, bins, circular).select(F.lit(1).alias("one"), F.col("mu").alias("g_mean"), F.col("sigma").alias("g_std"))
        part = variance_partition(px, circular, bins, min_count).withColumn("one", F.lit(1))
        row = one.join(part, "one").join(vote, "one", "left").drop("one").withColumn("vote_mean", F.coalesce("vote_mean", F.lit(0.0)))
        d = F.abs(F.col("g_mean") - F.col("vote_mean"))
        far = F.least(d, bins - d) if circular else d
        row = row.select(F.lit(name).alias("channel"), "*", (far > 0.05 * bins).alias("contaminated"))
        out = row if out is None else out.unionByName(row)
    return out


def recommend(diagnosis: DataFrame, space: str = "hsv") -> DataFrame:
    """ANA-RECOMMEND: model kind by the larger spatial fraction, and whether lab is worth a try."""
    a = diagnosis.agg(F.max("spatial_fraction").alias("fraction"), F.max(F.when(F.col("channel") == "c1", F.col("g_mean"))).alias("saturation"))
    model = F.when(F.col("fraction") < 0.15, "global").when(F.col("fraction") < 0.5, "coarse_grid").otherwise("per_pixel")
    return a.select("fraction", model.alias("model"), (F.lit(space == "hsv") & (F.col("saturation") < 40)).alias("try_lab"))


def purity(members: DataFrame) -> DataFrame:
    """AGG-PURITY of ``(cluster, class)``: size, most frequent class (least on ties), its share."""
    n = members.groupBy("cluster", "class").agg(F.count("*").alias("n"))
    return n.groupBy("cluster").agg(F.sum("n").alias("size"), F.max_by("class", F.struct(F.col("n"), -F.col("class"))).alias("dominant"), (F.max("n") / F.sum("n")).alias("purity"))


def class_means(vectors: DataFrame, eps: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """ANA-MIS: standardised vectors ``(id, gt, pred, j, z)`` and class means ``(cls, j, m, raw, n)`` of correct rows.

    ``vectors(id, gt, pred, v array)``; rows with a null vector or class don't count.
    """
    long = vectors.where("gt IS NOT NULL AND pred IS NOT NULL AND v IS NOT NULL").select("id", "gt", "pred", F.posexplode("v").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    st = long.where("gt = pred").groupBy("j").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd")).withColumn("sd", F.when(F.col("sd") < eps, 1.0).otherwise(F.col("sd")))
    z = long.join(F.broadcast(st), "j").withColumn("z", (F.col("x") - F.col("mu")) / F.col("sd"))
    means = z.where("gt = pred").groupBy(F.col("gt").alias("cls"), "j").agg(F.avg("z").alias("m"), F.avg("x").alias("raw"), F.count("*").alias("n"))
    return z.select("id", "gt", "pred", "j", "z"), means


def misdetections(vectors: DataFrame) -> DataFrame:
    """ANA-MIS: for each misdetected row its distance to the means of its class, of the predicted and of the nearest class.

    The table of class means has classes x features rows and is joined by feature.
    """
    z, means = class_means(vectors)
    d = z.where("gt <> pred").join(means.select("cls", "j", "m", "n"), "j").groupBy("id", "gt", "pred", "cls").agg(F.sqrt(F.sum(F.pow(F.col("z") - F.col("m"), F.lit(2.0)))).alias("d"), F.max("n").alias("n"))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("d", "cls")))
    of = lambda c, v: F.max(F.when(F.col("cls") == F.col(c), F.col(v)))
    out = d.groupBy("id", "gt", "pred").agg(of("gt", "d").alias("dist_gt"), of("pred", "d").alias("dist_pred"), of("gt", "rank").alias("gt_rank"), of("gt", "n").alias("gt_mean_n"), F.min_by("cls", "rank").alias("nearest"), F.min("d").alias("nearest_dist"))
    closer = F.when(F.col("dist_gt").isNull() | (F.col("dist_pred") < F.col("dist_gt")), "pred").otherwise("gt")
    return out.select("id", "gt", "pred", F.coalesce("gt_mean_n", F.lit(0)).alias("gt_mean_n"), "dist_gt", "dist_pred", closer.alias("closer_to"), F.coalesce("gt_rank", F.lit(-1)).alias("gt_rank"), "nearest", "nearest_dist")


def group_rms(vectors: DataFrame, groups: dict[str, tuple[int, int]]) -> DataFrame:
    """ANA-MIS: root mean square deviation from the own class's mean over groups of features, over all misdetected rows."""
    z, means = class_means(vectors)
    dev = z.where("gt <> pred").join(means.select(F.col("cls").alias("gt"), "j", "m"), ["gt", "j"]).withColumn("dev", F.col("z") - F.col("m"))
    name = F.lit(None).cast("string")
    for g, (a, b) in groups.items():
        name = F.when((F.col("j") >= a) & (F.col("j") < b), g).otherwise(name)
    return dev.withColumn("grp", name).where("grp IS NOT NULL").groupBy("grp").agg(F.sqrt(F.avg(F.col("dev") * F.col("dev"))).alias("rms"), F.count("*").alias("n"))


def profile_stats(profiles: DataFrame) -> DataFrame:
    """AGG-PROFILE of ``(id, r array)``: mean, population deviation, extremes, range, linear percentiles."""
    long = profiles.select("id", F.explode("r").alias("v"))
    q = lambda p: F.percentile("v", F.lit(p / 100)).alias(f"p{p}")
    return long.groupBy("id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v")).alias("range"), q(10), q(25), q(50), q(75), q(90))


def _by_profile(profiles: DataFrame, columns: list[str], kernel, fields: str) -> DataFrame:
    """Rows that ``kernel(*profiles)`` gives for each id, as arrays; a profile that is null or empty gives none."""
    kind = profiles.schema["id"].dataType.simpleString()
    names = ["id", *[f.split()[0] for f in fields.split(", ")]]

    def run(batches):
        for batch in batches:
            at, parts = [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in columns))):
                if all(row):
                    parts.append(kernel(*(np.asarray(r, float) for r in row)))
                    at += [i] * len(parts[-1][0])
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), *[pa.array(np.concatenate(c)) for c in zip(*parts)]], names=names)

    return profiles.select("id", *columns).mapInArrow(run, f"id {kind}, {fields}")


def fourier(profiles: DataFrame, harmonics: int = 20, ref_max: int = 8) -> DataFrame:
    """ANA-FOURIER of ``(id, r array)``: per harmonic k the magnitude and the phase-normalised parts, by a fast transform where the row is.

    The reference phase is that of the strongest of the first ``ref_max`` harmonics (the lowest on ties).
    """

    def kernel(r: np.ndarray):
        f = np.fft.rfft(r)[1 : min(harmonics, len(r) // 2) + 1]
        k = np.arange(1, len(f) + 1)
        if not len(f):
            return k.astype(np.int32), *[np.zeros(0)] * 3
        k0 = 1 + int(np.round(np.abs(f[:ref_max]), 9).argmax())
        z = f * np.exp(-1j * k * np.angle(f[k0 - 1]) / k0) / len(r)
        return k.astype(np.int32), np.abs(f) / len(r), z.real, z.imag

    return _by_profile(profiles, ["r"], kernel, "k int, mag double, phase_re double, phase_im double")


def best_shift(profiles: DataFrame) -> DataFrame:
    """ANA-REGISTER: ``(id, shift)`` of ``(id, r array, ref array)``: the whole-bin circular shift *of* r relative to
    ref (the lowest of equally good ones, wrapped to [-N/2, N/2)), by a product of transforms. Rolling r by its negative aligns it to ref."""

    def kernel(r: np.ndarray, ref: np.ndarray):
        n = len(r)
        s = int(np.round(np.fft.irfft(np.fft.rfft(r) * np.conj(np.fft.rfft(ref)), n), 9).argmax())
        return (np.array([s - n if s >= (n + 1) // 2 else s], np.int32),)

    return _by_profile(profiles, ["r", "ref"], kernel, "shift int")


def signed_moments(fg: DataFrame) -> DataFrame:
    """ANA-426: third central moments of the foreground, as sign(m) * log1p(|m|)."""
    from fieldloom.functions.expressions import signed_log1p

    item = Window.partitionBy("stem")
    c = fg.withColumn("dx", F.col("x") - F.avg("x").over(item)).withColumn("dy", F.col("y") - F.avg("y").over(item))
    m = lambda i, j: signed_log1p(F.sum(F.pow("dx", F.lit(float(i))) * F.pow("dy", F.lit(float(j))))).alias(f"mu{i}{j}")
    return c.groupBy("stem").agg(m(3, 0), m(0, 3), m(2, 1), m(1, 2))


def polar_profile(fg: DataFrame, h: int, w: int, resolution: int) -> DataFrame:
    """AGG-POLAR: ``(stem, tbin, r_outer, r_inner)`` of the foreground, its centroid moved to the frame's middle by
    whole pixels (clipped at the border); empty bins are interpolated around the circle."""
    item = Window.partitionBy("stem")
    shift = lambda axis, size: F.rint((size - 1) / 2.0 - F.avg(axis).over(item)).cast("int")
    at = fg.select("stem", F.least(F.greatest(F.col("y") + shift("y", h), F.lit(0)), F.lit(h - 1)).alias("y"), F.least(F.greatest(F.col("x") + shift("x", w), F.lit(0)), F.lit(w - 1)).alias("x"))
    dy, dx = F.col("y") - (h - 1) / 2.0, F.col("x") - (w - 1) / 2.0
    tbin = F.least(F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * resolution), F.lit(resolution - 1)).cast("int")
    seen = at.select("stem", tbin.alias("tbin"), F.sqrt(dx * dx + dy * dy).alias("r")).groupBy("stem", "tbin").agg(F.max("r").alias("o"), F.min("r").alias("i"))
    around = seen.select("stem", F.col("o"), F.col("i"), F.explode(F.array(*[F.col("tbin") + k * resolution for k in (-1, 0, 1)])).alias("t"))
    grid = seen.select("stem").distinct().select("stem", F.explode(F.sequence(F.lit(-resolution), F.lit(2 * resolution - 1))).alias("t"))
    both = grid.join(around, ["stem", "t"], "left")
    back, ahead = item.orderBy("t").rowsBetween(Window.unboundedPreceding, 0), item.orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("o").isNotNull(), F.struct("t", "o", "i"))
    both = both.withColumn("a", F.last(here, True).over(back)).withColumn("b", F.first(here, True).over(ahead)).where(f"t >= 0 AND t < {resolution}")
    share = F.when(F.col("b.t") == F.col("a.t"), 0.0).otherwise((F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    line = lambda v: F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * share
    return both.select("stem", F.col("t").alias("tbin"), line("o").alias("r_outer"), line("i").alias("r_inner"))


def zscore_pca(vectors: DataFrame, components: int = 2) -> DataFrame:
    """Z-scores and principal components of ``(id, v array)``; ``layout.embedded`` has the layout and clusters of ANA-EMBED."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = vectors.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("v"))
    z = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(df).transform(df)
    return PCA(k=components, inputCol="z", outputCol="p").fit(z).transform(z).select("id", vector_to_array("p").alias("p"))
