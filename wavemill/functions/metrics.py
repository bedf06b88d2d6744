"""Quality metrics of decompositions: joins and aggregates over ``series_id, component, t, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spectral import dft_magnitude


def reconstruct(parts: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The sum of all components at each sample."""
    return parts.groupBy(*keys, "t").agg(F.sum("value").alias("value"))


def reconstruct_parts(rows: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """As :func:`reconstruct` of ``keys, parts``, arrays of one length in a row: they are added up where they are."""
    first, others = F.get("parts", F.lit(0)), F.slice("parts", 2, F.size("parts"))
    whole = F.aggregate(others, first, lambda s, p: F.zip_with(s, p, lambda x, y: x + y))
    return rows.select(*keys, F.posexplode(whole).alias("t", "value"))


def energy_ratios(modes: DataFrame) -> DataFrame:
    """``series_id, component, energy, ratio``; the ratio is 0 where there is no energy."""
    per = modes.groupBy("series_id", "component").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    total = F.sum("energy").over(W.partitionBy("series_id"))
    return per.withColumn("ratio", F.when(total > 0, F.col("energy") / total).otherwise(F.lit(0.0)))


def component_pairs(modes: DataFrame) -> DataFrame:
    """``series_id, i, j, n, dot, si, sj, ei, ej`` for each pair i < j of a series' components.

    A series has few components. They meet at each sample, so one shuffle by series and
    sample serves all pairs, and the products are summed on the map side.
    """
    met = modes.groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("component", "value"))).alias("c"))
    pairs = F.flatten(
        F.transform(
            F.col("c"),
            lambda a: F.transform(
                F.filter(F.col("c"), lambda b: b["component"] > a["component"]),
                lambda b: F.struct(
                    a["component"].alias("i"), b["component"].alias("j"), a["value"].alias("x"), b["value"].alias("y")
                ),
            ),
        )
    )
    x, y = F.col("p.x"), F.col("p.y")
    return (
        met.select("series_id", F.explode(pairs).alias("p"))
        .groupBy("series_id", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(x * y).alias("dot"),
            F.sum(x).alias("si"),
            F.sum(y).alias("sj"),
            F.sum(x * x).alias("ei"),
            F.sum(y * y).alias("ej"),
        )
    )


def orthogonality(modes: DataFrame) -> DataFrame:
    """``series_id, pairwise, by_energy``: sums over pairs of absolute products, by the pair's norms or by all energy."""
    pairs = component_pairs(modes)
    norm = F.sqrt(F.col("ei") * F.col("ej"))
    per = pairs.groupBy("series_id").agg(
        F.sum(F.when(norm > 0, F.abs("dot") / norm).otherwise(0.0)).alias("pairwise"), F.sum(F.abs("dot")).alias("cross")
    )
    energy = modes.groupBy("series_id").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    return energy.join(per, "series_id", "left").select(
        "series_id",
        F.coalesce("pairwise", F.lit(0.0)).alias("pairwise"),
        F.when(F.col("energy") > 0, F.coalesce("cross", F.lit(0.0)) / F.col("energy")).otherwise(0.0).alias("by_energy"),
    )


def correlations(modes: DataFrame) -> DataFrame:
    """``series_id, i, j, correlation``; 0 where a component does not vary."""
    n = F.col("n")
    vi, vj = F.col("ei") - F.col("si") ** 2 / n, F.col("ej") - F.col("sj") ** 2 / n
    c = F.when((vi > 1e-12) & (vj > 1e-12), (F.col("dot") - F.col("si") * F.col("sj") / n) / F.sqrt(vi * vj)).otherwise(0.0)
    return component_pairs(modes).select("series_id", "i", "j", c.alias("correlation"))


def mean_abs_correlation(modes: DataFrame) -> DataFrame:
    return correlations(modes).groupBy("series_id").agg(F.avg(F.abs("correlation")).alias("mean_abs_correlation"))


def stationarity_degree(frequencies: DataFrame) -> DataFrame:
    """Mean over components of the frequency's variance by its squared mean; ``series_id, component, t, freq``."""
    good = frequencies.where((F.col("freq") >= 0) & ~F.isnan("freq"))
    per = good.groupBy("series_id", "component").agg(
        F.count(F.lit(1)).alias("n"), F.avg("freq").alias("m"), F.var_pop("freq").alias("v")
    )
    return per.where("n >= 2 and m > 0").groupBy("series_id").agg(F.avg(F.col("v") / (F.col("m") * F.col("m"))).alias("degree"))


def mode_overlap(spectra: DataFrame) -> DataFrame:
    """``series_id, i, j, overlap`` of normalised power spectra ``series_id, component, bin, power``."""
    total = F.sum("power").over(W.partitionBy("series_id", "component"))
    share = spectra.withColumn("p", F.when(total > 0, F.col("power") / total).otherwise(0.0))
    met = share.groupBy("series_id", "bin").agg(F.array_sort(F.collect_list(F.struct("component", "p"))).alias("c"))
    pairs = F.flatten(
        F.transform(
            F.col("c"),
            lambda a: F.transform(
                F.filter(F.col("c"), lambda b: b["component"] > a["component"]),
                lambda b: F.struct(a["component"].alias("i"), b["component"].alias("j"), F.least(a["p"], b["p"]).alias("o")),
            ),
        )
    )
    return (
        met.select("series_id", F.explode(pairs).alias("p"))
        .groupBy("series_id", F.col("p.i").alias("i"), F.col("p.j").alias("j"))
        .agg(F.sum("p.o").alias("overlap"))
    )


def severity(overlap: Column) -> Column:
    return F.when(overlap < 0.1, "ok").when(overlap <= 0.3, "caution").otherwise("serious")


def mixing_report(overlaps: DataFrame, listed: float = 0.05) -> DataFrame:
    """Per series: the worst overlap, its severity, the pairs over ``listed`` and what to do about them."""
    worst = F.max("overlap")
    text = (
        F.when(F.col("severity") == "ok", "The modes hold separate frequencies.")
        .when(F.col("severity") == "caution", "Some modes share frequencies; an ensemble method may separate them.")
        .otherwise("Modes are mixed; use an ensemble with adaptive noise or fewer modes.")
    )
    pair = F.when(F.col("overlap") > listed, F.struct((-F.col("overlap")).alias("o"), "i", "j"))
    return (
        overlaps.groupBy("series_id")
        .agg(worst.alias("worst"), F.array_sort(F.collect_list(pair)).alias("p"))
        .withColumn("severity", severity(F.col("worst")))
        .select(
            "series_id",
            "worst",
            "severity",
            F.size("p").cast("long").alias("n_mixed"),
            F.array_join(F.transform("p", lambda x: F.concat_ws("-", x["i"].cast("string"), x["j"].cast("string"))), ",").alias("mixed"),
            text.alias("advice"),
        )
    )


def top_mixed_pairs(overlaps: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` pairs of all series that overlap most (a report, hence the limit)."""
    return overlaps.orderBy(F.col("overlap").desc(), "series_id", "i", "j").limit(n)


def overlap_matrix(overlaps: DataFrame, components: list[int]) -> DataFrame:
    """One row per series and component with a column per component, symmetric, 1 on the diagonal."""
    both = overlaps.unionByName(overlaps.select("series_id", F.col("j").alias("i"), F.col("i").alias("j"), "overlap"))
    own = both.select("series_id", "i").distinct().select("series_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("overlap"))
    return both.unionByName(own).groupBy("series_id", "i").pivot("j", components).agg(F.max("overlap"))


def reconstruction_error(original: DataFrame, parts: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Per series: relative and largest absolute error, energy conservation and whether all is within ``tolerance``."""
    sums = parts.groupBy(F.col("series_id").alias("p_id"), F.col("t").alias("p_t")).agg(
        F.sum("value").alias("sum"), F.sum(F.col("value") * F.col("value")).alias("energy")
    )
    met = original.join(sums, (F.col("series_id") == F.col("p_id")) & (F.col("t") == F.col("p_t")), "left")
    d = F.col("value") - F.coalesce("sum", F.lit(0.0))
    agg = met.groupBy("series_id").agg(
        F.sqrt(F.sum(d * d)).alias("d"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("x"),
        F.max(F.abs(d)).alias("max_error"),
        F.sum("energy").alias("energy"),
    )
    return agg.select(
        "series_id",
        F.when(F.col("x") < 1e-12, 0.0).otherwise(F.col("d") / F.col("x")).alias("relative_error"),
        "max_error",
        F.when(F.col("x") < 1e-6, 1.0).otherwise(F.col("energy") / (F.col("x") * F.col("x"))).alias("energy_conservation"),
        (F.col("max_error") <= tolerance).alias("valid"),
    )


def boundary_artifact(df: DataFrame, edge: int = 10) -> DataFrame:
    """Per series: deviation of the first and last ``edge`` samples by that of the rest; 1 where the rest is flat."""
    n = F.count(F.lit(1)).over(W.partitionBy("series_id"))
    at_edge = (F.col("t") < edge) | (F.col("t") >= F.col("n") - edge)
    agg = df.withColumn("n", n).groupBy("series_id").agg(
        F.stddev_pop(F.when(at_edge, F.col("value"))).alias("e"), F.stddev_pop(F.when(~at_edge, F.col("value"))).alias("i")
    )
    return agg.select("series_id", F.when(F.coalesce("i", F.lit(0.0)) < 1e-12, 1.0).otherwise(F.col("e") / F.col("i")).alias("artifact"))


def boundary_artifact_rms(df: DataFrame, edge: int = 10, margin: int = 10) -> DataFrame:
    """Per series: root mean square of the first and last ``edge`` samples by that of the interior.

    The interior leaves out ``edge`` samples and ``margin`` more on either side; 1 where it is empty or flat.
    """
    n = F.count(F.lit(1)).over(W.partitionBy("series_id"))
    at_edge = (F.col("t") < edge) | (F.col("t") >= F.col("n") - edge)
    inside = (F.col("t") >= edge + margin) & (F.col("t") < F.col("n") - edge - margin)
    rms = lambda c: F.sqrt(F.avg(F.when(c, F.col("value") * F.col("value"))))
    agg = df.withColumn("n", n).groupBy("series_id").agg(rms(at_edge).alias("e"), rms(inside).alias("i"))
    return agg.select("series_id", F.when(F.coalesce("i", F.lit(0.0)) < 1e-12, 1.0).otherwise(F.col("e") / F.col("i")).alias("artifact"))


def spectral_distortion(original: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Per series: divergence of the original's magnitude spectrum from that of what was rebuilt of it."""
    p, q = (dft_magnitude(x).withColumnRenamed("magnitude", "power") for x in (original, rebuilt))
    return kl_divergence(p, q).withColumnRenamed("kl", "distortion")


def kl_divergence(p: DataFrame, q: DataFrame, floor: float = 1e-10) -> DataFrame:
    """Per series: divergence of ``series_id, bin, power`` of p from q, both normalised."""
    total = lambda: F.sum("power").over(W.partitionBy("series_id"))
    a = p.select("series_id", "bin", F.greatest(F.col("power") / total(), F.lit(floor)).alias("p"))
    b = q.select("series_id", "bin", F.greatest(F.col("power") / total(), F.lit(floor)).alias("q"))
    return a.join(b, ["series_id", "bin"]).groupBy("series_id").agg(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("kl"))


def layer_statistics(parts: DataFrame) -> DataFrame:
    """Mean, variance and energy by component and layer, and over all layers (null ``z``)."""
    return parts.rollup("volume_id", "component", "z").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("variance"), F.sum(F.col("value") * F.col("value")).alias("energy")
    ).where("component is not null")


def z_slices(volume: DataFrame) -> DataFrame:
    """Each slice of ``volume_id, z, y, x, value`` as an image: ``image_id`` (volume and z), ``row, col, value``."""
    return volume.select(F.struct("volume_id", "z").alias("image_id"), F.col("y").alias("row"), F.col("x").alias("col"), "value")


def z_columns(volume: DataFrame) -> DataFrame:
    """Each line along z as a signal: ``series_id`` (volume, y and x), ``t, value``."""
    return volume.select(F.struct("volume_id", "y", "x").alias("series_id"), F.col("z").alias("t"), "value")


def equal_mode_counts(parts: DataFrame) -> DataFrame:
    """All series with as many modes as the one with most; modes that a series lacks are zero.

    ``parts`` are ``series_id, component, kind, t, value``; the residue stays and is numbered last.
    """
    most = parts.where("kind = 'imf'").agg(F.coalesce(F.max("component"), F.lit(0)).alias("most"))
    rest = parts.where("kind = 'residue'").select("series_id", "t", "value", F.col("component").alias("own"))
    filled = rest.join(F.broadcast(most)).where("own <= most").select(
        "series_id", F.explode(F.sequence("own", "most")).alias("component"), F.lit("imf").alias("kind"), "t", F.lit(0.0).alias("value")
    )
    last = rest.join(F.broadcast(most)).select("series_id", (F.col("most") + 1).cast("int").alias("component"), F.lit("residue").alias("kind"), "t", "value")
    return parts.where("kind = 'imf'").select(*last.columns).unionByName(filled).unionByName(last)


def validate_collection(parts: DataFrame) -> DataFrame:
    """Per series of components: their number, the samples of the shortest and longest, and ``status``."""
    per = parts.groupBy("series_id", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("value").isNull() | F.isnan("value")).cast("int")).alias("bad")
    )
    agg = per.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("components"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("bad").alias("bad")
    )
    status = F.when(F.col("bad") > 0, "invalid_value").when(F.col("shortest") != F.col("longest"), "dimension_mismatch").otherwise("ok")
    return agg.select("series_id", "components", "shortest", "longest", status.alias("status"))


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 columns."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    n = lambda c: F.sum(c.cast("int")).cast("double")
    agg = df.agg(F.count(F.lit(1)).alias("n"), n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return agg.select(
        "n", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1")
    )


def regression(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean squared and absolute error, root, and the share of variance explained."""
    d = F.col(truth) - F.col(predicted)
    return df.agg(
        F.avg(d * d).alias("mse"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        (1 - F.avg(d * d) / F.var_pop(truth)).alias("r2"),
    )
