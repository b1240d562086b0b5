"""Mock catalogs whose random numbers are hashes of row keys, so that they do not depend on partitions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skyloom.functions.cosmology import Cosmology
from skyloom.operators import mesh as M
from skyloom.operators.numbering import dense_index


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) for each key."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def normal(seed: int, *keys: Column | str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 7919, *keys))


def poisson(mean: Column, seed: int, *keys: Column | str, most: int = 24) -> Column:
    """Poisson numbers by inversion; a mean above 5 is the sum of as many independent numbers of a smaller mean as it needs."""
    steps = F.greatest(F.lit(1), F.ceil(mean / 5).cast("int"))
    share = mean / steps

    def one(u: Column) -> Column:
        # A running product and sum of the probabilities of 0, 1, 2, ...
        start = F.struct(F.exp(-share).alias("p"), F.exp(-share).alias("total"), F.lit(0).alias("n"))

        def add(a: Column, i: Column) -> Column:
            p = a["p"] * share / i
            return F.struct(p.alias("p"), (a["total"] + p).alias("total"), (a["n"] + (u > a["total"]).cast("int")).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, add)["n"]

    return F.aggregate(F.sequence(F.lit(1), steps), F.lit(0), lambda a, j: a + one(F.when(j == 1, uniform(seed, *keys)).otherwise(uniform(seed, *keys, j))))


def random_catalog(spark: SparkSession, n: int) -> DataFrame:
    if n <= 0:
        raise ValueError("a catalog needs at least one object")
    return spark.range(n)


def uniform_catalog(spark: SparkSession, nbar: float, box: float, seed: int = 42) -> DataFrame:
    """N ~ Poisson(nbar V) objects: positions uniform in the box, velocities uniform in 1 % of it."""
    n = int(np.random.default_rng(seed).poisson(nbar * box**3))
    cols = [(uniform(seed + i, "id") * box).alias(a) for i, a in enumerate("xyz")]
    return random_catalog(spark, n).select("id", *cols, *[(uniform(seed + 3 + i, "id") * (0.01 * box)).alias(f"v{a}") for i, a in enumerate("xyz")])


def gaussian_modes(spark: SparkSession, n: int, box: float, power, seed: int = 42, unitary: bool = False, inverted: bool = False) -> DataFrame:
    """Modes of a Gaussian field of the given power (a function of k): white noise in real space, transformed and scaled."""
    cells = M.all_cells(spark, n)
    g = normal(seed, *M.CELL)
    white = M.fft(cells.select(*M.CELL, (g * (-1.0 if inverted else 1.0)).alias("v")), n)
    k = np.geomspace(1e-4, 10 * math.pi * n / box, 4096)
    table = spark.sparkContext.broadcast((np.log(k), np.log(np.maximum(power(k), 1e-300))))
    @F.pandas_udf(DoubleType())
    def root_power(x: pd.Series) -> pd.Series:
        lk = np.log(np.maximum(x.to_numpy(), 1e-12))
        return pd.Series(np.where(x > 0, np.sqrt(np.exp(np.interp(lk, *table.value))), 0.0))

    m = M.with_wavenumbers(white, n, box)
    scale = root_power("k") * math.sqrt(n**3 / box**3)
    if unitary:
        size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) * math.sqrt(n**3)
        scale = scale / F.when(size > 0, size).otherwise(1.0)
    return m.select(*M.CELL, (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def lognormal_catalog(spark: SparkSession, cosmo: Cosmology, redshift: float, nbar: float, box: float, n: int, bias: float = 2.0, seed: int = 42) -> DataFrame:
    """Poisson sample of a lognormal field, moved by the linear displacement; velocity = f 100 E / (1 + z) * displacement."""
    modes = gaussian_modes(spark, n, box, lambda k: cosmo.linear_power(k, redshift), seed)
    delta = M.ifft(modes, n)
    lagrangian = bias - 1
    raw = delta.withColumn("e", F.exp(lagrangian * F.col("v")))
    mean = raw.agg(F.avg("e")).first()[0]
    m = M.with_wavenumbers(modes, n, box)
    cells = raw.withColumn("number", poisson(F.col("e") * (nbar * (box / n) ** 3 / mean), seed + 1, *M.CELL))
    for a in "xyz":
        f = F.when(F.col("n2") == 0, 0.0).otherwise(F.col(f"n{a}") * (2 * math.pi / box) / (F.col("k") * F.col("k")))
        psi = M.ifft(m.select(*M.CELL, (-F.col("im") * f).alias("re"), (F.col("re") * f).alias("im")), n)
        cells = cells.join(psi.withColumnRenamed("v", f"psi{a}"), M.CELL)
    objects = cells.where("number > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "number")))
    rate = float(cosmo.growth_rate(redshift) * 100 * cosmo.efunc(redshift) / (1 + redshift))
    where = [F.pmod((F.col(c) + uniform(seed + 10 + i, *M.CELL, "copy")) * (box / n) + F.col(f"psi{a}"), F.lit(float(box))).alias(a) for i, (c, a) in enumerate(zip(M.CELL, "xyz", strict=True))]
    return dense_index(objects, [*M.CELL, "copy"], "id").select("id", *where, *[(F.col(f"psi{a}") * rate).alias(f"v{a}") for a in "xyz"])


def zheng07_means(mass: Column, log_m_min: float = 13.031, sigma: float = 0.38, alpha: float = 0.76, log_m0: float = 13.27, log_m1: float = 14.08) -> tuple[Column, Column]:
    """Mean numbers of centrals and satellites of a halo; the error function by a rational approximation (1.5e-7)."""
    x = (F.log10(mass) - log_m_min) / sigma
    t = 1 / (1 + 0.3275911 * F.abs(x))
    tail = (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    central = 0.5 * (1 + F.signum(x) * (1 - tail))
    m0, m1 = 10**log_m0, 10**log_m1
    return central, F.when(mass > m0, central * F.pow((mass - m0) / m1, F.lit(alpha))).otherwise(0.0)


def populate(halos: DataFrame, seed: int = 42, concentration: float = 7.0, **model) -> DataFrame:
    """Galaxies of halos (id, x, y, z, mass, radius): a central at the centre, satellites in an isothermal profile out to the radius."""
    cen, sat = zheng07_means(F.col("mass"), **model)
    n = halos.withColumn("cen", (uniform(seed, "id") < cen).cast("int")).withColumn("sat", poisson(sat, seed + 1, "id"))
    out = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("sat")))).where((F.col("k") > 0) | (F.col("cen") == 1))
    r = F.when(F.col("k") == 0, 0.0).otherwise(F.col("radius") * uniform(seed + 2, "id", "k"))
    mu, phi = 2 * uniform(seed + 3, "id", "k") - 1, 2 * math.pi * uniform(seed + 4, "id", "k")
    s = F.sqrt(1 - mu * mu)
    where = [(F.col("x") + r * s * F.cos(phi)).alias("x"), (F.col("y") + r * s * F.sin(phi)).alias("y"), (F.col("z") + r * mu).alias("z")]
    return out.select(F.col("id").alias("halo_id"), F.when(F.col("k") == 0, 0).otherwise(1).alias("gal_type"), *where, "mass")
