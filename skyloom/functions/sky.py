"""Column functions of coordinates, weights and filters."""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT_SPEED = 299792.458  # km/s
CRITICAL_DENSITY = 2.77536627e11  # (Msun/h) / (Mpc/h)^3, today
# Rotation from equatorial to galactic axes.
GALACTIC = [
    [-0.0548755604162154, -0.873437090234885, -0.4838350155487132],
    [0.4941094278755837, -0.4448296299600112, 0.7469822444972189],
    [-0.8676661490190047, -0.1980763734312015, 0.4559837761750669],
]


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def to_equatorial(x: Column, y: Column, z: Column, observer=(0.0, 0.0, 0.0), frame: str = "icrs") -> tuple[Column, Column]:
    """Right ascension in [0, 360) and declination, in degrees."""
    d = [c - o for c, o in zip((x, y, z), observer, strict=True)]
    if frame == "galactic":  # coordinates are galactic: turned to equatorial axes first
        d = [sum((GALACTIC[j][i] * d[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    elif frame != "icrs":
        raise ValueError(f"unknown frame {frame}")
    ra = F.degrees(F.atan2(d[1], d[0]))
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.atan2(d[2], F.hypot(d[0], d[1])))


def to_unit_sphere(ra: Column, dec: Column, degrees: bool = True) -> tuple[Column, Column, Column]:
    a, d = (F.radians(ra), F.radians(dec)) if degrees else (ra, dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def to_cartesian(ra: Column, dec: Column, distance: Column, observer=(0.0, 0.0, 0.0)) -> tuple[Column, ...]:
    return tuple(u * distance + o for u, o in zip(to_unit_sphere(ra, dec), observer, strict=True))


def project(v: tuple[Column, ...], direction: tuple[float, ...]) -> tuple[Column, ...]:
    """The part of a vector along a direction."""
    n = math.sqrt(sum(c * c for c in direction))
    unit = [c / n for c in direction]
    dot = sum((a * u for a, u in zip(v, unit, strict=True)), F.lit(0.0))
    return tuple(dot * u for u in unit)


def redshift_offset(velocity: Column, redshift: float, efunc: float) -> Column:
    """Displacement in redshift space: v (1 + z) / (100 E)."""
    return velocity * ((1 + redshift) / (100 * efunc))


def fkp_weight(nbar: Column, p0: float) -> Column:
    return F.lit(1.0) / (1.0 + p0 * nbar)


def minimum_image(d: Column, box: float) -> Column:
    return d - F.rint(d / box) * box


def top_hat(k: Column, r: float) -> Column:
    kr = k * r
    return F.when(k == 0, 1.0).otherwise(3 * (F.sin(kr) / (kr * kr * kr) - F.cos(kr) / (kr * kr)))


def gaussian(k: Column, r: float) -> Column:
    return F.exp(k * k * (-r * r / 2))


def legendre(ell: int, mu: Column) -> Column:
    """Legendre polynomial by its recurrence."""
    low, p = F.lit(1.0), mu
    if ell == 0:
        return low
    for n in range(1, ell):
        low, p = p, ((2 * n + 1) * mu * p - n * low) / (n + 1)
    return p


@functools.cache
def _ylm(ell: int, m: int) -> tuple[float, list[float]]:
    """The norm of a real spherical harmonic and the coefficients of z in it."""
    import numpy as np

    a = abs(m)
    # Derivatives of Legendre polynomials as coefficients of z, by the polynomial's own coefficients.
    c = np.polynomial.legendre.leg2poly([0] * ell + [1])
    for _ in range(a):
        c = np.polynomial.polynomial.polyder(c)
    return math.sqrt((2 * ell + 1) / (4 * math.pi) * math.factorial(ell - a) / math.factorial(ell + a) * (2 if m else 1)), np.atleast_1d(c).tolist()


def real_ylm(ell: int, m: int, x: Column, y: Column, z: Column) -> Column:
    """Real spherical harmonic of a unit vector, for ell up to 4."""
    norm_, c = _ylm(ell, m)
    zpart = sum((float(v) * F.pow(z, F.lit(float(i))) if i else F.lit(float(v)) for i, v in enumerate(c)), F.lit(0.0))
    re, im = F.lit(1.0), F.lit(0.0)
    for _ in range(abs(m)):
        re, im = re * x - im * y, re * y + im * x
    return norm_ * (re if m >= 0 else im) * zpart


def ylm_values(ell: int, m: int, x, y, z):
    """The same of arrays."""
    norm_, c = _ylm(ell, m)
    zpart, re, im = c[-1], 1.0, 0.0
    for v in reversed(c[:-1]):
        zpart = zpart * z + v
    for _ in range(abs(m)):
        re, im = re * x - im * y, re * y + im * x
    return norm_ * (re if m >= 0 else im) * zpart


def ylm_powers(ell: int, m: int) -> dict[tuple[int, int, int], float]:
    """s^l Y_lm of a place at the distance s as a homogeneous polynomial: coefficients by powers of x, y and z."""
    norm_, c = _ylm(ell, m)
    # The powers of z are even or odd together, so the rest is a power of s^2.
    circle = {}
    for k in range(abs(m) + 1):
        # (x + i y)^|m|: its real part for m >= 0, its imaginary one otherwise.
        if (k % 2 == 0) == (m >= 0):
            circle[abs(m) - k, k] = math.comb(abs(m), k) * (-1) ** (k // 2)
    out = {}
    for i, v in enumerate(c):
        rest = ell - abs(m) - i
        if v == 0 or rest % 2:
            continue
        for (a, b), u in circle.items():
            for p in range(rest // 2 + 1):
                for q in range(rest // 2 - p + 1):
                    ways = math.comb(rest // 2, p) * math.comb(rest // 2 - p, q)
                    key = (a + 2 * p, b + 2 * q, i + 2 * (rest // 2 - p - q))
                    out[key] = out.get(key, 0.0) + norm_ * v * u * ways
    return out


def halo_radius(mass: Column, density: float, overdensity: float) -> Column:
    return F.pow(3 * mass / (4 * math.pi * overdensity * density), F.lit(1 / 3))


def halo_overdensity(mdef: str, omega_m: float, efunc: float, redshift: float) -> float:
    """The density inside a halo by its mass definition, in units of the critical density at its redshift.

    'vir' is the fit of Bryan and Norman (1998) for flat universes, '200c' so many times the critical and '200m' the mean density.
    """
    of_matter = omega_m * (1 + redshift) ** 3 / efunc**2
    if mdef == "vir":
        return 18 * math.pi**2 + 82 * (of_matter - 1) - 39 * (of_matter - 1) ** 2
    if not re.fullmatch(r"[1-9][0-9]*[cm]", mdef):
        raise ValueError(f"a mass definition is vir, a number with c or a number with m, not {mdef}")
    return int(mdef[:-1]) * (of_matter if mdef[-1] == "m" else 1.0)


def halo_radius_of(mass: Column, omega_m: float, efunc: float, redshift: float, mdef: str = "vir") -> Column:
    """The proper radius in Mpc/h of a halo of so many Msun/h."""
    return halo_radius(mass, CRITICAL_DENSITY * efunc**2, halo_overdensity(mdef, omega_m, efunc, redshift))


def halo_concentration(mass: Column, redshift: float) -> Column:
    """Concentration of NFW halos of virial mass in Msun/h by the published power-law fit of Dutton and Maccio (2014)."""
    b = -0.097 + 0.024 * redshift
    a = 0.537 + (1.025 - 0.537) * math.exp(-0.718 * redshift**1.08)
    return F.pow(F.lit(10.0), a + b * F.log10(mass / 1e12))


def velocity_dispersion(mass: Column, efunc: float) -> Column:
    return 1100 * F.pow(efunc * mass / 1e15, F.lit(0.33333))


def bin_of(x: Column, edges: list[float]) -> Column:
    """The bin [edge, next edge) of x, -1 below and len(edges) - 1 at or above the last edge."""
    low, high = 0, len(edges)  # the number of edges at or below x, by halves

    def find(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low - 1)
        mid = (low + high) // 2
        return F.when(x >= edges[mid], find(mid + 1, high)).otherwise(find(low, mid))

    return F.when(x.isNotNull(), find(low, high))
