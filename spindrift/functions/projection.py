"""Longitude and latitude to the British national grid, as column arithmetic.

WGS84 to the Airy 1830 ellipsoid by the published seven-parameter Helmert transformation, then the
transverse Mercator series of the Ordnance Survey. Accurate to a few metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ellipsoids (a, b), the Helmert parameters and the grid's origin and scale.
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
SHIFT, SCALE, ROTATION = (-446.448, 125.157, -542.060), 20.4894e-6, (-0.1502, -0.2470, -0.8421)
ORIGIN, FACTOR, FALSE = (math.radians(49), math.radians(-2)), 0.9996012717, (400_000.0, -100_000.0)


def national_grid(df: DataFrame, longitude: str, latitude: str, east: str, north: str) -> DataFrame:
    """df with easting and northing in metres. Each step is a column of its own, as all are used several times."""
    steps: list[str] = []

    def step(**columns: Column) -> None:
        nonlocal df
        df = df.withColumns({f"__{k}": v for k, v in columns.items()})
        steps.extend(f"__{k}" for k in columns)

    c = lambda name: F.col(f"__{name}")
    a, b = WGS84
    e2 = 1 - b * b / (a * a)
    step(lat0=F.radians(latitude), lon0=F.radians(longitude))
    step(nu0=a / F.sqrt(1 - e2 * F.sin(c("lat0")) ** 2))
    step(px=c("nu0") * F.cos(c("lat0")) * F.cos(c("lon0")), py=c("nu0") * F.cos(c("lat0")) * F.sin(c("lon0")), pz=c("nu0") * (1 - e2) * F.sin(c("lat0")))
    r = [math.radians(v / 3600) for v in ROTATION]
    s = 1 + SCALE
    step(x=SHIFT[0] + c("px") * s - c("py") * r[2] + c("pz") * r[1], y=SHIFT[1] + c("px") * r[2] + c("py") * s - c("pz") * r[0], z=SHIFT[2] - c("px") * r[1] + c("py") * r[0] + c("pz") * s)
    a, b = AIRY
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    step(flat=F.sqrt(c("x") ** 2 + c("y") ** 2), lon=F.atan2(c("y"), c("x")))
    step(lat1=F.atan2(c("z"), c("flat") * (1 - e2)))
    for k in range(1, 5):
        step(**{f"lat{k + 1}": F.atan2(c("z") + e2 * (a / F.sqrt(1 - e2 * F.sin(c(f"lat{k}")) ** 2)) * F.sin(c(f"lat{k}")), c("flat"))})
    step(sin=F.sin(c("lat5")), cos=F.cos(c("lat5")), t2=F.tan(c("lat5")) ** 2, d=c("lat5") - ORIGIN[0], u=c("lat5") + ORIGIN[0], dl=c("lon") - ORIGIN[1])
    step(nu=a * FACTOR / F.sqrt(1 - e2 * c("sin") ** 2), rho=a * FACTOR * (1 - e2) / F.pow(1 - e2 * c("sin") ** 2, F.lit(1.5)))
    step(eta=c("nu") / c("rho") - 1)
    sin, cos, t2, nu, rho, eta, d, u, dl = (c(k) for k in ("sin", "cos", "t2", "nu", "rho", "eta", "d", "u", "dl"))
    arc = b * FACTOR * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(u) + 1.875 * (n**2 + n**3) * F.sin(2 * d) * F.cos(2 * u) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * u))
    up = arc + FALSE[1] + nu / 2 * sin * cos * dl**2 + nu / 24 * sin * cos**3 * (5 - t2 + 9 * eta) * dl**4 + nu / 720 * sin * cos**5 * (61 - 58 * t2 + t2 * t2) * dl**6
    along = FALSE[0] + nu * cos * dl + nu / 6 * cos**3 * (nu / rho - t2) * dl**3 + nu / 120 * cos**5 * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) * dl**5
    return df.withColumns({east: along, north: up}).drop(*steps)
