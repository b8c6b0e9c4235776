"""Lorentz vectors as struct Columns (px, py, pz, e).

Rapidity and pseudorapidity along the axis are infinite, with the sign of pz; where a ratio isn't
defined (the null vector, a spacelike sum) they are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(px, py, pz, e) -> Column:
    return F.struct(*[F.coalesce(F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double"), F.lit(0.0)).alias(n) for v, n in zip((px, py, pz, e), ("px", "py", "pz", "e"), strict=True)])


def from_met(x: Column, y: Column) -> Column:
    return vector(x, y, 0.0, F.hypot(x, y))


def from_pt_eta_phi_e(pt_: Column, eta_: Column, phi_: Column, e: Column) -> Column:
    return vector(pt_ * F.cos(phi_), pt_ * F.sin(phi_), pt_ * F.sinh(eta_), e)


def from_pt_eta_phi_m(pt_: Column, eta_: Column, phi_: Column, m_: Column) -> Column:
    """With the energy that the mass asks for."""
    pz = pt_ * F.sinh(eta_)
    return vector(pt_ * F.cos(phi_), pt_ * F.sin(phi_), pz, F.sqrt(pt_ * pt_ + pz * pz + m_ * m_))


def add(*vectors: Column) -> Column:
    return F.struct(*[sum((v[n] for v in vectors[1:]), vectors[0][n]).alias(n) for n in ("px", "py", "pz", "e")])


def subtract(a: Column, b: Column) -> Column:
    return F.struct(*[(a[n] - b[n]).alias(n) for n in ("px", "py", "pz", "e")])


def scale(a: Column, by) -> Column:
    return F.struct(*[(a[n] * by).alias(n) for n in ("px", "py", "pz", "e")])


def transverse(a: Column) -> Column:
    return vector(a["px"], a["py"], 0.0, et(a))


def pt2(v: Column) -> Column:
    return v["px"] * v["px"] + v["py"] * v["py"]


def pt(v: Column) -> Column:
    return F.hypot(v["px"], v["py"])


def p2(v: Column) -> Column:
    return pt2(v) + v["pz"] * v["pz"]


def p(v: Column) -> Column:
    return F.sqrt(p2(v))


def m2(v: Column) -> Column:
    return (v["e"] - p(v)) * (v["e"] + p(v))


def signed_root(x: Column) -> Column:
    return F.when(x < 0, -F.sqrt(-x)).otherwise(F.sqrt(x))


def m(v: Column) -> Column:
    return signed_root(m2(v))


def mt(v: Column) -> Column:
    return F.sqrt((v["e"] - v["pz"]) * (v["e"] + v["pz"]))


def _half_log(above: Column, below: Column) -> Column:
    infinite = F.lit(float("inf"))
    inner = 0.5 * F.log(F.try_divide(above, below))
    return F.when((below == 0) & (above > 0), infinite).when((above == 0) & (below > 0), -infinite).otherwise(inner)


def rapidity(v: Column) -> Column:
    return _half_log(v["e"] + v["pz"], v["e"] - v["pz"])


def eta(v: Column) -> Column:
    return _half_log(p(v) + v["pz"], p(v) - v["pz"])


def et(v: Column) -> Column:
    return F.try_divide(v["e"], p(v)) * pt(v)


def phi(v: Column) -> Column:
    return F.atan2(v["py"], v["px"])


def theta(v: Column) -> Column:
    return F.when((pt(v) == 0) & (v["pz"] == 0), 0.0).otherwise(F.atan2(pt(v), v["pz"]))


def wrap_phi(d: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi


def delta_phi(a: Column, b: Column) -> Column:
    return wrap_phi(phi(a) - phi(b))


def delta_eta(a: Column, b: Column) -> Column:
    return eta(a) - eta(b)


def delta_r(a: Column, b: Column) -> Column:
    return F.hypot(delta_eta(a, b), delta_phi(a, b))
