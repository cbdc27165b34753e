"""Wellbore hydraulics as column expressions (oilfield units)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PSI_PER_PPG_FT = 0.052
ANNULAR_VELOCITY = 24.5


def _l(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def hydrostatic(mw, tvd) -> Column:
    return F.lit(PSI_PER_PPG_FT) * _l(mw) * _l(tvd)


def bhp_static(mw, tvd, sbp=0.0) -> Column:
    return hydrostatic(mw, tvd) + _l(sbp)


def bhp_dynamic(mw, tvd, afp, sbp=0.0) -> Column:
    return hydrostatic(mw, tvd) + _l(afp) + _l(sbp)


def ecd(mw, afp, tvd) -> Column:
    return F.when(_l(tvd) <= 0, _l(mw)).otherwise(_l(mw) + _l(afp) / (F.lit(PSI_PER_PPG_FT) * _l(tvd)))


def equivalent_density(pressure, tvd) -> Column:
    return F.when(_l(tvd) <= 0, F.lit(0.0)).otherwise(_l(pressure) / (F.lit(PSI_PER_PPG_FT) * _l(tvd)))


def annular_velocity(q, hole, pipe) -> Column:
    """Null where the annulus is closed."""
    area = _l(hole) * _l(hole) - _l(pipe) * _l(pipe)
    return F.when(area > 0, F.lit(ANNULAR_VELOCITY) * _l(q) / area)


def annular_friction(pv, yp, length, q, hole, pipe) -> Column:
    """Bingham-plastic pressure loss; 0 without length or flow, null in a closed annulus."""
    gap = _l(hole) - _l(pipe)
    v = annular_velocity(q, hole, pipe)
    loss = _l(pv) * _l(length) * v / (F.lit(60000.0) * gap * gap) + _l(yp) * _l(length) / (F.lit(200.0) * gap)
    return F.when((_l(length) <= 0) | (_l(q) <= 0), F.lit(0.0)).when(gap > 0, loss)


def friction_below(sections: Column, md: Column, pv, yp, q) -> Column:
    """Friction from TD up to ``md``: whole sections below it, part of the one it is in."""
    return F.aggregate(sections, F.lit(0.0), lambda acc, s: acc + annular_friction(
        pv, yp, F.greatest(F.lit(0.0), s["md_bottom"] - F.greatest(s["md_top"], md)), q, s["hole_id"], s["pipe_od"]))


def _holding(sections: Column, md: Column) -> Column:
    return F.filter(sections, lambda s: md.between(s["md_top"], s["md_bottom"]))


def section_at(sections: Column, md: Column) -> Column:
    """First section holding ``md``, both ends included; null outside."""
    return F.get(_holding(sections, md), 0)


def tvd_at(sections: Column, md: Column) -> Column:
    # The section is named once; each field taken from ``section_at`` would search for it anew.
    return F.get(F.transform(_holding(sections, md), lambda s: s["tvd_top"] + (md - s["md_top"]) / (s["md_bottom"] - s["md_top"]) * (s["tvd_bottom"] - s["tvd_top"])), 0)


def interpolate_points(points: Column, x: Column, field: str) -> Column:
    """Piecewise-linear value on control points sorted by ``tvd``, constant beyond the ends."""
    first, last = F.get(points, 0), F.element_at(points, -1)
    pairs = F.filter(F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, i + 1).alias("b"))),
                     lambda ab: x.between(ab["a"]["tvd"], ab["b"]["tvd"]))
    mid = F.get(F.transform(pairs, lambda ab: ab["a"][field] + (x - ab["a"]["tvd"]) / (ab["b"]["tvd"] - ab["a"]["tvd"]) * (ab["b"][field] - ab["a"][field])), 0)
    return F.when(x <= first["tvd"], first[field]).when(x >= last["tvd"], last[field]).otherwise(mid)


def surge_pressure(tvd, pipe_velocity, hole, pipe, pv, clinging=0.45) -> Column:
    gap = _l(hole) - _l(pipe)
    ratio = _l(pipe) * _l(pipe) / (_l(hole) * _l(hole) - _l(pipe) * _l(pipe))
    return F.when(gap > 0, F.lit(clinging) * _l(pv) * _l(pipe_velocity) * ratio * _l(tvd) / (F.lit(60000.0) * gap * gap))


def kill_sheet(mw, tvd, sidpp, scrp) -> dict[str, Column]:
    """Kill weight, initial and final circulating pressure; null with a reason where inputs are invalid."""
    ok = (_l(tvd) > 0) & (_l(mw) > 0)
    kmw = _l(mw) + _l(sidpp) / (F.lit(PSI_PER_PPG_FT) * _l(tvd))
    return {"kill_mw": F.when(ok, kmw), "icp": F.when(ok, _l(sidpp) + _l(scrp)),
            "fcp": F.when(ok, _l(scrp) * (kmw / _l(mw))),
            "reason": F.when(_l(tvd) <= 0, "tvd not positive").when(_l(mw) <= 0, "mud weight not positive")}
