"""Rock mechanics, pore pressure and formation damage as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from welltide.functions.hydraulics import PSI_PER_PPG_FT, _l

MSE_TORQUE = 480.0


def mse(wob_lbs, torque, rpm, rop, bit) -> Column:
    """Teale's mechanical specific energy; null without penetration or bit."""
    d2 = _l(bit) * _l(bit)
    return F.when((_l(bit) > 0) & (_l(rop) > 0), F.lit(MSE_TORQUE) * _l(torque) * _l(rpm) / (d2 * _l(rop))
                  + F.lit(4.0) * _l(wob_lbs) / (F.lit(math.pi) * d2))


def ucs(m: Column, a=0.35, b=0.0) -> Column:
    return F.greatest(F.lit(a) * m + F.lit(b), F.lit(0.0))


def ccs(u: Column, confining, friction_deg=30.0) -> Column:
    k = math.tan(math.pi / 4.0 + math.radians(friction_deg) / 2.0) ** 2
    return u + _l(confining) * F.lit(k)


def brittleness(u: Column, tensile: Column | None = None) -> Column:
    t = u / F.lit(10.0) if tensile is None else tensile
    return F.when(u + t <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (u - t) / (u + t))))


def efficiency(u: Column, m: Column) -> Column:
    return F.when(m <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u / m)))


def drillability(rop, wob_lbs, rpm) -> Column:
    ok = (_l(rop) > 0) & (_l(wob_lbs) > 0) & (_l(rpm) > 0)
    return F.when(ok, F.log10(_l(rop) / (_l(wob_lbs) * _l(rpm)))).otherwise(F.lit(-99.0))


def overburden(tvd, rho_ppg=16.33) -> Column:
    return F.lit(PSI_PER_PPG_FT) * _l(rho_ppg) * _l(tvd)


def min_horizontal_stress(sv, pp, poisson=0.25, tectonic=0.0, closure: Column | None = None) -> Column:
    v = _l(poisson)
    est = v / (F.lit(1.0) - v) * (_l(sv) - _l(pp)) + _l(pp) + _l(tectonic)
    return est if closure is None else F.coalesce(closure, est)


def stability_window(tvd, pp, sv, shmin, u) -> dict[str, Column]:
    """Kirsch breakout and fracture limits as pressures and mud weights."""
    shmax = (_l(sv) + _l(shmin)) / F.lit(2.0)
    breakout = F.greatest(F.lit(3.0) * shmax - _l(shmin) - _l(pp) - _l(u), _l(pp))
    frac = F.lit(3.0) * _l(shmin) - shmax - _l(pp) + _l(u) / F.lit(10.0)
    ppg = lambda p: F.when(_l(tvd) > 0, p / (F.lit(PSI_PER_PPG_FT) * _l(tvd))).otherwise(F.lit(0.0))
    low, high = F.greatest(ppg(breakout), ppg(_l(pp))), ppg(frac)
    return {"breakout_psi": F.round(breakout, 1), "fracture_psi": F.round(frac, 1), "safe_mw_min": F.round(low, 2),
            "safe_mw_max": F.round(high, 2), "window_ppg": F.round(high - low, 2), "is_stable": high - low > 0}


def fracability(bi: Column, nfd: Column, weight=0.3) -> Column:
    n = F.when(nfd > 0, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-0.5) * (nfd - F.lit(5.0))))).otherwise(F.lit(0.0))
    b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), bi))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0 - weight) * b + F.lit(weight) * n))


# --- pore pressure -------------------------------------------------------------------------------------

def d_exponent(rop, rpm, wob_lbs, bit, divisor=1000.0) -> Column:
    """Drilling exponent. ``divisor`` 1000 is the default everywhere here; the published form uses 1e6."""
    ok = (_l(rop) > 0) & (_l(rpm) > 0) & (_l(wob_lbs) > 0) & (_l(bit) > 0)
    den = F.log10(F.lit(12.0) * _l(wob_lbs) / (F.lit(divisor) * _l(bit)))
    return F.when(~ok | (F.abs(den) < 1e-10), F.lit(0.0)).otherwise(F.log10(_l(rop) / (F.lit(60.0) * _l(rpm))) / den)


def dc_exponent(d: Column, mw_normal, mw) -> Column:
    return F.when(_l(mw) <= 0, d).otherwise(d * (_l(mw_normal) / _l(mw)))


def compaction_trend(tvd, surface=1.0, rate=4e-05) -> Column:
    return F.lit(surface) + F.lit(rate) * _l(tvd)


def overburden_ppg(tvd, bulk=19.2) -> Column:
    return F.when(_l(tvd) <= 0, F.lit(bulk)).otherwise(F.lit(bulk) + _l(tvd) / F.lit(100000.0) * F.lit(2.0))


def eaton(dc: Column, dc_normal: Column, sv_ppg: Column, normal=8.65, exponent=1.2) -> Column:
    pp = sv_ppg - (sv_ppg - F.lit(normal)) * F.pow(dc / dc_normal, F.lit(exponent))
    bounded = F.greatest(F.lit(normal * 0.8), F.least(pp, sv_ppg * F.lit(0.95)))
    return F.when((dc_normal <= 0) | (dc <= 0), F.lit(normal)).otherwise(bounded)


def pore_pressure(tvd: Column, rop: Column, rpm: Column, wob_klbs: Column, mw: Column, bit=8.75, normal=8.65,
                  divisor=1000.0) -> dict[str, Column]:
    """Profile columns; rows without drilling keep the normal gradient and zeros elsewhere."""
    valid = (tvd > 0) & (rop > 0) & (rpm > 0) & (wob_klbs > 0)
    wob = wob_klbs * F.lit(1000.0)
    d = d_exponent(rop, rpm, wob, bit, divisor)
    dc, dn, sv = dc_exponent(d, normal, mw), compaction_trend(tvd), overburden_ppg(tvd)
    pp = eaton(dc, dn, sv, normal)
    conf = (F.when((rop < 10) | (rop > 300), F.lit(0.5)).otherwise(F.lit(1.0))
            * F.when(wob < 5000, F.lit(0.7)).otherwise(F.lit(1.0))
            * F.when((F.abs(dc) < 0.3) | (F.abs(dc) > 3.0), F.lit(0.5)).otherwise(F.lit(1.0)))
    zero = lambda c: F.when(valid, c).otherwise(F.lit(0.0))
    return {"d_exp": zero(d), "dc_exp": zero(dc), "dc_normal": zero(dn),
            "pp_ppg": F.when(valid, pp).otherwise(F.lit(normal)),
            "pp_psi": F.when(valid, F.lit(0.052) * pp * tvd).otherwise(F.lit(0.052 * normal) * F.greatest(tvd, F.lit(0.0))),
            "overburden_ppg": zero(sv), "confidence": zero(conf)}


# --- formation damage ----------------------------------------------------------------------------------

# Default reservoir and drilling scenarios.
RESERVOIR = {"k": 0.1, "phi": 0.07, "h": 200.0, "r_w": 0.354, "r_e": 660.0, "bo": 1.35, "mu": 0.8}
CONVENTIONAL = {"overbalance": 500.0, "hours": 48.0, "rate": 0.02, "solids": 0.06, "mud": "WBM", "spurt": 0.05}
MANAGED = {"overbalance": 75.0, "hours": 24.0, "rate": 0.005, "solids": 0.03, "mud": "OBM", "spurt": 0.01}


def filtrate_volume(dp, hours, rate, spurt, r_w, h) -> Column:
    area = F.lit(2.0 * math.pi) * _l(r_w) * _l(h)
    f = F.sqrt(F.greatest(_l(dp), F.lit(0.0)) / F.lit(100.0))
    return _l(spurt) * f * area + _l(rate) * f * F.sqrt(_l(hours)) * area


def invasion_radius(r_w, v, h, phi) -> Column:
    inner = _l(r_w) * _l(r_w) + _l(v) * F.lit(5.615) / (F.lit(math.pi) * _l(h) * _l(phi))
    return F.sqrt(F.greatest(inner, _l(r_w) * _l(r_w)))


def permeability_factors(dp, solids, mud) -> dict[str, Column]:
    x = _l(dp) / F.lit(1000.0)
    loss = lambda rate: F.lit(1.0) - F.exp(F.lit(-rate) * x)
    clip = lambda c, lo: F.greatest(F.lit(lo), F.least(c, F.lit(1.0)))
    s = clip(F.lit(1.0) - F.lit(0.65) * loss(2.0) * (_l(solids) / F.lit(0.06)), 0.1)
    clay = clip(F.when(F.upper(_l(mud)) == "WBM", F.lit(1.0) - F.lit(0.35) * loss(1.5))
                .otherwise(F.lit(1.0) - F.lit(0.08) * loss(1.0)), 0.25)
    phase = clip(F.lit(1.0) - F.lit(0.2) * loss(1.8), 0.4)
    return {"solids_plugging": s, "clay_swelling": clay, "phase_trapping": phase,
            "kd_over_k": clip(s * clay * phase, 0.05)}


def skin(k, kd, rd, r_w) -> Column:
    return F.when((_l(kd) <= 0) | (_l(r_w) <= 0), F.lit(None).cast("double")).when(_l(rd) <= _l(r_w), F.lit(0.0)) \
        .otherwise((_l(k) / _l(kd) - F.lit(1.0)) * F.ln(_l(rd) / _l(r_w)))


def productivity_index(k, h, bo, mu, r_e, r_w, s) -> Column:
    den = F.lit(141.2) * _l(bo) * _l(mu) * (F.ln(_l(r_e) / _l(r_w)) + _l(s))
    return F.when(den > 0, _l(k) * _l(h) / den)


def damage(dp, hours, rate, solids, mud, spurt, k, phi, r_w, h, r_e, bo, mu) -> dict[str, Column]:
    v = filtrate_volume(dp, hours, rate, spurt, r_w, h)
    rd = invasion_radius(r_w, v, h, phi)
    f = permeability_factors(dp, solids, mud)
    s = skin(k, _l(k) * f["kd_over_k"], rd, r_w)
    return {"filtrate_bbl": v, "invasion_ft": rd, **f, "skin": s, "pi": productivity_index(k, h, bo, mu, r_e, r_w, s)}


def penetration_rate(wob_klbs, rpm, dp, bit=8.75) -> Column:
    """Penetration-rate model used by the optimiser and the sensitivity sweeps."""
    r = F.lit(50.0) * (_l(wob_klbs) * F.lit(1000.0) / F.lit(bit) / F.lit(3000.0)) * F.pow(_l(rpm) / F.lit(120.0), F.lit(0.6)) \
        * F.exp(F.lit(-0.0001) * F.greatest(_l(dp), F.lit(0.0)))
    return F.when((_l(wob_klbs) <= 0) | (_l(rpm) <= 0), F.lit(0.0)).otherwise(F.greatest(r, F.lit(0.0)))
