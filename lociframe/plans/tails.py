"""SQL expressions for tails and quantiles, as sums of positive terms, for oracles.

Every series has positive terms only, so its sum is right to double precision; the tails are one
minus a sum and so right to about 1e-14, which the oracles round well above.
"""

from __future__ import annotations

TERMS = 400


def gamma_sf(a: str, x: str) -> str:
    """Upper regularised incomplete gamma function, for small a; 0 far out, where the terms wouldn't reach."""
    return f"(1 - CASE WHEN ({x}) > 150 THEN 1 WHEN ({x}) > 0 THEN list_sum(list_transform(range(0, {TERMS}), lambda k: exp((({a}) + k) * ln({x}) - ({x}) - lgamma(({a}) + k + 1)))) ELSE 0 END)"


def beta_sf(a: str, b: str, y: str) -> str:
    """One minus the regularised incomplete beta function at y."""
    return f"(1 - CASE WHEN ({y}) > 0 THEN list_sum(list_transform(range(0, {TERMS}), lambda k: exp((({a}) + k) * ln({y}) + ({b}) * ln(1 - ({y})) + lgamma(({a}) + ({b}) + k) - lgamma(({a}) + 1 + k) - lgamma({b})))) ELSE 0 END)"


def chi2_sf(x: str, df: str) -> str:
    return gamma_sf(f"({df}) / 2", f"({x}) / 2")


def t_sf2(t: str, df: str) -> str:
    """Two-sided tail of Student's t."""
    return beta_sf("0.5::DOUBLE", f"({df}) / 2", f"(({t}) * ({t}) / (({df}) + ({t}) * ({t})))")


def f_sf(f: str, df1: str, df2: str) -> str:
    return beta_sf(f"({df1}) / 2", f"({df2}) / 2", f"(({df1}) * ({f}) / (({df2}) + ({df1}) * ({f})))")


def norm_sf2(z: str) -> str:
    """Two-sided tail of the normal."""
    return gamma_sf("0.5::DOUBLE", f"(({z}) * ({z}) / 2)")


def norm_cdf(z: str) -> str:
    return f"(CASE WHEN ({z}) >= 0 THEN 1 - {norm_sf2(z)} / 2 ELSE {norm_sf2(z)} / 2 END)"


#: Acklam's rational approximation of the normal quantile, right to about 1e-9.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def norm_ppf(p: str) -> str:
    """Quantile of the normal, to about nine digits."""
    q, s = f"(({p}) - 0.5)", f"((({p}) - 0.5) * (({p}) - 0.5))"
    low = lambda x: f"(sqrt(-2 * ln({x})))"
    tail = lambda x: f"({_horner(low(x), _C)} / ({_horner(low(x), _D)} * {low(x)} + 1))"
    middle = f"({q} * {_horner(s, _A)} / ({_horner(s, _B)} * {s} + 1))"
    return f"(CASE WHEN ({p}) < 0.02425 THEN {tail(p)} WHEN ({p}) > 1 - 0.02425 THEN -{tail(f'(1 - ({p}))')} ELSE {middle} END)"
