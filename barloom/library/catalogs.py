"""Published sets of factors: the 101 formulaic alphas and the 158 price-volume features."""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from barloom.plans.expression import Apply, parse, walk

WINDOWS = (5, 10, 20, 30, 60)
#: The features' published definitions. {d} stands for a window.
SHAPES = {
    "KMID": "($close-$open)/$open",
    "KLEN": "($high-$low)/$open",
    "KMID2": "($close-$open)/($high-$low+1e-12)",
    "KUP": "($high-Greater($open,$close))/$open",
    "KUP2": "($high-Greater($open,$close))/($high-$low+1e-12)",
    "KLOW": "(Less($open,$close)-$low)/$open",
    "KLOW2": "(Less($open,$close)-$low)/($high-$low+1e-12)",
    "KSFT": "(2*$close-$high-$low)/$open",
    "KSFT2": "(2*$close-$high-$low)/($high-$low+1e-12)",
}
PRICES = ("OPEN", "HIGH", "LOW", "VWAP")
PRICE_WINDOWS = {
    "ROC": "Ref($close,{d})/$close",
    "MA": "Mean($close,{d})/$close",
    "STD": "Std($close,{d})/$close",
    "BETA": "Slope($close,{d})/$close",
    "RSQR": "Rsquare($close,{d})",
    "RESI": "Resi($close,{d})/$close",
    "MAX": "Max($high,{d})/$close",
    "MIN": "Min($low,{d})/$close",
    "QTLU": "Quantile($close,{d},0.8)/$close",
    "QTLD": "Quantile($close,{d},0.2)/$close",
    "RANK": "Rank($close,{d})",
    "RSV": "($close-Min($low,{d}))/(Max($high,{d})-Min($low,{d})+1e-12)",
    "IMAX": "IdxMax($high,{d})/{d}",
    "IMIN": "IdxMin($low,{d})/{d}",
    "IMXD": "(IdxMax($high,{d})-IdxMin($low,{d}))/{d}",
    "CORR": "Corr($close,Log($volume+1),{d})",
    "CORD": "Corr($close/Ref($close,1),Log($volume/Ref($volume,1)+1),{d})",
    "CNTP": "Mean($close>Ref($close,1),{d})",
    "CNTN": "Mean($close<Ref($close,1),{d})",
    "CNTD": "Mean($close>Ref($close,1),{d})-Mean($close<Ref($close,1),{d})",
}
#: Shares of rises and falls in all moves, of prices ($close) and of volumes ($volume): {x} stands for the field.
MOVE_WINDOWS = {
    "SUMP": "Sum(Greater({x}-Ref({x},1),0),{d})/(Sum(Abs({x}-Ref({x},1)),{d})+1e-12)",
    "SUMN": "Sum(Greater(Ref({x},1)-{x},0),{d})/(Sum(Abs({x}-Ref({x},1)),{d})+1e-12)",
    "SUMD": "(Sum(Greater({x}-Ref({x},1),0),{d})-Sum(Greater(Ref({x},1)-{x},0),{d}))/(Sum(Abs({x}-Ref({x},1)),{d})+1e-12)",
}
VOLUME_WINDOWS = {
    "VMA": "Mean($volume,{d})/($volume+1e-12)",
    "VSTD": "Std($volume,{d})/($volume+1e-12)",
    "WVMA": "Std(Abs($close/Ref($close,1)-1)*$volume,{d})/(Mean(Abs($close/Ref($close,1)-1)*$volume,{d})+1e-12)",
}


@cache
def alpha101() -> dict[int, str]:
    lines = files("barloom.library").joinpath("alpha101.txt").read_text().splitlines()
    return {int(n): formula for n, formula in (x.split(": ", 1) for x in lines if x and x[0] != "#")}


@cache
def features158() -> dict[str, str]:
    out = dict(SHAPES) | {f"{p}0": f"${p.lower()}/$close" for p in PRICES}
    windows = PRICE_WINDOWS | {k: v.replace("{x}", "$close") for k, v in MOVE_WINDOWS.items()} | VOLUME_WINDOWS | {f"V{k}": v.replace("{x}", "$volume") for k, v in MOVE_WINDOWS.items()}
    return out | {f"{name}{d}": template.replace("{d}", str(d)) for d in WINDOWS for name, template in windows.items()}


def needs_groups(expression: str) -> bool:
    """Whether a factor compares symbols within a group."""
    return any(isinstance(n, Apply) and n.op in ("cs_neutralize", "cs_group_rank", "cs_group_mean") for n in walk(parse(expression)))


def resolve_spec(spec) -> tuple[str, str]:
    """(name, expression) of 'alpha101:7', 'features158:MA20', a mapping with 'expr' (and 'name'), or an expression."""
    if isinstance(spec, dict):
        return spec.get("name") or spec["expr"], spec["expr"]
    if spec.startswith("alpha101:"):
        return spec, alpha101()[int(spec.split(":")[1])]
    if spec.startswith("features158:"):
        return spec, features158()[spec.split(":")[1]]
    return spec, spec


def unique_names(specs) -> dict[str, str]:
    """Names to expressions in order; a repeated name gets '#2', '#3' and so on."""
    out: dict[str, str] = {}
    for name, expr in map(resolve_spec, specs):
        k, key = 1, name
        while key in out:
            k, key = k + 1, f"{name}#{k + 1}"
        out[key] = expr
    return out


__all__ = ["alpha101", "features158", "needs_groups", "resolve_spec", "unique_names"]
