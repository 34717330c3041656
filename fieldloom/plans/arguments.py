"""What a form or a help page needs to know of an operator's config: names, kinds, defaults, and limits where they are
stated. Limits are for display; :func:`outside` tells which values break them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .flow import OPERATORS


@dataclass(frozen=True)
class Argument:
    name: str
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()


#: Limits by field; they hold for every operator that has the field.
LIMITS: dict[str, tuple[float, float | None]] = {
    "min_area": (0, None), "max_area": (0, None), "border_gap": (0, None), "merge_gap": (0, None), "bbox_gap": (0, None), "conf": (0, 1), "close_size": (1, None), "open_size": (1, None),
    "hole_highlight_pct": (0, 100), "hole_dark_pct": (0, 100), "hole_color_thr": (0, 20), "hole_seed_var_max": (0, 100), "hole_seed_rim": (1, 50), "hole_neg_pts_area_frac": (0, 1), "hole_max_pts": (1, 32), "hole_logit_neg": (-30, 0),
}
CHOICES = {"space": ("hsv", "lab"), "hole_space": ("lab", "hsv", "rgb"), "mode": ("subtract", "intersect", "union")}


def arguments(operator: str) -> list[Argument]:
    """The config of a registered operator, in its order."""
    out = []
    for name, default in OPERATORS[operator].defaults.items():
        low, high = LIMITS.get(name, (None, None))
        out.append(Argument(name, "any" if default is None else type(default).__name__, default, low, high, CHOICES.get(name, ())))
    return out


def outside(operator: str, config: dict[str, Any]) -> list[str]:
    """Fields of a config whose values lie outside their stated limits."""
    known = {a.name: a for a in arguments(operator)}
    bad = []
    for name, value in config.items():
        a = known[name]
        low = a.low is not None and value < a.low
        high = a.high is not None and value > a.high
        if low or high or a.choices and value not in a.choices:
            bad.append(name)
    return bad
