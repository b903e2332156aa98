"""Search over settings: draw, run, keep the best."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import replace

from peakloom.config import Config

#: section.key -> (least, most) of what the search draws, evenly; whole numbers where both are.
SPACE = {
    "denoise.ms2_min_n": (2, 10),
    "tracing.rt_scaling": (0.5, 2.5),
    "tracing.min_neighbor_intensity": (50, 5000),
    "tracing.min_n": (2, 10),
    "pseudoscan.rt_scaling": (0.5, 2.5),
    "pseudoscan.min_neighbor_intensity": (50, 10000),
    "pseudoscan.min_n": (2, 10),
}


def drawn(base: Config, space: dict[str, tuple[float, float]], rng: random.Random) -> Config:
    out = base
    for name, (lo, hi) in sorted(space.items()):
        section, key = name.split(".")
        value = rng.randint(lo, hi) if isinstance(lo, int) and isinstance(hi, int) else rng.uniform(lo, hi)
        out = replace(out, **{section: replace(getattr(out, section), **{key: value})})
    return out


def tune(objective: Callable[[Config], float], *, base: Config | None = None, space: dict[str, tuple[float, float]] | None = None, trials: int = 100, seed: int = 0) -> tuple[Config, list[tuple[float, Config]]]:
    """(best settings, all trials): objective, to be maximised, runs a whole job for one Config; the first trial is base."""
    rng = random.Random(seed)
    base = base or Config()
    tried = []
    for k in range(trials):
        config = base if k == 0 else drawn(base, space or SPACE, rng)
        tried.append((objective(config), config))
    return max(tried, key=lambda t: t[0])[1], tried
