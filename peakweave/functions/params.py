"""Parameter rules."""

from __future__ import annotations

import warnings

#: Window size, distance constraint and decay exponent by organism.
ORGANISMS = {
    "human": (500_000, 250_000, 0.75),
    "mouse": (500_000, 250_000, 0.75),
    "drosophila": (100_000, 50_000, 0.85),
}


def resolve_organism_params(organism: str | None = None, window_size: int | None = None, distance_constraint: int | None = None, s: float | None = None) -> tuple[int, int, float]:
    """(window size, distance constraint, s) after defaults; explicit values win over the organism's, with a warning.

    Without an organism, window and exponent are human ones and the constraint is half the window.  Zero means not given.
    """
    if organism is not None and organism not in ORGANISMS:
        raise ValueError(f"unknown organism {organism!r}; known are {', '.join(ORGANISMS)}")
    own = ORGANISMS[organism or "human"]
    if organism is not None:
        for name, value in (("window_size", window_size), ("distance_constraint", distance_constraint), ("s", s)):
            if value:
                warnings.warn(f"{name}={value} is used instead of the default of {organism}", UserWarning, stacklevel=2)
    window = window_size or own[0]
    constraint = distance_constraint or (own[1] if organism is not None else window / 2)
    if constraint > window:
        raise ValueError(f"distance_constraint {constraint} is larger than window_size {window}")
    return window, constraint, s or own[2]
