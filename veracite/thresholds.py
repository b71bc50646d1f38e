"""Calibrated constants. They decide verdicts and must not drift."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    min_prose_chars: int = 4500  # a body this long can accuse
    max_challenge_chars: int = 800  # a challenge wording vetoes only below this
    max_binary_density: float = 0.01
    binary_sample_code_points: int = 65_536
    min_claim_chars: int = 16
    harvest_seed_chars: int = 21


THRESHOLDS = Thresholds()
MAX_DESCRIPTION_REGIONS = 8
EXCERPT_CHARS = 240
MAX_LEAD = 90
