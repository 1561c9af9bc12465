"""Parameters of the rules. Every operator takes them as arguments; nothing is global."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default bands, thresholds and rates.
LENGTH_BAND_FLOOR = 50.0
LENGTH_BAND_SHARE = 0.02
COUNT_BAND = 0.0
AUTO_MATCH_SCORE = 90.0
SUGGEST_SCORE = 60.0
CANDIDATES_KEPT = 3
RETAINAGE_PCT = 10.0
RETAINAGE_SLACK = 1.0
PRICE_EPSILON = 1e-6
APPROVAL_ROWS = 18


@dataclass(frozen=True)
class Tolerance:
    """Allowed built-versus-billed difference: a band for lengths, none for counts."""

    length_floor: float = LENGTH_BAND_FLOOR
    length_share: float = LENGTH_BAND_SHARE
    count_band: float = COUNT_BAND


@dataclass(frozen=True)
class Matching:
    """How free text is matched to contract codes."""

    auto_score: float = AUTO_MATCH_SCORE
    suggest_score: float = SUGGEST_SCORE
    candidates: int = CANDIDATES_KEPT
    scorer: str = "WRatio"
    # Contract items are scored in blocks of this many, so no task ever holds a
    # whole contract; descriptions are spread over this many salts per project.
    block_items: int = 256
    salts: int = 16


@dataclass(frozen=True)
class Rules:
    """Everything the reconciliation itself needs."""

    tolerance: Tolerance = field(default_factory=Tolerance)
    price_epsilon: float = PRICE_EPSILON
    billing_mode: str = "cumulative"
    retainage_pct: float = RETAINAGE_PCT
    # False reproduces the established behaviour, where only built quantities of
    # 100FT items are converted to feet; True converts the billed side, the contract
    # price and the estimate as well.
    convert_billed_hundreds: bool = False


CUMULATIVE = "cumulative"
DISCRETE = "discrete"
