"""All registered queries of the domain operators and their SQL."""

from __future__ import annotations

from rosterlake.plans import places, small, supply, text
from rosterlake.plans.views import with_decimals

QUERIES: dict = {**supply.QUERIES, **places.QUERIES, **text.QUERIES, **small.QUERIES}
ORACLES: dict[str, str] = {k: with_decimals(s) for k, s in {**supply.ORACLES, **places.ORACLES, **text.ORACLES, **small.ORACLES}.items()}
FLAGSHIP = "m10_compute_core"
