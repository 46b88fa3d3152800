"""All queries of the library: importing the modules registers them."""

from __future__ import annotations

from vialens.plans import basemap, boards, evidence, feed, fleet, gate, matching, publish, rider, schedule, spatial, tables  # noqa: F401
from vialens.plans.registry import ORACLES, QUERIES  # noqa: F401
