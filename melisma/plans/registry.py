"""All queries of the recommendation side and their SQL."""

from __future__ import annotations

from melisma.plans import catalogue, evaluate, live, memory, profiles, providers, recommend, stores, upkeep  # noqa: F401  (each registers its queries)

QUERIES, ORACLES = recommend.QUERIES, recommend.ORACLES
FLAGSHIP = recommend.jn1_jn3_win3_recommendations
