"""All queries of the library by name."""

from __future__ import annotations

from heddle.plans import analytics, architecture, databases, files, graphs, history, lake, nested, streams, vectors
from heddle.plans.base import Plan

PLANS: dict[str, Plan] = {**history.PLANS, **analytics.PLANS, **graphs.PLANS, **architecture.PLANS, **streams.PLANS, **nested.PLANS, **vectors.PLANS, **databases.PLANS, **lake.PLANS, **files.PLANS}
