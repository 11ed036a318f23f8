"""Imports every plan module, which registers its queries."""

from harborlens.plans import corpus_plans, graph_plans, impact_plans, ledger_plans, metric_plans, quality_plans, scenario_plans, spatial_plans, stream_plans, synth_plans  # noqa: F401
from harborlens.plans.registry import QUERIES, SQL  # noqa: F401
