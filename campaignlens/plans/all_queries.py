"""All registered queries of the fact operators."""

from campaignlens.plans import q_candidates, q_closure, q_conformance, q_facts, q_graph, q_hooks, q_io, q_more, q_scoring, q_streams, q_telemetry, q_text, q_traces, q_triplets, q_types, q_whole  # noqa: F401
from campaignlens.plans.registry import ORACLES, QUERIES  # noqa: F401
