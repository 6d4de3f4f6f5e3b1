"""All registered queries, gathered from the modules that define them."""

from chronica.plans import boosted, evaluation, io, normalise, people, repeats, reports, sampling, snapshots, states, streams, text, training  # noqa: F401
from chronica.plans.registry import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
