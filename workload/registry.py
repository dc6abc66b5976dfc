"""All registered queries."""

from workload import (  # noqa: F401
    q_features,
    q_io,
    q_profile,
    q_sampling,
    q_shape,
    q_similarity,
    q_splits,
    q_targets,
    q_tokens,
)
from workload.base import ORACLES, QUERIES
from workload.q_targets import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
