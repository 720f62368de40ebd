"""All registered queries."""

from . import q_mass, q_models, q_paths, q_scalars, q_sources, q_state, q_streams, q_tracks  # noqa: F401
from .registry import QUERIES, oracles  # noqa: F401
