"""Importing this module registers every query of the library."""
from . import q_cascades, q_checks, q_communities, q_graph, q_links, q_profile, q_sources, q_text  # noqa: F401
