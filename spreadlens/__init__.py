"""spreadlens: cascade analytics for labelled articles, expressed as Spark DataFrame jobs.

Every public operator is a function that takes DataFrames (and plain parameters)
and returns a lazy DataFrame, so Catalyst can plan across operator boundaries.
Iterative operators (PageRank, HITS, diffusion, components, communities) advance
all vertices / all articles together and cut lineage with reliable checkpoints.
"""

__all__ = ["session"]
