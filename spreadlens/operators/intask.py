"""Whole graphs in one task each, where their edges are bounded; larger ones go through rounds of jobs."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a graph may have to be worked through in one task: some 400 MB of a Python worker.
IN_TASK = 6_000_000


def fits(edges: DataFrame, most: int = IN_TASK) -> bool:
    """Whether each graph of ``edges`` has ``most`` edges at most."""
    largest = edges.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (largest or 0) <= most


def each_graph(nodes: DataFrame, edges: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(graph, nodes, edges)`` of the rows of every graph as Arrow tables, all graphs side by side."""
    def run(key, left, right):
        return fn(key[0], left, right)
    return nodes.groupBy("graph").cogroup(edges.groupBy("graph")).applyInArrow(run, schema)


def codes(*columns):
    """The ids that the Arrow columns have, and the columns with ids numbered from 0; -1 is null."""
    import pyarrow as pa
    kind = columns[0].type
    chunks = [x for c in columns for x in c.cast(kind).chunks]
    known = pa.chunked_array(chunks, kind).combine_chunks().dictionary_encode()
    known = known.combine_chunks() if isinstance(known, pa.ChunkedArray) else known
    number = known.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return known.dictionary, np.split(number, np.cumsum([len(c) for c in columns])[:-1])
