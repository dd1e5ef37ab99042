"""Triples from a stream of rows.

Standard form and rule application look at one row at a time, so they run on a streaming DataFrame as they
are. The sink appends lines; making a set of the whole graph is left to the batch side.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.rdf import PREFIXES
from graphloom.operators.triples import TableMapping, table_triples
from graphloom.sources.ntriples import triple_lines


def stream_triples(
    rows: DataFrame, mapping: TableMapping, path: str, checkpoint: str, prefixes: Mapping[str, str] = PREFIXES,
    available_now: bool = False,
) -> StreamingQuery:
    """Append the triples of arriving rows to N-Triples files under ``path``."""
    lines = triple_lines(table_triples(rows, mapping.expanded(prefixes)))
    writer = lines.writeStream.format("text").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
