"""Streams of rows enriched by lookups into static sources."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weft.engine import Engine
from weft.errors import ProjectError


def enrich_stream(engine: Engine, name: str, stream: DataFrame) -> DataFrame:
    """The rules of a stream source over a streaming DataFrame: row rules and lookups, no state."""
    source = engine.project.sources[name]
    if not source.stream:
        raise ProjectError("stream", "the source is not declared with processing_type: stream", name)
    return engine.source(name, base=stream)
