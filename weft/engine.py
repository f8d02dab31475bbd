"""Projects run on a Spark session."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import ProjectError
from weft.functions import json_schema
from weft.functions.types import NAMES
from weft.model import Output, Project, Source
from weft.operators import outputs
from weft.operators.enrich import Enrichment
from weft.plans.rules import build_order


def _sample(kind: T.DataType) -> str:
    """SQL for a value of a type that most expressions can do something with."""
    if isinstance(kind, T.StructType):
        return f"named_struct({', '.join(f'{f.name!r}, {_sample(f.dataType)}' for f in kind)})"
    if isinstance(kind, T.ArrayType):
        return f"array({_sample(kind.elementType)}, {_sample(kind.elementType)})"
    if isinstance(kind, T.MapType):
        return f"map({_sample(kind.keyType)}, {_sample(kind.valueType)})"
    text = "2001-01-01" if isinstance(kind, (T.DateType, T.TimestampType)) else "true" if isinstance(kind, T.BooleanType) else "1"
    return f"cast('{text}' as {kind.simpleString()})"


class Engine:
    """Enriched sources and outputs of a project as lazy DataFrames.

    ``by_status`` drops rows from outputs by their channels' pass, warn and fail flags.  ``trust_cardinality`` lets an
    output compute only the rules it uses: sides declared "1" are then taken to be so, and joins nobody needs are left
    out.  ``check_cardinality`` makes a query fail where such a side has several rows.  ``materialise`` writes a source
    that others read once, into the shared folder, instead of computing it for each of them; :meth:`close` deletes what
    was written so.
    """

    def __init__(self, spark: SparkSession, project: Project, by_status: bool = False, trust_cardinality: bool = False, check_cardinality: bool = False, materialise: bool = False) -> None:
        self.spark, self.project = spark, project
        self.by_status, self.trust, self.check, self.materialise = by_status, trust_cardinality, check_cardinality, materialise
        self._made: dict[tuple[str, frozenset[str] | None], DataFrame] = {}
        self._written: dict[str, DataFrame] = {}
        self._folders: list[str] = []
        self._steps: dict[str, list[str]] = {}
        for name, (function, returns) in project.functions.items():
            spark.udf.register(name, function, returns) if returns is not None else spark.udf.register(name, function)
        if any("schema_of_json_agg" in str(r.text).lower() for s in project.sources.values() for r in s.rules.values()) or any(m.aggregate == "schema_of_json_agg" for o in project.outputs.values() for c in o.channels for m in c.mappings.values()):
            json_schema.register(spark)

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def close(self) -> None:
        """Delete what ``materialise`` wrote; DataFrames that read it can't be used afterwards."""
        from weft.sources.sinks import delete

        while self._folders:
            delete(self.spark, self._folders.pop())
        self._made.clear()
        self._written.clear()

    def _base(self, s: Source) -> DataFrame:
        if s.frame is not None:
            return s.frame() if callable(s.frame) else s.frame
        if s.query:
            return self.spark.sql(s.query)
        return self.spark.table(s.table)

    def source(self, name: str, only: Iterable[str] | None = None, base: DataFrame | None = None) -> DataFrame:
        """The declared attributes and rules of a source; with ``only``, of the rules just these and what they need."""
        s = self.project.sources.get(name)
        if s is None:
            raise ProjectError("unknown source", f"unknown source {name}")
        if base is None and name in self._written:  # all its rules are there
            return self._written[name]
        key = (name, None if only is None else frozenset(only))
        if base is None and key in self._made:
            return self._made[key]
        if s.unmanaged:
            return self.spark.table(s.target)
        made = Enrichment(self.project, s, self._base(s) if base is None else base, self._hub, only, self.check)
        df = made.run()
        self._steps[name] = made.steps
        if base is None:
            self._made[key] = df
        return df

    def _hub(self, name: str) -> DataFrame:
        if self.materialise and name not in self._written and not self.project.sources[name].unmanaged and self.project.sources[name].rules:
            from weft.sources.folders import shared_folder

            where = f"{shared_folder(self.spark)}/weft-hub-{uuid.uuid4().hex}"
            df = self.source(name)
            df.write.parquet(where)
            self._folders.append(where)
            self._written[name] = self.spark.read.schema(df.schema).parquet(where)
        if not self.trust or name in self._written:
            return self.source(name)
        wanted = set()
        for r in self.project.relations:  # keys and whatever any rule asks of this source
            wanted.update(r.keys(False) if r.this == name else (), r.keys(True) if r.related == name else ())
        for s in self.project.sources.values():
            for rule in s.rules.values():
                e = rule.parsed
                wanted.update(x.attribute for x in [*e.refs(), *(y for a in e.aggs() for y in a.refs())] if x.source == name)
        return self.source(name, only=wanted)

    def with_status(self, name: str) -> DataFrame:
        """A source with its validation status: F, W or P."""
        return self.source(name).withColumn(outputs.STATUS, outputs.status(self.project.sources[name]))

    def output(self, name: str) -> DataFrame:
        out = self.project.outputs.get(name)
        if out is None:
            raise ProjectError("unknown output", f"unknown output {name}")
        return outputs.output(out, [self._channel(out, c) for c in out.channels])

    def _channel(self, out: Output, c) -> DataFrame:
        source = self.project.sources[c.source]
        used = None
        if self.trust:
            used = {m.attribute for m in c.mappings.values()} | {r.attribute for r in (c.filter.refs() if c.filter else [])}
            used |= {r.name for r in source.rules.values() if self.by_status and r.kind == "V"}
        return outputs.channel(out, c, self.source(c.source, only=used), source, self.by_status)

    def order(self) -> list[str]:
        """Sources in the order in which they can be built."""
        return build_order(self.project)

    def explain(self, name: str) -> str:
        """The steps of a source's plan, one a line."""
        self.source(name)
        return "\n".join(self._steps.get(name, []))

    def probe(self, name: str) -> list[str]:
        """The rules of a source that yield NULL on a row of sample values, where all sources have such a row and all
        keys meet; each is warned of, as a cast may be wrong.  Windows and aggregates are tried as well."""
        sources = {}
        for s in self.project.sources.values():
            values = [F.expr(_sample(r.schema or T._parse_datatype_string(NAMES[r.type]))).alias(r.name) for r in s.raw.values()]
            sources[s.name] = replace(s, frame=self.spark.range(1).select(*values), unmanaged=False)
        engine = Engine(self.spark, replace(self.project, sources=sources))
        row = engine.source(name).first()
        empty = [r for r in self.project.sources[name].rules if row is None or row[r] is None]
        for r in empty:
            warnings.warn(f"[{name}].{r} is NULL on a row of sample values", stacklevel=2)
        return empty

    def types(self, name: str) -> dict[str, str]:
        """The type of each attribute of a source, as the catalogue names it."""
        from weft.functions.types import name_of

        return {f.name: name_of(f.dataType) for f in self.source(name).schema}

    def build(self, path: str | None = None, formats: str = "parquet") -> list[str]:
        """Write every source and output: as tables, or as files under ``path``; what is built later reads what is written."""
        from weft.sources.sinks import write

        done = []
        self._made.clear()
        self._written.clear()  # what an earlier build wrote is written anew
        for name in self.order():
            s = self.project.sources[name]
            if not s.unmanaged:
                self._written[name] = write(self.spark, self.source(name), s.target, path, formats)
                done.append(s.target)
        for out in self.project.outputs.values():
            write(self.spark, self.output(out.name), out.table, path, formats, view=out.kind in ("view", "virtual"))
            done.append(out.table)
        return done
