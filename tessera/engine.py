"""The engine: a schema, a request and a source make an extraction, whose tables are lazy DataFrames."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents
from .config import ConfigError, Schema
from .functions.masks import apply_masks, mask_document
from .operators.lower import Lowering, batches, kept_counts, semi
from .plans.nodes import All, Among, In, KeysOf
from .plans.resolver import Context, Plan, Request, Resolver
from .sources import Source, tag


class Extraction:
    """Which rows of each table a request keeps, and their masked columns.

    dialect: "null" (a template that reads a null is null) or "empty" (it counts as an empty text). measure: whether plans of
    documents may run jobs that count kept keys; without, plans are for explaining only.
    """

    def __init__(self, schema: Schema, request: Request, source: Source, dialect: str = "null", apply_filters: str = "related", measure: bool = True):
        self.schema, self.request, self.dialect = schema, request, dialect
        self.source = source
        self.batch_notes: list[str] = []
        self.lowering = Lowering(source)
        self.flavour = "document" if any(t.document for t in schema.live) else "table"
        if self.flavour == "document":
            self.resolver = documents.DocumentResolver(schema, request, self.lowering, measure)
        else:
            self.resolver = Resolver(schema, request, apply_filters)
        self.plans: dict[str, Plan] = self.resolver.plans()

    def rows(self, name: str) -> DataFrame:
        """The kept rows, not masked."""
        if name not in self.plans:
            raise ConfigError(f"{name} isn't extracted")
        rows = self.lowering.rows(self.plans[name].node)
        tag(rows.sparkSession, name)
        return rows

    def masked(self, name: str) -> DataFrame:
        """The kept rows with declared columns only, masked. Random masks differ in each evaluation."""
        table = self.schema[name]
        if table.document:
            return mask_document(self.rows(name), table, [t for t in self.schema.live if t.embedded_in and t.embedded_in.collection_name == name])
        return apply_masks(self.rows(name), table, self.dialect)

    def counts(self) -> DataFrame:
        """(table_name, n) of what is kept."""
        return kept_counts({n: self.rows(n) for n in self.plans})

    def batched(self, name: str) -> DataFrame:
        """The rows of a table with a batch_scope, with the number of their batch: the rows of the unbatched run.

        Keys of the batch table are numbered in their order; the table is joined to them once, instead of once for each batch.
        """
        table = self.schema[name]
        if not table.batch_scope:
            raise ConfigError(f"{name} has no batch_scope")
        holder = self.schema[table.batch_scope.table]
        if holder.self_links:
            self.batch_notes = [f"{name} is batched by {holder.name}, a tree: rows that only its ancestors would bring aren't in any batch"]
        # the batch table's own rows, without ancestors that a tree would add
        kept = self.lowering.rows(self.resolver.plan(holder.name, Context(ancestors=False)).node)
        numbered = batches(kept, holder.primary_key, table.batch_scope.size)
        if holder.name == name:
            key = numbered.withColumnRenamed(holder.primary_key, "__key")
            return self.rows(name).join(key, F.col(f"`{holder.primary_key}`") == F.col("__key")).drop("__key")
        path = self.resolver._scope_path(table, None, stop=holder.name)
        now = numbered.withColumnRenamed(holder.primary_key, "__key")
        for child, b in reversed(path):
            own = self.schema[child]
            rows = self.lowering.table(child)
            if own.filter:
                rows = rows.alias(child).where(F.expr(own.filter))
            met = rows.join(now, F.col(f"`{b.foreign_key}`") == F.col("__key")).drop("__key")
            now = met if child == name else met.select(F.col(f"`{own.primary_key}`").alias("__key"), "batch")
        return now

    def explain(self, physical: bool = False) -> str:
        """The plan of every table; with `physical` also Spark's."""
        out = []
        for name, plan in self.plans.items():
            text = plan.explain()
            if physical:
                text += "\n" + self.masked(name)._jdf.queryExecution().explainString(self._mode("formatted"))
            if (b := self.schema[name].batch_scope) is not None:
                text += f"\n  batches of {b.size} keys of {b.table}:\n" + self.plans[b.table].explain()
            out.append(text)
        return "\n\n".join(out)

    def _mode(self, name: str):
        spark = SparkSession.active()
        return spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(name)

    def notes(self) -> list[str]:
        return [n for p in self.plans.values() for n in p.notes] + self.batch_notes

    def classify(self, spark: SparkSession) -> DataFrame:
        """(table_name, category) of all tables."""
        rows = [(n, self.resolver.category(n)) for n in self.plans]
        return spark.createDataFrame(rows, "table_name string, category string")

    def write_parallel(self, directory: str, threads: int = 4) -> dict[str, int]:
        """Writes all tables as Parquet from several jobs at a time; the scheduler deals tasks out among them."""

        def one(name: str) -> tuple[str, int]:
            from .sinks.writer import _write_parquet
            from pathlib import Path

            return name, _write_parquet(self.masked(name), self.schema[name], Path(directory) / f"{name}.parquet")

        with ThreadPoolExecutor(threads) as pool:
            return dict(pool.map(one, self.plans))


def dangling(extraction: Extraction, name: str, relation) -> DataFrame:
    """Kept rows of a table whose parent, though it exists, isn't kept: none, unless a filter removed it."""
    rows = extraction.rows(name)
    if relation.polymorphic:
        rows = rows.where(F.col(f"`{relation.foreign_type}`") == relation.type_value)
    key = relation.references or extraction.schema[relation.table_name].primary_key
    parents = lambda node: extraction.lowering.keys(KeysOf(node, key))
    existing = semi(rows, relation.foreign_key, parents(All(relation.table_name)))
    return semi(existing, relation.foreign_key, parents(extraction.plans[relation.table_name].node), "left_anti")


def reachable(schema: Schema, source: Source, name: str, column: str, values: list) -> DataFrame:
    """Rows of a table by values of one column, without planning."""
    return Lowering(source).rows(Among(All(name), column, tuple(values)))


def union_tagged(frames: dict[str, DataFrame], tag: str = "table_name") -> DataFrame:
    """Frames of equal columns, one below the other, with their names."""
    return reduce(DataFrame.unionByName, (df.withColumn(tag, F.lit(n)) for n, df in frames.items()))


__all__ = ["Extraction", "In", "dangling", "reachable", "union_tagged"]
