"""Lowers plan nodes to DataFrames: filters, left semi joins, distinct unions, and a loop for ancestors.

Only semi joins are used, so rows never multiply, and Catalyst chooses broadcast or shuffle by
size. One DataFrame is made for each node, so plans that share key sets share exchanges.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from ..config import ConfigError
from ..plans.nodes import All, Among, AnyOf, In, Keys, KeysOf, Matching, Node, Nothing, Typed, WithAncestors
from ..shared import cut

Source = Callable[[str], DataFrame]
#: Values in a filter; more are joined.
MOST_LITERALS = 1000
#: Rows with a parent up to which a tree's ancestors are walked on the driver, after counting them.
MOST_DRIVER_LINKS = 100_000
#: Rounds of the distributed walk between checks of the frontier's size.
_KEY = "__key"


class Lowering:
    """DataFrames of plan nodes over a source of tables."""

    def __init__(self, source: Source):
        self._source, self._known, self._tables = source, {}, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._source(name)
        return self._tables[name]

    def rows(self, node: Node) -> DataFrame:
        if node not in self._known:
            self._known[node] = self._lower(node)
        return self._known[node]

    def keys(self, keys: Keys) -> DataFrame:
        """One column of values, without nulls, for a semi join; of a field that holds arrays, their elements."""
        if keys not in self._known:
            if isinstance(keys, KeysOf):
                rows, c = self.rows(keys.source), F.col(f"`{keys.column}`")
                c = F.explode(c) if isinstance(rows.schema[keys.column].dataType, P.ArrayType) else c
                made = rows.select(c.alias(_KEY)).where(F.col(_KEY).isNotNull())
            else:
                parts = [self.keys(k) for k in keys.keys]
                if len({p.schema[0].dataType for p in parts}) > 1:
                    parts = [p.select(F.col(_KEY).cast("string").alias(_KEY)) for p in parts]
                made = reduce(DataFrame.union, parts).distinct()
            self._known[keys] = made
        return self._known[keys]

    def _lower(self, node: Node) -> DataFrame:
        match node:
            case All(table):
                return self.table(table)
            case Nothing(table):
                return self.table(table).where(F.lit(False))
            case Among(source, column, values, _):
                return among(self.rows(source), column, list(values))
            case Matching(source, condition):
                return self.rows(source).alias(node.table).where(F.expr(condition))
            case Typed(source, column, value):
                return self.rows(source).where(F.col(f"`{column}`") == F.lit(value))
            case In(source, column, keys, or_null):
                rows = self.rows(source)
                found = semi(rows, column, self.keys(keys))
                return found.union(rows.where(F.col(f"`{column}`").isNull())) if or_null else found
            case WithAncestors(source, primary_key, links):
                return with_ancestors(self.table(node.table), self.rows(source), primary_key, links)
        raise TypeError(type(node))


def typed_values(values: list, kind: P.DataType, column: str) -> list:
    """Values of a column's type; one that can't be is an error that names it."""
    out = []
    for v in values:
        try:
            if isinstance(kind, (P.ByteType, P.ShortType, P.IntegerType, P.LongType)):
                v = int(v)
            elif isinstance(kind, (P.FloatType, P.DoubleType)):
                v = float(v)
            elif isinstance(kind, P.BooleanType) and not isinstance(v, bool):
                v = {"true": True, "1": True, "false": False, "0": False}[str(v).lower()]
            elif isinstance(kind, P.StringType):
                v = str(v)
        except (ValueError, KeyError) as e:
            raise ConfigError(f"{v!r} isn't a value of {column} ({kind.simpleString()})") from e
        out.append(v)
    return out


def among(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column has one of the values; none for no values."""
    kind = rows.schema[column].dataType
    values = list(dict.fromkeys(typed_values(values, kind, column)))
    if not values:
        return rows.where(F.lit(False))
    c = F.col(f"`{column}`")
    literal = lambda v: F.lit(v).cast(kind)
    if len(values) <= MOST_LITERALS:
        return rows.where(c == literal(values[0]) if len(values) == 1 else c.isin([literal(v) for v in values]))
    base = kind if isinstance(kind, (P.StringType, P.NumericType, P.BooleanType)) else P.StringType()
    keys = rows.sparkSession.createDataFrame([(v,) for v in values], P.StructType([P.StructField(_KEY, base)]))
    return semi(rows, column, keys.select(F.col(_KEY).cast(kind).alias(_KEY)))


def semi(rows: DataFrame, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose column is (left_semi) or isn't (left_anti) among keys; values of different kinds meet as text."""
    a, b = F.col(f"__rows.`{column}`"), F.col(f"__keys.{_KEY}")
    kinds = rows.schema[column].dataType, keys.schema[0].dataType
    if kinds[0] != kinds[1] and not all(isinstance(k, P.NumericType) for k in kinds):
        a, b = a.cast("string"), b.cast("string")
    return rows.alias("__rows").join(keys.alias("__keys"), a == b, how)


def with_ancestors(table: DataFrame, base: DataFrame, primary_key: str, links: tuple[tuple[str, str], ...]) -> DataFrame:
    """The base rows and all rows of the table that can be reached from them. Nulls, missing parents and cycles end a walk."""
    pk = F.col(f"`{primary_key}`")
    kept = base.select(pk.alias(_KEY)).where(F.col(_KEY).isNotNull()).distinct()
    ancestors = _walk_on_driver(table, base, primary_key, links)
    if ancestors is None:
        ancestors = _walk(table, base, primary_key, links)
    return semi(table, primary_key, kept.union(ancestors).distinct())


def _walk_on_driver(table: DataFrame, base: DataFrame, primary_key: str, links) -> DataFrame | None:
    """Ancestors found on the driver; None where more than MOST_DRIVER_LINKS rows have a parent."""
    linked = reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNotNull() for c, _ in links))
    edges = table.where(linked).select(*(F.col(f"`{c}`") for c in dict.fromkeys([primary_key, *(x for l in links for x in l)])))
    rows = edges.limit(MOST_DRIVER_LINKS + 1).collect()
    if len(rows) > MOST_DRIVER_LINKS:
        return None
    frontier = [{r[0] for r in base.where(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`")).distinct().collect()} for c, _ in links]
    seen: set = set()
    # rows with parents are known; a root has none and is kept by its key alone, where links point at keys
    by = [{} for _ in links]
    for r in rows:
        for k, (_, ref) in enumerate(links):
            by[k].setdefault(r[ref], []).append(r)
    reached = [set(f) for f in frontier]
    while any(frontier):
        new: list[set] = [set() for _ in links]
        for k, values in enumerate(frontier):
            for v in values:
                for r in by[k].get(v, ()):
                    if r[primary_key] in seen:
                        continue
                    seen.add(r[primary_key])
                    for j, (c, _) in enumerate(links):
                        if r[c] is not None and r[c] not in reached[j]:
                            new[j].add(r[c])
        for j, n in enumerate(new):
            reached[j] |= n
        frontier = new
    parts = []
    for (_, ref), values in zip(links, reached, strict=True):
        keys = table.sparkSession.createDataFrame([(v,) for v in values], P.StructType([P.StructField(_KEY, table.schema[ref].dataType)]))
        parts.append(semi(table, ref, keys).select(F.col(f"`{primary_key}`").alias(_KEY)))
    return reduce(DataFrame.union, parts)


def _walk(table: DataFrame, base: DataFrame, primary_key: str, links) -> DataFrame:
    """Ancestors found by a distributed loop over a frontier, written to the shared folder in each round."""
    columns = list(dict.fromkeys([primary_key, *(c for c, _ in links)]))
    slim = table.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*columns, *(r for _, r in links)])))
    frontier = base.select(*(F.col(f"`{c}`") for c in columns))
    found = cut(frontier.select(F.col(f"`{primary_key}`").alias(_KEY)).where(F.lit(False)))
    while True:
        parents = [semi(slim, ref, frontier.select(F.col(f"`{c}`").alias(_KEY)).where(F.col(_KEY).isNotNull()).distinct()) for c, ref in links]
        new = reduce(DataFrame.union, (p.select(*(F.col(f"`{c}`") for c in columns)) for p in parents)).distinct()
        frontier = cut(semi(new, primary_key, found, "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.union(frontier.select(F.col(f"`{primary_key}`").alias(_KEY))).distinct())


def batches(keys: DataFrame, column: str, size: int) -> DataFrame:
    """Keys numbered in their order, `size` to a batch: (column, batch). Ranges are numbered in parallel, then offset."""
    ordered = keys.select(F.col(f"`{column}`").alias(column)).where(F.col(column).isNotNull()).distinct()
    ranged = cut(ordered.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
    counts = {r[0]: r[1] for r in ranged.groupBy("__part").count().collect()}  # a row for each partition
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    starts = F.create_map(*(F.lit(x) for pair in offsets for x in pair)) if offsets else F.create_map(F.lit(0), F.lit(0))
    return ranged.select(column, F.floor((F.col("__at") + starts[F.col("__part")]) / size).cast("long").alias("batch"))


def kept_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of several frames, in one job."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in frames.items()))


def column(name: str) -> Column:
    return F.col(f"`{name}`")
