"""Masking in place: for given keys, statements or merges that set masked values on the source's own rows."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from .config import ConfigError, Schema, Table
from .functions.masks import apply_masks, mask_document
from .operators.lower import among, semi, typed_values
from .plans.resolver import Request
from .sinks.escape import extended_json, literal, quote_name
from .sources import Source

SLICE = 1000


@dataclass
class MaskPatch:
    """The new values of the rows of some keys: `frame` has the primary key, and a column for each masked one."""

    table: Table
    frame: DataFrame
    keys: DataFrame
    columns: list[str]

    def missing(self) -> DataFrame:
        """Keys without a row."""
        return semi(self.keys.withColumnRenamed("key", self.table.primary_key), self.table.primary_key, self.frame.select(F.col(f"`{self.table.primary_key}`").alias("__key")), "left_anti")

    def summary(self) -> dict:
        """Rows found, columns set, and keys without a row."""
        return {"table": self.table.name, "rows": self.frame.count(), "columns": self.columns, "missing": sorted(r[0] for r in self.missing().collect())}

    def statements(self, dialect: str) -> DataFrame:
        """UPDATE statements, as column `value`: one for each row in SQLite, one for each slice of rows elsewhere."""
        name, pk = quote_name(self.table.name, dialect), self.table.primary_key
        kinds = {f.name: f.dataType for f in self.frame.schema.fields}
        lit = lambda c: literal(F.col(f"`{c}`"), kinds[c], dialect)
        if dialect == "sqlite":
            sets = [F.concat(F.lit(f"{quote_name(c, dialect)} = "), lit(c)) for c in self.columns]
            return self.frame.select(F.concat(F.lit(f"UPDATE {name} SET "), F.concat_ws(", ", *sets), F.lit(f" WHERE {quote_name(pk, dialect)} = "), lit(pk), F.lit(";")).alias("value"))
        own = [pk, *self.columns]
        quoted = [quote_name(c, dialect) for c in own]
        if dialect == "postgresql":
            row = F.concat(F.lit("("), F.concat_ws(", ", *(lit(c) for c in own)), F.lit(")"))
            # a first row of nulls of the table's own types gives the values their types
            typed = ", ".join(f"(SELECT {q} FROM {name} WHERE false)" for q in quoted)
            sets = ", ".join(f"{q} = v.{q}" for q in quoted[1:])
            head, between, tail = f"UPDATE {name} SET {sets} FROM (VALUES ({typed}), ", ", ", f") AS v ({', '.join(quoted)}) WHERE {name}.{quoted[0]} = v.{quoted[0]};"
        else:
            row = F.concat(F.lit("SELECT "), F.concat_ws(", ", *(F.concat(lit(c), F.lit(f" AS {q}")) for c, q in zip(own, quoted, strict=True))))
            head, between = f"UPDATE {name} JOIN (", " UNION ALL "
            tail = f") AS v ON {name}.{quoted[0]} = v.{quoted[0]} SET " + ", ".join(f"{name}.{q} = v.{q}" for q in quoted[1:]) + ";"
        lines = self.frame.withColumn("__slice", F.floor(F.monotonically_increasing_id() / SLICE)).select("__slice", F.col(f"`{pk}`").alias("__at"), row.alias("line"))
        slices = lines.groupBy("__slice").agg(F.array_sort(F.collect_list(F.struct("__at", "line"))).alias("lines"))
        return slices.select(F.concat(F.lit(head), F.array_join(F.transform("lines", lambda x: x["line"]), between), F.lit(tail)).alias("value"))

    def merged(self, target: DataFrame) -> DataFrame:
        """All rows of the table, with the new values where there are any."""
        pk = self.table.primary_key
        new = self.frame.select(F.col(f"`{pk}`").alias("__key"), F.lit(True).alias("__hit"), *(F.col(f"`{c}`").alias(f"__new_{c}") for c in self.columns))
        met = target.join(new, F.col(f"`{pk}`") == F.col("__key"), "left")
        return met.select(*(F.when(F.col("__hit"), F.col(f"`__new_{c}`")).otherwise(F.col(f"`{c}`")).alias(c) if c in self.columns else F.col(f"`{c}`") for c in target.columns))


def maskable(schema: Schema, name: str) -> Table:
    """The table, if it can be masked in place."""
    table = schema[name]
    if table.ignore or table.managed or table.embedded_in or not table.primary_key:
        raise ConfigError(f"{name} can't be masked in place: it is ignored, managed, embedded or without a single primary key")
    if table.primary_key not in table.column_names or any(c.masked and c.name == table.primary_key for c in table.columns):
        raise ConfigError(f"{name}: the primary key must be selected, and not masked")
    masked = any(c.masked for c in table.columns) or any(t.embedded_in and t.embedded_in.collection_name == name and any(c.masked for c in t.columns) for t in schema.live)
    if not masked:
        raise ConfigError(f"{name}: no column is masked")
    return table


def check_request(request: Request) -> None:
    if request.mode not in (None, "primary_key") or request.ids_field or request.scope_column or set(request.ids) - {"default"}:
        raise ConfigError("masking in place takes primary keys only")


def mask_update(schema: Schema, source: Source, name: str, keys: list, extra: dict[str, object] | None = None, dialect: str = "null") -> MaskPatch:
    """New values for the rows of `keys`. extra: assignments on every row, unless the column is masked.

    Only the keys choose the rows: the table's own filter doesn't count. A key that can't be of the column's type is an error.
    """
    table = maskable(schema, name)
    if not keys:
        raise ConfigError("no keys")
    rows = source(name)
    kind = rows.schema[table.primary_key].dataType
    keys = list(dict.fromkeys(typed_values(list(keys), kind, table.primary_key)))
    found = among(rows, table.primary_key, keys)
    columns = [c.name for c in table.columns if c.masked]
    frame = apply_masks(found, table, dialect, [table.primary_key, *columns])
    for column, value in (extra or {}).items():
        if column not in columns:
            frame = frame.withColumn(column, F.lit(value).cast(rows.schema[column].dataType))
            columns = [*columns, column]
    key_frame = rows.sparkSession.createDataFrame([(k,) for k in keys], P.StructType([P.StructField("key", kind if not isinstance(kind, P.DecimalType) else P.StringType())]))
    return MaskPatch(table, frame, key_frame, columns)


def mask_where(schema: Schema, source: Source, name: str, condition: str | Column | None, dialect: str = "null") -> MaskPatch:
    """New values for the rows of a condition, which must narrow the table: none is refused."""
    table = maskable(schema, name)
    if condition is None or isinstance(condition, str) and condition.strip().lower() in ("", "true", "1=1", "1 = 1"):
        raise ConfigError(f"{name}: a condition that narrows the table is needed")
    rows = source(name).alias(name).where(F.expr(condition) if isinstance(condition, str) else condition)
    columns = [c.name for c in table.columns if c.masked]
    frame = apply_masks(rows, table, dialect, [table.primary_key, *columns])
    return MaskPatch(table, frame, frame.select(F.col(f"`{table.primary_key}`").alias("key")), columns)


def document_updates(schema: Schema, source: Source, name: str, keys: list) -> DataFrame:
    """One line for each document of `keys`: an update with `$set` of changed fields and `$unset` of removed ones."""
    table = maskable(schema, name)
    rows = among(source(name), table.primary_key, list(keys))
    inner = [t for t in schema.live if t.embedded_in and t.embedded_in.collection_name == name]
    whole = replace(table, columns=table.columns)
    made = mask_document(rows, whole, inner)
    heads = {t.embedded_in.path.split(".")[0] for t in inner}
    changed = [c.name for c in table.columns if c.masked and not c.unset and c.name in made.columns] + sorted(heads & set(made.columns))
    kinds = {f.name: f.dataType for f in made.schema.fields}
    unset = [c.name for c in table.columns if c.unset]
    parts = [F.struct(*(extended_json(F.col(f"`{c}`"), kinds[c]).alias(c) for c in changed)).alias("$set")] if changed else []
    parts += [F.struct(*(F.lit("").alias(c) for c in unset)).alias("$unset")] if unset else []
    line = F.struct(F.struct(F.struct(F.col(f"`{table.primary_key}`")).alias("filter"), F.struct(*parts).alias("update")).alias("updateOne"))
    return made.select(F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def merge_summaries(parts: list[dict]) -> dict:
    """One summary of several."""
    return {"table": parts[0]["table"], "rows": sum(p["rows"] for p in parts), "columns": parts[0]["columns"], "missing": reduce(lambda a, b: a + b["missing"], parts, [])}


def write_all(frames: list[DataFrame], path: str) -> int:
    """Writes statement frames to one file, all of them computed before the first is written."""
    lines = [[r.value for r in f.toLocalIterator()] for f in frames]
    with open(path, "w", encoding="utf-8") as out:
        for part in lines:
            out.writelines(x + "\n" for x in part)
    return sum(map(len, lines))
