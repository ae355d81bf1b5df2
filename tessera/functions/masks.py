"""Masks compiled to Catalyst expressions, in two phases of one select each.

Templates, SQL expressions, constants and removals read the original row. Functions of the host
program, fake data and random tokens read what the first phase made; none sees another's output.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from .. import config as C
from . import pools

_PLACE = re.compile(r"\{([^{}]+)\}")
#: Functions that `map` may name; a config never holds code.
_FUNCTIONS: dict[str, Callable[[dict[str, Any]], Any]] = {}


def register_map(name: str, function: Callable[[dict[str, Any]], Any]) -> None:
    """Lets `"map": name` call `function` with each row as a dict."""
    _FUNCTIONS[name] = function


def template(text: str, dialect: str = "null", get: Callable[[str], Column] | None = None) -> Column:
    """`{column}` replaced by values. A null reference makes the result null, or counts as empty in dialect "empty"."""
    get = get or (lambda name: F.col(f"`{name}`"))
    parts, at = [], 0
    for m in _PLACE.finditer(text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        c = get(m[1]).cast("string")
        parts.append(F.coalesce(c, F.lit("")) if dialect == "empty" else c)
        at = m.end()
    if at < len(text) or not parts:
        parts.append(F.lit(text[at:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def replacement(value: C.Scalar, c: Column, kind: P.DataType, dialect: str = "null", get=None) -> Column:
    """`replace_with`: a template or a constant of the column's type; null stays null."""
    made = template(value, dialect, get) if isinstance(value, str) else F.lit(value)
    return F.when(c.isNotNull(), made.cast(kind))


def _first(column: C.Column, kind: P.DataType, dialect: str) -> Column:
    c = F.col(f"`{column.name}`")
    if column.unset:
        return F.lit(None).cast(kind)
    if column.raw_sql is not None:
        return F.expr(column.raw_sql)
    if column.replace_with is not None:
        return replacement(column.replace_with, c, kind, dialect)
    return c


@F.pandas_udf(P.StringType())
def _tokens(sizes: pd.Series) -> pd.Series:
    return sizes.map(lambda n: secrets.token_hex(int(n)))


#: Random hex of so many bytes, new in every evaluation.
random_hex = _tokens.asNondeterministic()


def _mapped(name: str, columns: list[str]) -> Column:
    if name not in _FUNCTIONS:
        raise C.ConfigError(f"map names {name!r}, which isn't registered")
    function = _FUNCTIONS[name]

    @F.pandas_udf(P.StringType())
    def call(rows: pd.DataFrame) -> pd.Series:
        made = (function(r) for r in rows.to_dict("records"))
        return pd.Series([None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in made], dtype=object)

    return call(F.struct(*(F.col(f"`{c}`") for c in columns)))


def _with_digests(rows: DataFrame, table: C.Table, columns: list[C.Column]) -> DataFrame:
    """Adds digests and pool indexes of the seeds, each computed once for a row however many values are made of it."""
    seeds = {C.seed_column(table.name, c.replace_with_fake_data.seed) for c in columns if c.replace_with_fake_data}
    sizes = {(C.seed_column(table.name, f.seed), pools.pool_size(f.type)) for c in columns if (f := c.replace_with_fake_data)}
    rows = rows.withColumns({f"__digest_{s}": pools.digest(F.col(f"`{s}`")) for s in sorted(seeds)}) if seeds else rows
    return rows.withColumns({f"__index_{s}_{n}": pools.index_of(F.col(f"`__digest_{s}`"), n) for s, n in sorted(sizes)}) if sizes else rows


def _second(table: C.Table, column: C.Column, kind: P.DataType, columns: list[str]) -> Column:
    c = F.col(f"`{column.name}`")
    if column.map is not None:
        return _mapped(column.map, columns).cast(kind)
    if (fake := column.replace_with_fake_data) is not None:
        seed = C.seed_column(table.name, fake.seed)
        made = pools.value_at(fake.type, F.col(f"`__digest_{seed}`"), F.col(f"`__index_{seed}_{pools.pool_size(fake.type)}`"), fake.locale)
        return F.when(c.isNotNull(), made.cast(kind))
    if column.replace_with_random is not None:
        return F.when(c.isNotNull(), random_hex(F.lit(int(column.replace_with_random.split(":")[1]))))
    return c


def apply_masks(rows: DataFrame, table: C.Table, dialect: str = "null", only: list[str] | None = None) -> DataFrame:
    """The declared columns of a table, masked; all columns, unmasked, of a managed table or one that declares none."""
    if table.managed or not table.columns:
        return rows
    columns = [c for c in table.columns if only is None or c.name in only]
    kinds = {c.name: rows.schema[c.name].dataType for c in table.columns}
    known = [c.name for c in table.columns]
    first = rows.alias(table.name).select(*(_first(c, kinds[c.name], dialect).alias(c.name) for c in table.columns))
    if not any(c.map or c.replace_with_fake_data or c.replace_with_random for c in columns):
        return first if only is None else first.select(*(F.col(f"`{c.name}`") for c in columns))
    return _with_digests(first, table, columns).select(*(_second(table, c, kinds[c.name], known).alias(c.name) for c in columns))


# Documents


def mask_struct(fields: list[C.Column], get: Callable[[str], Column], kinds: dict[str, P.DataType]) -> dict[str, Column]:
    """Masked fields of one level of a document: templates in order, each seeing those before it; then the rest."""
    now = {name: get(name) for name in kinds}
    for f in fields:
        if f.name in now and f.replace_with is not None and not f.unset:
            now[f.name] = replacement(f.replace_with, now[f.name], kinds[f.name], "empty", lambda n: now[n])
    out = dict(now)
    for f in fields:
        if f.name not in now:
            continue
        if f.unset:
            out.pop(f.name)
        elif (fake := f.replace_with_fake_data) is not None:
            out[f.name] = F.when(now[f.name].isNotNull(), pools.value(fake.type, now[fake.seed.split(".")[-1]], fake.locale).cast(kinds[f.name]))
        elif f.replace_with_random is not None:
            out[f.name] = F.when(now[f.name].isNotNull(), random_hex(F.lit(int(f.replace_with_random.split(":")[1]))))
    return out


def _embedded(value: Column, kind: P.DataType, path: list[str], fields: tuple[C.Column, ...]) -> Column:
    """Masks the struct, or the structs of an array, at a path below a value."""
    if isinstance(kind, P.ArrayType):
        return F.transform(value, lambda x: _embedded(x, kind.elementType, path, fields))
    if not isinstance(kind, P.StructType):
        return value
    kinds = {f.name: f.dataType for f in kind.fields}
    if path:
        if path[0] not in kinds:
            return value
        made = {n: value.getField(n) for n in kinds} | {path[0]: _embedded(value.getField(path[0]), kinds[path[0]], path[1:], fields)}
    else:
        known = {f.name for f in fields}
        made = mask_struct(list(fields), value.getField, kinds)
        made = {n: c for n, c in made.items() if n in known or isinstance(kinds[n], (P.StructType, P.ArrayType))}
    return F.when(value.isNotNull(), F.struct(*(c.alias(n) for n, c in made.items())))


def mask_document(rows: DataFrame, table: C.Table, embedded: list[C.Table] = ()) -> DataFrame:
    """Documents with declared fields and the paths of embedded collections, masked. Removed fields are absent."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    known = {f.name for f in table.columns} | {e.embedded_in.path.split(".")[0] for e in embedded}
    made = mask_struct(list(table.columns), lambda n: F.col(f"`{n}`"), kinds)
    out = rows.select(*(made[n].alias(n) for n in kinds if n in made and (n in known or not table.columns)))
    for e in sorted(embedded, key=lambda e: -e.embedded_in.path.count(".")):
        head, *path = e.embedded_in.path.split(".")
        if head in out.columns:
            out = out.withColumn(head, _embedded(F.col(f"`{head}`"), out.schema[head].dataType, path, e.columns))
    return out


# Default masks of safe mode


def default_mask(name: str, kind: P.DataType, primary_key: str | None, limit: int | None = None, default: C.Scalar | None = None, unique: bool = False) -> C.Scalar | None:
    """A constant or template that a new column is masked with until somebody decides; None where none fits.

    A varying text needs room for `masked-` and a key: 20 characters, 40 for a mail address.
    """
    if isinstance(kind, P.StringType):
        mail = "mail" in name.lower()
        if not primary_key or limit is not None and limit < (40 if mail else 20):
            return None
        return f"masked-{{{primary_key}}}" + ("@example.com" if mail else "")
    if unique:
        return None
    if default is not None:
        return default
    if isinstance(kind, P.BooleanType):
        return False
    if isinstance(kind, P.NumericType):
        return 0
    if isinstance(kind, P.DateType):
        return "2000-01-01"
    if isinstance(kind, (P.TimestampType, P.TimestampNTZType)):
        return "2000-01-01 00:00:00"
    if isinstance(kind, P.VariantType):
        return "{}"
    return None
