"""Writing an extraction: numbered files in load order, statements around the data, and hooks after it."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ConfigError, Table
from ..graph import load_order
from .ddl import create_collection, create_table
from .escape import copy_line, json_line, quote_name, tuple_text

CHUNK_ROWS, DOCUMENT_CHUNK_ROWS = 10_000, 1_000
FORMATS = ("insert", "copy", "jsonl", "parquet")


def chunk_rows(table: Table) -> int:
    return table.bulk_insert_chunk_size or (DOCUMENT_CHUNK_ROWS if table.document else CHUNK_ROWS)


def insert_header(table: Table, columns: list[str], dialect: str) -> str:
    names = "" if table.managed else " (" + ", ".join(quote_name(c, dialect, always=dialect == "mysql") for c in columns) + ")"
    return f"INSERT INTO {quote_name(table.name, dialect, always=dialect == 'mysql')}{names} VALUES\n"


def numbered(rows: DataFrame, table: Table) -> DataFrame:
    """Rows with the number of their chunk: by primary key within each partition of a range partitioning."""
    key = [F.col(f"`{table.primary_key}`")] if table.primary_key in rows.columns else [F.col(f"`{c}`") for c in rows.columns[:1]]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    at = F.monotonically_increasing_id()
    return ordered.withColumn("__part", F.spark_partition_id()).withColumn("__chunk", F.floor(at % (1 << 33) / chunk_rows(table)).cast("long"))


def insert_statements(rows: DataFrame, table: Table, dialect: str) -> DataFrame:
    """One text for each statement of at most the table's chunk of rows; column `value`, in (part, chunk)."""
    kinds = [(f.name, f.dataType) for f in rows.schema.fields]
    lines = numbered(rows, table).select("__part", "__chunk", F.monotonically_increasing_id().alias("__at"), tuple_text(kinds, dialect).alias("line"))
    chunks = lines.groupBy("__part", "__chunk").agg(F.array_sort(F.collect_list(F.struct("__at", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), ",\n")
    return chunks.select(F.col("__part").alias("part"), F.col("__chunk").alias("chunk"), F.concat(F.lit(insert_header(table, [n for n, _ in kinds], dialect)), body, F.lit(";")).alias("value"))


def copy_lines(rows: DataFrame) -> DataFrame:
    return rows.select(copy_line([(f.name, f.dataType) for f in rows.schema.fields]).alias("value"))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(json_line(rows.schema).alias("value"))


def before_statements(dialect: str) -> str:
    """Statements that let rows be loaded in any order."""
    if dialect == "mysql":
        return "SET FOREIGN_KEY_CHECKS = 0;\n"
    if dialect == "postgresql":
        return "DO $replica$ BEGIN\n  SET session_replication_role = replica;\nEXCEPTION\n  WHEN insufficient_privilege THEN RAISE WARNING 'foreign keys stay checked';\nEND $replica$;\n"
    return ""


def after_statements(table: Table, dialect: str) -> str:
    """Statements that put back what was changed, and set a sequence behind the greatest key."""
    if dialect == "mysql":
        return "SET FOREIGN_KEY_CHECKS = 1;\n"
    if dialect == "postgresql" and table.primary_key:
        name, key = quote_name(table.name, dialect), quote_name(table.primary_key, dialect)
        return f"SELECT setval(pg_get_serial_sequence('{name}', '{table.primary_key}'), max({key})) FROM {name} HAVING max({key}) IS NOT NULL AND pg_get_serial_sequence('{name}', '{table.primary_key}') IS NOT NULL;\n"
    return ""


@dataclass
class Written:
    """What was written: files by table, rows by table, and the order."""

    directory: str
    files: dict[str, str] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)


class WriteFailed(RuntimeError):
    """A table whose extraction or writing failed, with its plan."""


def prepare(directory: str, confirm: Callable[[list[str]], bool] | None = None) -> Path:
    """An empty output folder; what it holds is removed, if `confirm` agrees."""
    path = Path(directory)
    path.mkdir(parents=True, exist_ok=True)
    old = sorted(p for p in path.iterdir() if p.name.startswith(("insert-", "manifest")))
    if old and confirm and not confirm([p.name for p in old]):
        raise ConfigError(f"{directory} isn't empty")
    for p in old:
        if p.is_dir():
            for f in sorted(p.rglob("*"), reverse=True):
                f.rmdir() if f.is_dir() else f.unlink()
            p.rmdir()
        else:
            p.unlink()
    return path


def write(extraction, directory: str, output_format: str = "insert", dialect: str = "postgresql", hooks: list = (), confirm=None, parallelism: int | None = None) -> Written:
    """Writes all tables of an extraction (tessera.engine.Extraction) in load order.

    Statement files are made of the rows' texts, which stream through the driver a partition at a time. With `parallelism`, so
    many tables are written at a time, each by the executors alone as a folder of parts (`write_parts`, or Parquet); this is
    the way for large results. A table without rows has no file but keeps its number.
    """
    if output_format not in FORMATS or output_format == "copy" and dialect != "postgresql":
        raise ConfigError(f"format {output_format!r} isn't known for {dialect}")
    path = prepare(directory, confirm)
    order, _ = load_order(extraction.schema, [t.name for t in extraction.schema.tables if not t.embedded_in])
    done = Written(str(path), order=order)
    schema_text = []
    for name in order:
        table = extraction.schema[name]
        schema_text.append(create_collection(name, table.primary_key or "_id") if table.document else create_table(table, extraction.source(name).schema, dialect))
    (path / ("insert-000-schema.js" if any(t.document for t in extraction.schema.tables) else "insert-000-schema.sql")).write_text("\n".join(schema_text), encoding="utf-8")

    def one(number: int, name: str) -> tuple[str, int, str]:
        table = extraction.schema[name]
        try:
            rows = extraction.masked(name)
            kind = "jsonl" if table.document else output_format
            target = path / f"insert-{number:03d}-{name}.{kind if kind in ('jsonl', 'parquet') else 'sql'}"
            if kind == "parquet":
                n = _write_parquet(rows, table, target)
            else:
                n = write_parts(rows, table, str(target), kind, dialect) if parallelism else _write_text(rows, table, target, kind, dialect)
        except Exception as e:
            raise WriteFailed(f"{name}: {e}\n{extraction.plans[name].explain()}") from e
        return name, n, target.name

    todo = [(k, n) for k, n in enumerate(order, 1) if not extraction.schema[n].ignore and n in extraction.plans]
    with ThreadPoolExecutor(parallelism or 1) as pool:
        for name, n, file in pool.map(lambda x: one(*x), todo):
            done.rows[name] = n
            if n:
                done.files[name] = file
    for k, hook in enumerate(hooks):
        run_hook(hook, extraction, path, len(order) + 1 + k)
    (path / "manifest.json").write_text(json.dumps({"order": done.order, "files": done.files, "rows": done.rows}, indent=1), encoding="utf-8")
    return done


def _write_parquet(rows: DataFrame, table: Table, target: Path) -> int:
    from pyspark.sql import Observation

    seen = Observation()
    key = [table.primary_key] if table.primary_key in rows.columns else []
    out = rows.observe(seen, F.count("*").alias("n"))
    (out.sortWithinPartitions(*key) if key else out).write.mode("overwrite").parquet(str(target))
    return seen.get["n"]


def _write_text(rows: DataFrame, table: Table, target: Path, output_format: str, dialect: str) -> int:
    ordered = rows.orderBy(F.col(f"`{table.primary_key}`")) if table.primary_key in rows.columns else rows
    kinds = [(f.name, f.dataType) for f in rows.schema.fields]
    line = {"insert": lambda: tuple_text(kinds, dialect), "copy": lambda: copy_line(kinds), "jsonl": lambda: json_line(rows.schema)}[output_format]()
    n, chunk = 0, chunk_rows(table)
    with target.open("w", encoding="utf-8", newline="") as out:
        for n, row in enumerate(ordered.select(line.alias("value")).toLocalIterator(prefetchPartitions=True), 1):
            if output_format == "jsonl":
                out.write(row.value + "\n")
                continue
            if n == 1:
                out.write(before_statements(dialect))
            if output_format == "copy":
                if n == 1:
                    out.write(f"COPY {quote_name(table.name, dialect)} (" + ", ".join(quote_name(c, dialect) for c, _ in kinds) + ") FROM stdin;\n")
                out.write(row.value + "\n")
            else:
                first = (n - 1) % chunk == 0
                out.write((";\n" if first and n > 1 else "" if first else ",\n") + (insert_header(table, [c for c, _ in kinds], dialect) if first else "") + row.value)
        if n and output_format != "jsonl":
            out.write(("\\.\n" if output_format == "copy" else ";\n") + after_statements(table, dialect))
    if not n:
        target.unlink()
    return n


def write_parts(rows: DataFrame, table: Table, target: str, output_format: str, dialect: str = "postgresql", parts: int | None = None) -> int:
    """Writes a table's rows as a folder of text files, one for each range of primary keys, all of them by executors.

    Each file is complete: its statements hold at most the table's chunk of rows, and those around the data are in each.
    """
    from pyspark.sql import Observation

    key = F.col(f"`{table.primary_key}`") if table.primary_key in rows.columns else F.col(f"`{rows.columns[0]}`")
    kinds = [(f.name, f.dataType) for f in rows.schema.fields]
    line = {"insert": lambda: tuple_text(kinds, dialect), "copy": lambda: copy_line(kinds), "jsonl": lambda: json_line(rows.schema)}[output_format]()
    ranged = rows.repartitionByRange(parts, key) if parts else rows.repartitionByRange(key)
    seen = Observation()
    lines = ranged.sortWithinPartitions(key).observe(seen, F.count("*").alias("n")).select(line.alias("value"))
    if output_format != "jsonl":
        names = [n for n, _ in kinds]
        before, after, chunk = before_statements(dialect), after_statements(table, dialect), chunk_rows(table)
        head = insert_header(table, names, dialect) if output_format == "insert" else f"COPY {quote_name(table.name, dialect)} (" + ", ".join(quote_name(c, dialect) for c in names) + ") FROM stdin;\n"

        def complete(batches):
            n, held = 0, None
            for batch in batches:
                out = []
                for value in batch.column(0).to_pylist():
                    if output_format == "copy":
                        out.append((before + head if not n else "") + value)
                    else:
                        if held is not None:
                            out.append(held + (";" if n % chunk == 0 else ","))
                        held = ((before if not n else "") + head if n % chunk == 0 else "") + value
                    n += 1
                yield pa.record_batch({"value": pa.array(out, pa.string())})
            if n:
                yield pa.record_batch({"value": pa.array([((held + ";") if held is not None else "\\.") + ("\n" + after.rstrip("\n") if after else "")], pa.string())})

        lines = lines.mapInArrow(complete, "value string")
    lines.write.mode("overwrite").text(target)
    return seen.get["n"]


class HookContext:
    """What a hook sees: the extraction, ids that were kept, and files to add."""

    def __init__(self, extraction, path: Path, number: int):
        self.extraction, self.path, self.number = extraction, path, number

    def ids_for(self, table: str) -> list:
        t = self.extraction.schema[table]
        return [r[0] for r in self.extraction.rows(table).select(t.primary_key).orderBy(t.primary_key).toLocalIterator()]

    def insert_sql(self, text: str, name: str = "hook") -> None:
        self._add(text, name, "sql")

    def insert_jsonl(self, documents: list[dict], name: str = "hook") -> None:
        self._add("".join(json.dumps(d) + "\n" for d in documents), name, "jsonl")

    def _add(self, text: str, name: str, ending: str) -> None:
        with (self.path / f"insert-{self.number:03d}-{name}.{ending}").open("a", encoding="utf-8") as f:
            f.write(text)


def run_hook(hook, extraction, path: Path, number: int) -> None:
    """A function of a HookContext, or an executable that gets the folder and its number in its environment."""
    if callable(hook):
        hook(HookContext(extraction, path, number))
        return
    env = os.environ | {"OUTPUT_DIR": str(path), "NEXT_NUMBER": f"{number:03d}", "TARGET_TABLE": extraction.request.target or "", "IDS": ",".join(str(i) for ids in extraction.request.ids.values() for i in ids)}
    subprocess.run([str(hook)], env=env, check=True)
