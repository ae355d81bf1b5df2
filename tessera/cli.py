"""Command line: export, explain, mask-update, schema generate, check, tidy and show. Exits 0, 1 (findings) or 2 (can't run)."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import catalog as K
from . import config as C
from .engine import Extraction
from .patch import check_request, mask_update, write_all
from .plans.resolver import Request
from .sinks.writer import write
from .sources import adapter_name, discover, open_source


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command")

    def command(name: str, of=commands):
        p = of.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--schema-dir")
        p.add_argument("--profile")
        p.add_argument("--adapter", default="parquet")
        p.add_argument("--source", dest="source_dir")
        p.add_argument("--log-level", choices=["ERROR", "WARN", "INFO", "DEBUG"])
        return p

    for name in ("export", "explain"):
        p = command(name)
        p.add_argument("--target-table")
        p.add_argument("--ids", action="append", default=[])
        p.add_argument("--ids-field")
        p.add_argument("--mode")
        p.add_argument("--no-recursive", dest="recursive", action="store_false", default=None)
        p.add_argument("--dialect", default=None)
        if name == "export":
            p.add_argument("--output-dir")
            p.add_argument("--output-format", default=None)
            p.add_argument("--parallelism", type=int, help="tables written at a time, as Parquet or in parts")
        else:
            p.add_argument("--physical", action="store_true")
    p = command("mask-update")
    p.add_argument("--target-table")
    p.add_argument("--ids", action="append", default=[])
    p.add_argument("--dialect", default=None)
    p.add_argument("--output", help="a file for the statements, written when all are made")
    schema = commands.add_parser("schema").add_subparsers(dest="action", required=True)
    for name in ("generate", "check", "tidy", "show"):
        p = command(name, schema)
        p.add_argument("--keys", default="{}", help="JSON: primary key by table")
        p.add_argument("--relations", default="{}", help="JSON: [[column, parent], ...] by table")
        p.add_argument("--plain", action="store_true", help="don't mask new columns")
        p.add_argument("--fail-on", choices=["all", "stale"], default="all")
        p.add_argument("--table")
        p.add_argument("--database-schema", default="public", help="the schema of a database to read")
    return top


def _settings(args: argparse.Namespace) -> dict:
    own = {k: v for k, v in vars(args).items() if v not in (None, [], "")}
    return (C.load_run_config(args.config) if args.config else {}) | own


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0].startswith("-") and argv[0] not in ("-h", "--help"):
        argv = ["export", *argv]
    try:
        s = _settings(_parser().parse_args(argv))
    except SystemExit as e:
        return int(bool(e.code)) * 2
    try:
        return _run(s, spark)
    except (C.ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(s: dict, spark: SparkSession | None) -> int:
    profiles = tuple(s.get("profiles") or ())
    if not s.get("schema_dir"):
        raise C.ConfigError("--schema-dir is needed")
    if s["command"] == "schema" and s["action"] == "show":
        base, overlays = C.read_objects(s["schema_dir"], profiles)
        if s.get("profile") and s["profile"] not in profiles:
            raise C.ConfigError(f"profile {s['profile']!r} isn't declared")
        for name, o in base.items():
            if s.get("table") in (None, name):
                over = overlays.get((s.get("profile"), name))
                print(json.dumps(C.merge_overlay(o, over) if over else o, indent=2, ensure_ascii=False))
        return 0
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    if s.get("log_level"):
        spark.sparkContext.setLogLevel(s["log_level"])
    source = open_source(spark, s.get("adapter", "parquet"), s.get("source_dir") or "")
    if s["command"] == "schema":
        return _schema(s, profiles, spark, source)
    schema = C.load_schema(s["schema_dir"], s.get("profile"), profiles)
    if s["command"] == "mask-update":
        request = Request(C.parse_ids(s.get("ids") or []), s.get("target_table"), s.get("ids_field"), s.get("scope_column"), s.get("mode"))
        check_request(request)
        if not request.target or not request.ids.get("default"):
            raise C.ConfigError("mask-update needs --target-table and --ids")
        patch = mask_update(schema, source, request.target, request.ids["default"])
        statements = patch.statements(s.get("dialect") or "postgresql")
        if s.get("output"):
            write_all([statements], s["output"])
        else:
            for row in statements.toLocalIterator():
                print(row.value)
        print(json.dumps(patch.summary()), file=sys.stderr)
        return 0
    request = Request(C.parse_ids(s.get("ids") or []), s.get("target_table"), s.get("ids_field"), s.get("scope_column"), s.get("mode"), s.get("recursive", True))
    extraction = Extraction(schema, request, source, measure=s["command"] != "explain")
    if s["command"] == "explain":
        print(extraction.explain(s.get("physical", False)))
        return 0
    if not s.get("output_dir"):
        raise C.ConfigError("--output-dir is needed")
    done = write(extraction, s["output_dir"], s.get("output_format") or "insert", s.get("dialect") or "postgresql", parallelism=s.get("parallelism"))
    for note in extraction.notes():
        print(f"note: {note}", file=sys.stderr)
    print(json.dumps(done.rows))
    return 0


def _found(s: dict, base: dict[str, dict], spark: SparkSession, source) -> list[K.Found]:
    """What the source holds. A table that is listed and can't be read is an error, so that nothing counts as gone by accident."""
    adapter, location = adapter_name(s.get("adapter", "parquet")), s.get("source_dir") or ""
    listed = discover(spark, adapter, location)
    if listed is None:
        return K.introspect_database(spark, adapter, location, s.get("database_schema") or "public")
    keys, relations = json.loads(s.get("keys", "{}")), json.loads(s.get("relations", "{}"))
    frames = {}
    for name in listed:
        try:
            frames[name] = source(name)
            frames[name].schema  # noqa: B018  read now, while the table's name is known
        except Exception as e:
            raise C.ConfigError(f"{name} can't be read: {str(e).splitlines()[0]}") from e
    if adapter in ("json", "jsonl", "mongodb") or any("fields" in o for o in base.values()):
        return K.introspect_documents(frames, {k: [tuple(x) for x in v] for k, v in relations.items()})
    known = {n: o["primary_key"] for n, o in base.items() if o.get("primary_key")}
    return K.introspect(frames, known | keys, {k: [tuple(x) for x in v] for k, v in relations.items()})


def _schema(s: dict, profiles: tuple[str, ...], spark: SparkSession, source) -> int:
    directory = Path(s["schema_dir"])
    if s["action"] == "generate":
        directory.mkdir(parents=True, exist_ok=True)
    base, overlays = C.read_objects(directory, profiles)
    found = _found(s, base, spark, source)
    if s["action"] == "generate":
        K.write_objects(K.generate(found, base, not s.get("plain")), directory)
        return 0
    if s["action"] == "tidy":
        if base and not found:
            raise C.ConfigError("the source has no tables: nothing is tidied")
        kept = K.tidy(found, base)
        for n in base.keys() - kept.keys():
            (directory / f"{n}.json").unlink(missing_ok=True)
        K.write_objects(kept, directory)
        for (profile, n), o in overlays.items():
            file = directory / f"{n}.{profile}.json"
            if n in kept:
                file.write_text(json.dumps(C.prune_overlay(o, kept[n])[0], indent=2) + "\n", encoding="utf-8")
            else:
                file.unlink(missing_ok=True)
        return 0
    report = K.drift(found, base, overlays)
    if s.get("fail_on") == "stale":
        report = {k: v for k, v in report.items() if "stale" in k}
    else:
        report |= K.static_checks(base, overlays, profiles, K.CheckConfig.of(s.get("check")))
    print(json.dumps(report, indent=2))
    return int(any(report.values()))


if __name__ == "__main__":
    sys.exit(main())
