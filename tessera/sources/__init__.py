"""Sources: a resolver from a table's name to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..config import ConfigError, Table

Source = Callable[[str], DataFrame]

#: Names by which an adapter may be called, and the one that is used.
ALIASES = {"sqlite3": "sqlite", "mysql2": "mysql", "trilogy": "mysql", "postgres": "postgresql", "pg": "postgresql", "mongo": "mongodb"}
_DRIVERS = {"sqlite": "org.sqlite.JDBC", "mysql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver"}
ADAPTERS = ("parquet", "json", "jsonl", "catalog", *_DRIVERS, "mongodb")


def adapter_name(name: str) -> str:
    name = ALIASES.get(name.lower(), name.lower())
    if name not in ADAPTERS:
        raise ConfigError(f"unknown adapter {name!r}; known are {', '.join(ADAPTERS)}")
    return name


def tag(spark: SparkSession, table: str) -> str:
    """Marks the jobs of a table's extraction, and gives the comment that a database sees; comment ends are taken out."""
    clean = table.replace("*/", "").replace("/*", "")
    spark.sparkContext.setJobDescription(f"extract {clean}")
    return f"/* extract table={clean} */"


def parquet(spark: SparkSession, directory: str) -> Source:
    """A Parquet file or folder for each table: columns are pruned and filters pushed into the scan."""
    return lambda name: spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def json_lines(spark: SparkSession, directory: str, schemas: dict | None = None, ending: str = "jsonl") -> Source:
    """A file of JSON documents for each collection, by their schema where one is given."""

    def read(name: str) -> DataFrame:
        reader = spark.read.option("mode", "FAILFAST")
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        return reader.json(f"{directory.rstrip('/')}/{name}.{ending}")

    return read


def catalog(spark: SparkSession, database: str | None = None) -> Source:
    """Tables of the session's catalog."""
    return lambda name: spark.table(f"{database}.{name}" if database else name)


def discover(spark: SparkSession, adapter: str, location: str) -> list[str] | None:
    """The tables of a source, sorted; None where the source can't say. A location that can't be read is an error."""
    adapter = adapter_name(adapter)
    if adapter == "catalog":
        return sorted(t.name for t in spark.catalog.listTables(location or None) if t.tableType not in ("VIEW", "TEMPORARY"))
    ending = {"parquet": ".parquet", "json": ".jsonl", "jsonl": ".jsonl", "mongodb": ".jsonl"}.get(adapter)
    if ending is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    try:
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    except Exception as e:
        raise ConfigError(f"{location} can't be listed: {str(e).splitlines()[0]}") from e
    names = [f.getPath().getName() for f in found]
    return sorted(n.removesuffix(ending) for n in names if n.endswith(ending))


def given(frames: dict[str, DataFrame]) -> Source:
    """DataFrames that the caller has made."""

    def read(name: str) -> DataFrame:
        if name not in frames:
            raise ConfigError(f"no table {name!r} was given")
        return frames[name]

    return read


def jdbc_options(adapter: str, url: str, table: Table | str, user: str | None = None, password: str | None = None, fetch_size: int = 10_000, timeout_ms: int | None = None, bounds: tuple[str, int, int, int] | None = None, ssl: str | None = None) -> dict[str, str]:
    """Options of a JDBC scan: streamed in batches, tagged, and split by `bounds` (column, least, most, parts)."""
    name = table if isinstance(table, str) else table.name
    adapter = adapter_name(adapter)
    out = {"url": url, "driver": _DRIVERS[adapter], "dbtable": name, "fetchsize": str(fetch_size)}
    if adapter != "sqlite":
        out["sessionInitStatement"] = f"/* extract table={name.replace('*/', '').replace('/*', '')} */ SELECT 1"
    if user is not None:
        out["user"] = user
    if password is not None:
        out["password"] = password
    timeout_ms = timeout_ms or (table.query_timeout_ms if isinstance(table, Table) else None)
    if timeout_ms:
        out["queryTimeout"] = str(-(-timeout_ms // 1000))
    if bounds:
        column, low, high, parts = bounds
        out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    if ssl:
        out["sslmode" if adapter == "postgresql" else "sslMode"] = ssl
    return out


def jdbc(spark: SparkSession, adapter: str, url: str, bounds: dict[str, tuple] | None = None, **options) -> Source:
    """Tables of a database; filters and columns are pushed down."""
    return lambda name: spark.read.format("jdbc").options(**jdbc_options(adapter, url, name, bounds=(bounds or {}).get(name), **options)).load()


def open_source(spark: SparkSession, adapter: str, location: str, **options) -> Source:
    """The source of an adapter."""
    adapter = adapter_name(adapter)
    if adapter == "parquet":
        return parquet(spark, location)
    if adapter in ("json", "jsonl", "mongodb"):
        return json_lines(spark, location, options.get("schemas"), PurePosixPath(options.get("ending", "jsonl")).name)
    if adapter == "catalog":
        return catalog(spark, location or None)
    return jdbc(spark, adapter, location, **options)
