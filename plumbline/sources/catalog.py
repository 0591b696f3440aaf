"""Tables: readers by type, introspection, fingerprints, declared against live, column statistics."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from fnmatch import fnmatchcase
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import Refusal
from plumbline.model import Column, Source

Reader = Callable[[SparkSession, dict, str], DataFrame]


def _files(kind: str) -> Reader:
    return lambda spark, conf, table: spark.read.format(kind).options(**conf.get("options", {})).load(f"{conf['path'].rstrip('/')}/{table}{conf.get('suffix', f'.{kind}')}")


def jdbc_options(driver: str | None, start: str | None, conf: dict, table: str) -> dict[str, Any]:
    """Options of a JDBC read: a session that only reads where the database has such, a limit in seconds, and what the connection adds."""
    made = {"url": conf["url"], "dbtable": table, "queryTimeout": conf.get("timeout", 300), "fetchsize": 10_000}
    made |= {k: v for k, v in (("driver", driver), ("sessionInitStatement", start)) if v}
    if keys := conf.get("iam"):
        # Credentials of a role instead of a password; the driver asks for them.
        made |= {"url": re.sub(r"^jdbc:redshift:(?!iam:)", "jdbc:redshift:iam:", conf["url"]), **{k: keys[k] for k in ("AccessKeyID", "SecretAccessKey", "SessionToken", "Profile", "DbUser") if k in keys}}
    return made | conf.get("options", {})


def _jdbc(driver: str | None, start: str | None = None) -> Reader:
    def read(spark: SparkSession, conf: dict, table: str) -> DataFrame:
        options = jdbc_options(driver, start, conf, table)
        return spark.read.format("jdbc").options(**options).load()

    return read


READERS: dict[str, Reader] = {
    **{kind: _files(kind) for kind in ("parquet", "csv", "json", "orc")},
    "catalog": lambda spark, conf, table: spark.table(f"{conf['schema']}.{table}" if conf.get("schema") else table),
    "duckdb": _jdbc("org.duckdb.DuckDBDriver"),
    "sqlite": _jdbc("org.sqlite.JDBC", "pragma query_only = on"),
    "postgres": _jdbc("org.postgresql.Driver", "set session characteristics as transaction read only"),
    "redshift": _jdbc("com.amazon.redshift.Driver", "set readonly to on"),
    "jdbc": _jdbc(None),
}


def register(kind: str, reader: Reader) -> None:
    """A reader for a type of connection; replaces one that is there."""
    READERS[kind] = reader


def read(spark: SparkSession, connections: dict[str, dict], connection: str, table: str) -> DataFrame:
    conf = connections.get(connection)
    if conf is None or conf.get("type") not in READERS:
        raise Refusal("connection_error", f"connection {connection!r} is unknown or of an unknown type", sorted(connections))
    try:
        return READERS[conf["type"]](spark, conf, table)
    except Refusal:
        raise
    except Exception as error:
        raise Refusal("connection_error", f"{connection}: {str(error).splitlines()[0]}") from error


def normalised(kind: T.DataType) -> tuple[str, bool]:
    """One of the eight declared types, and whether the type is known; what isn't becomes json, never dropped."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "string", True
    for name, kinds in {
        "bool": T.BooleanType, "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "decimal": T.DecimalType,
        "float": (T.FloatType, T.DoubleType), "date": T.DateType, "timestamp": (T.TimestampType, T.TimestampNTZType),
        "json": (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType, T.NullType),
    }.items():
        if isinstance(kind, kinds):
            return name, True
    return "json", False


def introspect(df: DataFrame) -> tuple[list[Column], list[str]]:
    """Columns of a relation, without reading it, and warnings of unknown types."""
    columns, warnings = [], []
    for f in df.schema.fields:
        name, known = normalised(f.dataType)
        warnings += [] if known else [f"{f.name}: {f.dataType.simpleString()} is read as json"]
        columns.append(Column(f.name, name, f.nullable))
    return columns, warnings


def fingerprint(columns: list[Column], primary_key: tuple[str, ...] = (), foreign_keys: tuple[tuple[str, ...], ...] = ()) -> str:
    told = {"columns": [[c.name, c.type, c.nullable, i] for i, c in enumerate(columns)], "primary_key": list(primary_key), "foreign_keys": [list(k) for k in foreign_keys]}
    return "sha256:" + hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def probe(declared: Source, df: DataFrame) -> list[str]:
    """Refuses columns that are missing or of another type; returns those that aren't declared."""
    live = {c.name: c for c in introspect(df)[0]}
    wrong = [f"{c.name} is missing" for c in declared.columns if c.name not in live]
    wrong += [f"{c.name} is {live[c.name].type}, not {c.type}" for c in declared.columns if c.name in live and live[c.name].type != c.type]
    if wrong:
        raise Refusal("schema_mismatch", f"{declared.name}: {'; '.join(wrong)}")
    return sorted(set(live) - {c.name for c in declared.columns})


def select_relations(names: list[str], schemas: tuple[str, ...] = (), tables: tuple[str, ...] = ()) -> list[str]:
    """Qualified names in these schemas whose qualified or bare name fits one of the patterns."""
    out = []
    for name in names:
        schema, _, bare = name.rpartition(".")
        if (not schemas or schema in schemas) and (not tables or any(fnmatchcase(name, t) or fnmatchcase(bare, t) for t in tables)):
            out.append(name)
    return out


#: Columns whose estimate is at least this share of the rows are counted exactly; estimates are off by about 0.01.
SETTLE = 0.9


def column_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    """column, n_distinct (nulls not counted), uniqueness_ratio, null_fraction and is_unique: whether every row has a value of its own.

    One pass estimates the counts; a second one counts the columns that may be unique exactly, or all with ``exact``.
    A row of numbers for each column comes to the driver.
    """
    text = {c: F.col("`" + c.replace("`", "``") + "`").cast("string") for c in df.columns}
    names = list(text)
    sketches = [F.hll_sketch_estimate(F.hll_sketch_agg(text[c], 14)).alias(f"d{i}") for i, c in enumerate(names)]
    nulls = [F.avg(text[c].isNull().cast("double")).alias(f"n{i}") for i, c in enumerate(names)]
    told = df.agg(F.count(F.lit(1)).alias("rows"), *sketches, *nulls).first()
    total = told["rows"]
    near = [i for i in range(len(names)) if exact or told[f"d{i}"] >= total * SETTLE]
    counted = df.agg(*[F.count_distinct(text[names[i]]).alias(f"d{i}") for i in near]).first().asDict() if near else {}
    out = []
    for i, c in enumerate(names):
        n = counted.get(f"d{i}", told[f"d{i}"])
        out.append((c, n, n / total if total else None, told[f"n{i}"], 0 < n == total))
    schema = "column string, n_distinct long, uniqueness_ratio double, null_fraction double, is_unique boolean"
    return df.sparkSession.createDataFrame(out, schema)


_CREATE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`]+)\s*\(", re.I)
# Declared types of other engines and what they are here (fixed values).
DDL_TYPES = {
    "string": "char character varchar text string uuid clob time interval enum",
    "int": "tinyint smallint int integer bigint serial bigserial int2 int4 int8 hugeint",
    "decimal": "decimal numeric money",
    "float": "float float4 float8 real double",
    "bool": "bool boolean",
    "date": "date",
    "timestamp": "timestamp timestamptz datetime",
    "json": "json jsonb blob bytea array map struct variant",
}


def from_ddl(text: str) -> dict[str, tuple[list[Column], tuple[str, ...]]]:
    """Columns and primary key of each CREATE TABLE of a script."""
    kinds = {word: kind for kind, words in DDL_TYPES.items() for word in words.split()}
    text, out = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S), {}
    for found in _CREATE.finditer(text):
        depth, at, parts, start = 1, found.end(), [], found.end()
        while at < len(text) and depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            if depth == 0 or depth == 1 and text[at] == ",":
                parts.append(text[start:at].strip())
                start = at + 1
            at += 1
        columns, key = [], ()
        for part in filter(None, parts):
            if constraint := re.match(r"(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)", part, re.I):
                key = tuple(x.strip(" \"`") for x in constraint[1].split(","))
            elif not re.match(r"(constraint|foreign|unique|check|primary|index|key)\b", part, re.I):
                name, kind = re.match(r"[\"`]?(\w+)[\"`]?\s+(\w+)", part).groups()
                own_key = bool(re.search(r"\bprimary\s+key\b", part, re.I))
                key = key or ((name,) if own_key else ())
                columns.append(Column(name, kinds.get(kind.lower(), "json"), not (own_key or re.search(r"\bnot\s+null\b", part, re.I))))
        out[found[1].strip("\"`")] = (columns, key)
    return out
