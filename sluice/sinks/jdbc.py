"""Database loads: fail / replace / append, typed DDL, key checks before
load, all-or-nothing commit through a staging table, optional index.

Executors write partitions in parallel over JDBC with ``batchsize`` rows per
round trip.  Spark commits per partition, so an all-or-nothing load writes a
staging table first; one database transaction then renames it into place
(new or replaced table) or moves its rows with ``INSERT ... SELECT``
(append).
"""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.casts import is_string
from ..operators.numbering import fill_keys
from ..sources.files import nan_to_null
from ..sources.jdbc import execute, jdbc_reader, table_exists
from ..specs import ColumnMapping, DatabaseDestination


class LoadError(RuntimeError):
    pass


# --- fixed values: identifier quote character per dialect ------------------
QUOTE = {"postgresql": '"', "mysql": "`", "sqlite": '"', "derby": '"'}


def quote(name: str, dialect: str) -> str:
    q = QUOTE[dialect]
    return q + name.replace(q, q + q) + q


# --- fixed values: table rename statement per dialect ----------------------
RENAME_SQL = {
    "postgresql": "ALTER TABLE {old} RENAME TO {new}",
    "mysql": "RENAME TABLE {old} TO {new}",
    "sqlite": "ALTER TABLE {old} RENAME TO {new}",
    "derby": "RENAME TABLE {old} TO {new}",
}


def column_types(df: DataFrame, mappings, dialect: str) -> str | None:
    """``createTableColumnTypes`` from the mappings (target names).

    On Derby, text columns keep Spark's default type: its dialect binds text
    as CLOB, which a VARCHAR column rejects for null values.
    """
    types = C.SQL_TYPES[dialect]
    by_name = {m.final_name: m for m in mappings or ()}
    parts = []
    for f in df.schema.fields:
        m = by_name.get(f.name)
        if m is None:
            continue
        if dialect == "derby" and is_string(f.dataType):
            continue
        parts.append(f"{f.name} {types[m.target_dtype]}")
    return ", ".join(parts) or None


def _key_checks(df: DataFrame, mappings) -> list[tuple[str, str, Column]]:
    """(column names, what is wrong, count of rows) for every key rule of the mappings.

    The primary-key columns are one key together.
    """
    mapped = [m for m in mappings or () if m.final_name in df.columns]

    def key(name: str) -> Column:
        # text keys are counted by digest: 32 bytes shuffled per value
        c = F.col(f"`{name}`")
        return F.sha2(c.cast("binary"), 256) if is_string(df.schema[name].dataType) else c

    checks = [(m.final_name, "null value(s) in a NOT NULL column", F.count_if(F.col(f"`{m.final_name}`").isNull()))
              for m in mapped if not m.is_nullable or m.is_primary_key]
    primary = [m.final_name for m in mapped if m.is_primary_key]
    keys = [([m.final_name], "UNIQUE column") for m in mapped if m.is_unique and [m.final_name] != primary]
    if primary:
        keys.append((primary, "PRIMARY KEY"))
    for names, what in keys:
        filled = reduce(lambda a, b: a & b, [F.col(f"`{n}`").isNotNull() for n in names])
        # rows with a null in the key are not compared: count_distinct leaves them out as well
        checks.append((", ".join(names), f"duplicate value(s) in a {what}",
                       F.count_if(filled) - F.count_distinct(*[key(n) for n in names])))
    return checks


def key_violations(df: DataFrame, mappings) -> DataFrame:
    """(column_name, problem, rows) for every key rule, in one aggregate pass (map-side partial counts)."""
    checks = _key_checks(df, mappings)
    counts = df.agg(*[c.cast("long").alias(f"k{i}") for i, (_, _, c) in enumerate(checks)])
    rows = [F.struct(F.lit(names).alias("column_name"), F.lit(what).alias("problem"), F.col(f"k{i}").alias("rows"))
            for i, (names, what, _) in enumerate(checks)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_keys(df: DataFrame, mappings) -> None:
    """Raises LoadError if rows break a key rule; checked before loading."""
    if not _key_checks(df, mappings):
        return
    problems = [f"{r['column_name']}: {r['rows']} {r['problem']}" for r in key_violations(df, mappings).collect() if r["rows"]]
    if problems:
        raise LoadError("; ".join(problems))


# --- fixed values: how a dialect states a column rule of a table -------------
NOT_NULL_SQL = {
    "postgresql": "ALTER TABLE {table} ALTER COLUMN {column} SET NOT NULL",
    "mysql": "ALTER TABLE {table} MODIFY COLUMN {column} {type} NOT NULL",
    "derby": "ALTER TABLE {table} ALTER COLUMN {column} NOT NULL",
}
DEFAULT_SQL = {
    "postgresql": "ALTER TABLE {table} ALTER COLUMN {column} SET DEFAULT {value}",
    "mysql": "ALTER TABLE {table} ALTER COLUMN {column} SET DEFAULT {value}",
    "derby": "ALTER TABLE {table} ALTER COLUMN {column} DEFAULT {value}",
}


# --- fixed values: how a dialect makes a loaded key column count on ---------
AUTO_INCREMENT_SQL = {
    "postgresql": "ALTER TABLE {table} ALTER COLUMN {column} ADD GENERATED BY DEFAULT AS IDENTITY (START WITH {next})",
    "mysql": "ALTER TABLE {table} MODIFY COLUMN {column} {type} NOT NULL AUTO_INCREMENT",
}


def auto_key(mappings) -> ColumnMapping | None:
    """The mapping of a primary key of one integer column, the only kind that counts up by itself."""
    primary = [m for m in mappings or () if m.is_primary_key]
    return primary[0] if len(primary) == 1 and primary[0].target_dtype in ("integer", "bigint") else None


def auto_increment_statements(table: str, mappings, dialect: str, next_key: int) -> list[str]:
    """Statements after which the database itself numbers later rows, from ``next_key`` on."""
    key = auto_key(mappings)
    if key is None or dialect not in AUTO_INCREMENT_SQL:
        return []
    return [AUTO_INCREMENT_SQL[dialect].format(table=table, column=quote(key.final_name, dialect), next=next_key,
                                               type=C.SQL_TYPES[dialect][key.target_dtype])]


def _sql_literal(value) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def constraint_statements(table: str, columns, mappings, dialect: str) -> list[str]:
    """Statements that give a freshly loaded table its NOT NULL, DEFAULT, UNIQUE and PRIMARY KEY rules.

    Spark's writer creates a table with types only.  SQLite cannot alter a
    table so; there, unique indexes stand in for both kinds of keys.
    """
    mapped = [m for m in mappings or () if m.final_name in set(columns)]
    out = []
    for m in mapped:
        column, kind = quote(m.final_name, dialect), C.SQL_TYPES[dialect][m.target_dtype]
        if (not m.is_nullable or m.is_primary_key) and dialect in NOT_NULL_SQL:
            out.append(NOT_NULL_SQL[dialect].format(table=table, column=column, type=kind))
        if m.default_value is not None and dialect in DEFAULT_SQL:
            out.append(DEFAULT_SQL[dialect].format(table=table, column=column, value=_sql_literal(m.default_value)))
    primary = [m.final_name for m in mapped if m.is_primary_key]
    unique = [[m.final_name] for m in mapped if m.is_unique and [m.final_name] != primary]
    for n, names in enumerate([primary, *unique] if primary else unique):
        joined = ", ".join(quote(c, dialect) for c in names)
        if dialect == "sqlite":
            out.append(f"CREATE UNIQUE INDEX {quote(f'{table}_key{n}', dialect)} ON {table} ({joined})")
        else:
            out.append(f"ALTER TABLE {table} ADD {'PRIMARY KEY' if names is primary else 'UNIQUE'} ({joined})")
    return out


def swap_statements(table: str, staging: str, exists: bool, dialect: str) -> list[str]:
    """Statements that put a staging table in a target's place.

    MySQL commits every DDL statement, so there one RENAME moves both names
    at once and the old table is dropped last: no moment without a target.
    """
    if not exists:
        return [RENAME_SQL[dialect].format(old=staging, new=table)]
    if dialect == "mysql":
        return [f"RENAME TABLE {table} TO {staging}_old, {staging} TO {table}", f"DROP TABLE {staging}_old"]
    return [f"DROP TABLE {table}", RENAME_SQL[dialect].format(old=staging, new=table)]


def load_table(
    df: DataFrame,
    dest: DatabaseDestination,
    mappings=(),
    batch_size: int = C.DEFAULT_BATCH_SIZE,
    order_by=(),
) -> dict:
    """Write ``df`` to a database table; returns a load report.

    With ``auto_increment``, rows without a value in an integer primary key
    are numbered in the order of ``order_by``, on from the largest key of the
    frame and of a table that is appended to.
    """
    spark = df.sparkSession
    conn = dest.connection
    mappings = [m if isinstance(m, ColumnMapping) else ColumnMapping(**m) for m in mappings or ()]
    exists = table_exists(spark, conn, dest.table_name)
    if exists and dest.if_exists == "fail":
        raise LoadError(f"Table '{dest.table_name}' already exists and if_exists='fail'.")
    key = auto_key(mappings) if dest.auto_increment else None
    if key is not None:
        largest = None
        if exists and dest.if_exists == "append":
            query = f"SELECT MAX({quote(key.final_name, conn.dialect)}) AS top FROM {dest.table_name}"
            largest = jdbc_reader(spark, conn).option("query", query).load().first()[0]
        df = fill_keys(df, key.final_name, order_by, largest)
    check_keys(df, mappings)

    base = nan_to_null(df)
    obs = Observation("load")
    clean = base.observe(obs, F.count(F.lit(1)).alias("rows"))
    ddl = column_types(df, mappings, conn.dialect)

    def write(frame, table, mode):
        w = frame.write.format("jdbc").mode(mode).option("dbtable", table).option("batchsize", batch_size)
        for k, v in conn.options().items():
            w = w.option(k, v)
        if ddl and mode != "append":
            w = w.option("createTableColumnTypes", ddl)
        w.save()

    if not dest.atomic:
        mode = {"fail": "error", "replace": "overwrite", "append": "append"}[dest.if_exists]
        write(clean, dest.table_name, mode)
    else:
        # parallel write into a private staging table, then one transaction
        # makes it visible: rename it into place, or append it to the target
        staging = f"{dest.table_name}_stg_{uuid.uuid4().hex[:8]}"
        rules = constraint_statements(staging, df.columns, mappings, conn.dialect)
        if key is not None and not (exists and dest.if_exists == "append"):
            top = df.agg(F.max(F.col(f"`{key.final_name}`").cast("long"))).first()[0] or 0
            rules += auto_increment_statements(staging, mappings, conn.dialect, top + 1)
        try:
            write(clean, staging, "error")
            if exists and dest.if_exists == "append":
                cols = ", ".join(quote(c, conn.dialect) for c in df.columns)
                stmts = [f"INSERT INTO {dest.table_name} ({cols}) SELECT {cols} FROM {staging}", f"DROP TABLE {staging}"]
            else:
                stmts = [*rules, *swap_statements(dest.table_name, staging, exists, conn.dialect)]
            execute(spark, conn, stmts)
        except Exception:
            # what was staged goes, whether its write or the swap failed; the target is only dropped once
            # the staging table has its name (MySQL) or in the same transaction
            if table_exists(spark, conn, staging):
                execute(spark, conn, [f"DROP TABLE {staging}"])
            raise

    report = {"table_name": dest.table_name, "rows_inserted": int(obs.get.get("rows", 0)), "rows_failed": 0}
    if dest.create_index and dest.index_columns:
        report["index_created"] = create_index(df, dest)
    return report


def create_index(df: DataFrame, dest: DatabaseDestination) -> bool:
    """CREATE INDEX after the load; a failure is reported, not raised."""
    cols = list(dest.index_columns or ())
    name = f"idx_{dest.table_name}_{'_'.join(cols)}"[:120]
    try:
        quoted = ", ".join(quote(c, dest.connection.dialect) for c in cols)
        execute(df.sparkSession, dest.connection, [f"CREATE INDEX {name} ON {dest.table_name} ({quoted})"])
        return True
    except Py4JJavaError:  # the database refused it
        return False


def write_clustered_table(df: DataFrame, table: str, key_columns, buckets: int, mode: str = "overwrite",
                          path: str | None = None) -> None:
    """The Spark-table form of an index: bucket and sort by the key columns
    so later joins and lookups on them skip the shuffle.  ``path`` keeps the
    files outside the warehouse folder."""
    (
        (df.write.option("path", path) if path else df.write).mode(mode)
        .bucketBy(buckets, *key_columns)
        .sortBy(*key_columns)
        .saveAsTable(table)
    )
