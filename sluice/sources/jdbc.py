"""Database sources over Spark's JDBC data source.

Table and query scans, column whitelists (pruned into the scan by
Catalyst), parallel range-partitioned reads, schema preview without rows,
table listing, existence test and a per-table summary.  Catalogue lookups
are JDBC ``query`` reads of the database's own catalogue views.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapping import auto_mappings
from ..operators.numbering import equal_ranges
from ..specs import DatabaseConnection, DatabaseSource

# --- fixed values: catalogue query listing user tables, per dialect --------
TABLE_LIST_SQL = {
    "postgresql": "SELECT table_name FROM information_schema.tables "
    "WHERE table_schema = 'public' AND table_type = 'BASE TABLE'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'",
    "derby": "SELECT TABLENAME AS table_name FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'",
}


def jdbc_reader(spark: SparkSession, conn: DatabaseConnection):
    reader = spark.read.format("jdbc")
    for k, v in conn.options().items():
        reader = reader.option(k, v)
    return reader


def bounds_query(source: DatabaseSource) -> str:
    """The source-side query for the range of the partition column."""
    c = source.partition_column
    return f"SELECT MIN({c}) AS low, MAX({c}) AS high FROM {source.table_name}"


def sql_value(value) -> str:
    """A value as a SQL literal that the databases above agree on."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, lows) -> list[str]:
    """Conditions that deal every row to one range: one for each different lower bound, and one for nulls.

    The first range is open below, so rows that come in after the bounds were
    taken are read too.  Bounds must be in the database's own order.
    """
    bounds = []
    for low in lows:
        if low is not None and (not bounds or low != bounds[-1]):
            bounds.append(low)
    if not bounds:
        return ["1 = 1"]
    shown = [sql_value(b) for b in bounds[1:]]
    out = [f"{column} < {shown[0]}" if shown else f"{column} IS NOT NULL"]
    out += [f"{column} >= {a} AND {column} < {b}" for a, b in zip(shown, shown[1:])]
    if shown:
        out.append(f"{column} >= {shown[-1]}")
    return [*out, f"{column} IS NULL"]


def equal_depth_predicates(spark: SparkSession, source: DatabaseSource, k: int) -> list[str]:
    """Conditions of ``k`` ranges with equally many rows, from one read of the partition column alone."""
    c = source.partition_column
    keys = jdbc_reader(spark, source.connection).option("query", f"SELECT {c} FROM {source.table_name}").load()
    tiles = equal_ranges(keys, keys.columns[0], k).orderBy("tile").select("low").collect()  # k rows
    return range_predicates(c, [r["low"] for r in tiles])


def read_db(spark: SparkSession, source: DatabaseSource) -> DataFrame:
    """Rows of a table or of a source-side query.

    A column whitelist applies to table scans (ignored with a query).  With
    ``partition_column``, the scan runs as ``num_partitions`` parallel range
    queries instead of one connection; bounds that are not given are asked of
    the database.  With ``equal_depth`` the ranges hold equally many rows,
    however skewed the column is, and it may be text or a date (text needs a
    database that compares bytes, as Spark does).
    """
    if source.equal_depth:
        options = source.connection.options()
        k = source.num_partitions or spark.sparkContext.defaultParallelism
        if source.fetch_size:
            options = options | {"fetchsize": str(source.fetch_size)}
        df = spark.read.jdbc(options["url"], source.table_name, predicates=equal_depth_predicates(spark, source, k),
                             properties={n: str(v) for n, v in options.items() if n != "url"})
        return df.select(*[F.col(f"`{c}`") for c in source.columns]) if source.columns else df
    reader = jdbc_reader(spark, source.connection)
    if source.fetch_size:
        reader = reader.option("fetchsize", source.fetch_size)
    if source.query:
        return reader.option("query", source.query).load()
    reader = reader.option("dbtable", source.table_name)
    if source.partition_column:
        low, high = source.lower_bound, source.upper_bound
        if low is None or high is None:
            found = jdbc_reader(spark, source.connection).option("query", bounds_query(source)).load().first()
            low, high = found[0] if low is None else low, found[1] if high is None else high
        if low is not None and high is not None:  # else the table is empty, or the column all null
            reader = (
                reader.option("partitionColumn", source.partition_column)
                .option("lowerBound", low)
                .option("upperBound", high)
                .option("numPartitions", source.num_partitions or spark.sparkContext.defaultParallelism)
            )
    df = reader.load()
    if source.columns:
        df = df.select(*[F.col(f"`{c}`") for c in source.columns])
    return df


def read_db_with_mappings(spark: SparkSession, source: DatabaseSource):
    """(frame, automatic pass-through mappings) for a migration."""
    df = read_db(spark, source)
    return df, auto_mappings(df)


def schema_preview(spark: SparkSession, source: DatabaseSource) -> DataFrame:
    """column_name, source_dtype, suggested_target_dtype; reads no rows
    (Spark resolves a JDBC schema with a query that returns none)."""
    df = read_db(spark, source)
    rows = [(m.column_name, m.source_dtype, m.target_dtype) for m in auto_mappings(df)]
    return spark.createDataFrame(rows, "column_name string, source_dtype string, suggested_target_dtype string")


def list_tables(spark: SparkSession, conn: DatabaseConnection) -> DataFrame:
    df = jdbc_reader(spark, conn).option("query", TABLE_LIST_SQL[conn.dialect]).load()
    return df.select(F.col(df.columns[0]).alias("table_name"))


def _fold(name: str, dialect: str) -> str:
    # Derby stores unquoted identifiers in upper case
    return name.upper() if dialect == "derby" else name


def table_exists(spark: SparkSession, conn: DatabaseConnection, table_name: str) -> bool:
    names = list_tables(spark, conn).filter(
        F.upper(F.col("table_name")) == _fold(table_name, conn.dialect).upper()
    )
    return bool(names.limit(1).count())


def _connect(spark: SparkSession, conn: DatabaseConnection):
    jvm = spark._jvm
    props = jvm.java.util.Properties()
    for k, v in conn.options().items():
        if k not in ("url", "driver"):
            props.setProperty(k, str(v))
    if conn.driver:
        jvm.java.lang.Class.forName(conn.driver)
    return jvm.java.sql.DriverManager.getConnection(conn.url, props)


def describe_table(spark: SparkSession, conn: DatabaseConnection, table_name: str) -> list[dict]:
    """Columns of a table from the driver's catalogue metadata: name, type,
    nullable, default, primary_key.  Metadata only; no rows are read."""
    jconn = _connect(spark, conn)
    try:
        meta = jconn.getMetaData()
        name = _fold(table_name, conn.dialect)
        keys = set()
        rs = meta.getPrimaryKeys(None, None, name)
        while rs.next():
            keys.add(rs.getString("COLUMN_NAME"))
        rs.close()
        cols = []
        rs = meta.getColumns(None, None, name, None)
        while rs.next():
            col = rs.getString("COLUMN_NAME")
            cols.append(
                {
                    "name": col,
                    "type": rs.getString("TYPE_NAME"),
                    "nullable": rs.getInt("NULLABLE") != 0,
                    "default": rs.getString("COLUMN_DEF"),
                    "primary_key": col in keys,
                }
            )
        rs.close()
        return cols
    finally:
        jconn.close()


#: Tables that one statement counts.
COUNTED_TOGETHER = 100


def count_queries(tables: list[str]) -> list[str]:
    """Statements that give (table_name, n) of all tables, many at a time."""
    one = ["SELECT {} AS table_name, COUNT(*) AS n FROM {}".format(sql_value(t), t) for t in tables]
    return [" UNION ALL ".join(one[k:k + COUNTED_TOGETHER]) for k in range(0, len(one), COUNTED_TOGETHER)]


def table_counts(spark: SparkSession, conn: DatabaseConnection, tables: list[str]) -> DataFrame:
    """(table_name, n), counted inside the database; the statements run in parallel, one in a task."""
    parts = [jdbc_reader(spark, conn).option("query", q).load().toDF("table_name", "n") for q in count_queries(tables)]
    if not parts:
        return spark.createDataFrame([], "table_name string, n long")
    return reduce(lambda a, b: a.unionByName(b), parts)


def summarize(spark: SparkSession, conn: DatabaseConnection, preview_rows: int = 5) -> list[dict]:
    """Per table: name, row count, columns (name, type, nullable, default,
    primary key) and the first rows.  All counts come from a few statements
    that the database runs; column facts come from catalogue metadata."""
    tables = [r["table_name"] for r in list_tables(spark, conn).collect()]
    counts = {r["table_name"].rstrip(): int(r["n"]) for r in table_counts(spark, conn, tables).collect()}
    out = []
    for name in tables:
        info = {
            "table_name": name,
            "row_count": counts[name.rstrip()],
            "columns": describe_table(spark, conn, name),
        }
        if preview_rows:
            df = read_db(spark, DatabaseSource(connection=conn, table_name=name))
            info["preview"] = [r.asDict() for r in df.limit(preview_rows).collect()]
        out.append(info)
    return out


def execute(spark: SparkSession, conn: DatabaseConnection, statements) -> None:
    """Run DDL/DML statements in one database transaction from the driver
    (staging swaps, index creation).  Data never passes through here."""
    jconn = _connect(spark, conn)
    try:
        jconn.setAutoCommit(False)
        stmt = jconn.createStatement()
        try:
            for sql in statements:
                stmt.execute(sql)
            jconn.commit()
        except Exception:
            jconn.rollback()
            raise
        finally:
            stmt.close()
    finally:
        jconn.close()
