"""Job requests in a JSON request shape: one dictionary names source, stages and destinations.

``job_from_request`` turns such a request (``file_id`` or ``db_source`` or
``api_source``; ``column_mappings``, ``filters``, ``aggregations``,
``validation_rules``; ``db_destination`` / ``file_destination`` /
``api_destination``; ``batch_size``, ``max_retries``) into a ``JobSpec``.
Database connections given as host / port / database / user become JDBC
URLs.  Authentication objects are not translated: pass ready headers.
"""

from __future__ import annotations

import os

from ..specs import (
    ApiDestination,
    ApiSource,
    DatabaseConnection,
    DatabaseDestination,
    DatabaseSource,
    FileDestination,
    FileSource,
    JobSpec,
    SpecError,
)

# --- fixed values: default ports and JDBC URL forms per database type ------
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306}
JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "sqlite": "jdbc:sqlite:{database}",
}
JDBC_DRIVERS = {
    "postgresql": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "sqlite": "org.sqlite.JDBC",
}


def connection_from_request(conn: dict) -> DatabaseConnection:
    if "url" in conn:
        return DatabaseConnection(**conn)
    kind = conn["db_type"]
    if kind not in JDBC_URLS:
        raise SpecError(f"Unsupported database type: {kind}")
    url = JDBC_URLS[kind].format(
        host=conn.get("host", "localhost"),
        port=conn.get("port") or DEFAULT_PORTS.get(kind, ""),
        database=conn["database"],
    )
    return DatabaseConnection(
        url=url,
        dialect=kind,
        user=conn.get("username"),
        password=conn.get("password"),
        driver=JDBC_DRIVERS[kind],
    )


def _db_source(src: dict) -> DatabaseSource:
    return DatabaseSource(
        connection=connection_from_request(src["connection"]),
        table_name=src.get("table_name"),
        query=src.get("query"),
        columns=src.get("columns"),
        # rows per round trip
        fetch_size=src.get("chunk_size") or None,
        partition_column=src.get("partition_column"),
        num_partitions=src.get("num_partitions"),
    )


def _db_destination(dest: dict) -> DatabaseDestination:
    return DatabaseDestination(
        connection=connection_from_request(dest["connection"]),
        table_name=dest["table_name"],
        if_exists=dest.get("if_exists", "fail"),
        create_index=dest.get("create_index", False),
        index_columns=dest.get("index_columns"),
    )


def _api_source(src: dict) -> ApiSource:
    keys = ("url", "records_key", "headers", "page_param", "page_size_param", "page_size", "start_page",
            "max_pages", "next_url_key")
    return ApiSource(**{k: src[k] for k in keys if k in src})


def _api_destination(dest: dict) -> ApiDestination:
    keys = ("url", "method", "batch_size", "records_key", "headers")
    return ApiDestination(**{k: dest[k] for k in keys if k in dest})


def job_from_request(req: dict, upload_dir: str = ".", order_by: str | None = None) -> JobSpec:
    """A JobSpec from a request dictionary; ``file_id`` names a file in
    ``upload_dir``."""
    fields: dict = {
        "column_mappings": req.get("column_mappings") or (),
        "filters": req.get("filters") or (),
        "validation_rules": req.get("validation_rules") or (),
        "aggregations": req.get("aggregations"),
        "batch_size": req.get("batch_size", 10_000),
        "max_retries": req.get("max_retries", 3),
        "order_by": order_by,
    }
    if req.get("file_id"):
        fields["file_source"] = FileSource(path=os.path.join(upload_dir, req["file_id"]))
    if req.get("db_source"):
        fields["db_source"] = _db_source(req["db_source"])
    if req.get("source"):  # a migration request names its source "source"
        fields["db_source"] = _db_source(req["source"])
    if req.get("api_source"):
        fields["api_source"] = _api_source(req["api_source"])
    if req.get("db_destination"):
        fields["db_destination"] = _db_destination(req["db_destination"])
    if req.get("file_destination"):
        fields["file_destination"] = FileDestination(**req["file_destination"])
    if req.get("api_destination"):
        fields["api_destination"] = _api_destination(req["api_destination"])
    return JobSpec(**fields)
