"""Records out of JSON payloads: drill by a dotted key, one row per record.

The key path is a JSONPath handed to ``get_json_object``; the record array
is parsed as ``array<map<string,variant>>`` and exploded, all JVM-side, so
values keep their JSON types: the text "007" stays text.  The record fields
become columns; their names and types come from one aggregate grouped by
field name, whose result has one row per distinct field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_path(records_key: str | None) -> str:
    if not records_key:
        return "$"
    return "$" + "".join(f"['{part}']" for part in records_key.split("."))


_ROWS = "\u0000records"  # marker entry: one per record, counts the records

#: Distinct field names that are taken for columns.  Records that are keyed by
#: ids have no columns; name the fields wanted instead.
MAX_FIELDS = 10_000


def _json_kind(value: Column) -> Column:
    """One code per value: n(ull) i(nteger) f(loat) b(oolean) s(tring or nested)."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return (F.when(value.isNull() | F.is_variant_null(value), "n").when(kind == "BIGINT", "i")
            .when(kind.isin("DOUBLE", "FLOAT", "DECIMAL"), "f").when(kind == "BOOLEAN", "b").otherwise("s"))


def _column_type(kinds: set[str]) -> str:
    """Column type from the kinds of its values; a missing integer or an all-missing column reads as double."""
    values = kinds - {"n"}
    if values == {"i"}:
        return "bigint" if "n" not in kinds else "double"
    if values <= {"i", "f"}:
        return "double"
    return "boolean" if kinds == {"b"} else "string"


def drill(pages: DataFrame, body_col: str, records_key: str | None, infer_types: bool = True,
          fields: list[str] | None = None) -> DataFrame:
    """Explode the records under ``records_key`` of every JSON body.

    Field names and their types come from one aggregate over the record
    entries (grouped by field name, partially aggregated per task); the
    rows themselves are produced by one more pass.  Nested values come as
    their JSON text.
    """
    raw = F.get_json_object(F.col(body_col), json_path(records_key))
    recs = pages.select(F.explode(F.from_json(raw, "array<map<string,variant>>")).alias("rec"))
    types: dict[str, str] = {}
    if fields is None or infer_types:
        marker = F.create_map(F.lit(_ROWS), F.parse_json(F.lit("1")))
        entries = recs.select(F.explode(F.map_concat("rec", marker)).alias("field", "value"))
        if fields is not None:
            entries = entries.filter(F.col("field").isin(*fields, _ROWS))
        stats = entries.select("field", _json_kind(F.col("value")).alias("k")).groupBy("field").agg(
            F.count(F.lit(1)).alias("rows"), F.collect_set("k").alias("kinds")
        ).limit(MAX_FIELDS + 2).collect()  # one row per distinct field name; at most five kinds each
        if len(stats) > MAX_FIELDS + 1:
            raise ValueError(f"records have over {MAX_FIELDS} distinct fields: name the fields to read")
        total = next((r["rows"] for r in stats if r["field"] == _ROWS), 0)
        found = sorted(r["field"] for r in stats if r["field"] != _ROWS)
        fields = fields if fields is not None else found
        types = {r["field"]: _column_type({*r["kinds"], *("n" if r["rows"] < total else "")}) for r in stats}

    def cell(name: str) -> Column:
        target = types.get(name, "double") if infer_types else "string"
        return F.try_variant_get(F.col("rec")[name], "$", target).alias(name)

    return recs.select(*[cell(f) for f in fields])
