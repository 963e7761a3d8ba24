"""Fixed values.

Every table in this module must hold the values listed here for results to
match the behaviour being reproduced (token lists, format names, patterns).
They are stated plainly and in their natural order; nothing else lives here.
"""

from __future__ import annotations

# --- fixed values: target data types of a column mapping -------------------
DATA_TYPES = (
    "integer",
    "bigint",
    "float",
    "decimal",
    "string",
    "text",
    "boolean",
    "date",
    "datetime",
    "timestamp",
    "json",
)

# --- fixed values: named date formats and their Spark parse patterns -------
# Single-letter M / d accept one or two digits, like strptime's %m / %d.
DATE_FORMATS = {
    "YYYY-MM-DD": "yyyy-M-d",
    "YY-MM-DD": "yy-M-d",
    "DD-MM-YYYY": "d-M-yyyy",
    "DD-MM-YY": "d-M-yy",
    "YYYY/MM/DD": "yyyy/M/d",
    "YY/MM/DD": "yy/M/d",
    "DD/MM/YYYY": "d/M/yyyy",
    "DD/MM/YY": "d/M/yy",
    "MMM DD, YYYY": "MMM d, yyyy",
    "MMMM DD, YYYY": "MMMM d, yyyy",
}
DEFAULT_DATE_FORMAT = "YYYY-MM-DD"

# --- fixed values: named datetime formats and their Spark parse patterns ---
DATETIME_FORMATS = {
    "YYYY-MM-DD HH:MM:SS": "yyyy-M-d H:m:s",
    "DD-MM-YYYY HH:MM:SS": "d-M-yyyy H:m:s",
    "MM-DD-YYYY HH:MM:SS": "M-d-yyyy H:m:s",
    "YYYY-MM-DDTHH:MM:SS": "yyyy-M-d'T'H:m:s",
    "ISO8601": "yyyy-M-d'T'H:m:s'Z'",
}
DEFAULT_DATETIME_FORMAT = "YYYY-MM-DD HH:MM:SS"

# Two-digit years follow the strptime convention: 69-99 -> 1900s, 00-68 -> 2000s.
TWO_DIGIT_YEAR_PIVOT = 2069

# --- fixed values: boolean text tokens of the boolean cast -----------------
TRUE_TOKENS = ("true", "t", "yes", "y", "1")
FALSE_TOKENS = ("false", "f", "no", "n", "0")

# --- fixed values: boolean-like test of the type suggester -----------------
BOOLEAN_LIKE_TOKENS = ("true", "false", "1", "0", "yes", "no")

# --- fixed values: filter operators ----------------------------------------
FILTER_OPERATORS = (
    "eq",
    "neq",
    "gt",
    "lt",
    "gte",
    "lte",
    "contains",
    "not_contains",
    "is_null",
    "is_not_null",
    "in",
    "not_in",
)

# --- fixed values: validation rule types -----------------------------------
VALIDATION_RULES = (
    "not_null",
    "unique",
    "min_value",
    "max_value",
    "min_length",
    "max_length",
    "regex",
    "allowed_values",
    "date_format",
    "numeric",
    "email",
)

# --- fixed values: e-mail pattern of the email rule ------------------------
EMAIL_PATTERN = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"

# --- fixed values: aggregation function names ------------------------------
# The first six are the documented set; the rest are accepted names too.
AGG_FUNCTIONS = (
    "sum",
    "count",
    "avg",
    "min",
    "max",
    "count_distinct",
    "mean",
    "median",
    "std",
    "var",
    "first",
    "last",
    "nunique",
    "size",
    "prod",
)

# --- fixed values: CSV text read as missing (pandas' default NA tokens) ----
CSV_NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# --- fixed values: CSV text inferred as boolean ----------------------------
CSV_TRUE_TOKENS = ("True", "TRUE", "true")
CSV_FALSE_TOKENS = ("False", "FALSE", "false")

# --- fixed values: date formats tried by the type suggester, in order ------
SUGGEST_DATE_FORMATS = (
    "%Y-%m-%d",
    "%d-%m-%Y",
    "%m-%d-%Y",
    "%Y/%m/%d",
    "%d/%m/%Y",
    "%m/%d/%Y",
    "%d.%m.%Y",
    "%Y.%m.%d",
    "%b %d, %Y",
    "%B %d, %Y",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S",
)

# --- fixed values: file extensions accepted by the scanner -----------------
ALLOWED_EXTENSIONS = (".csv", ".xls", ".xlsx", ".parquet")

# --- fixed values: integer range of the "integer" suggestion ---------------
INT32_MAX = 2_147_483_647

# --- fixed values: string length above which "text" is suggested ----------
TEXT_LENGTH_LIMIT = 255

# --- fixed values: load defaults and limits ---------------------------------
DEFAULT_BATCH_SIZE = 10_000
MAX_BATCH_SIZE = 100_000
DEFAULT_API_BATCH_SIZE = 100
MAX_API_BATCH_SIZE = 10_000
DEFAULT_MAX_RETRIES = 3
MAX_RETRIES_LIMIT = 10
LEDGER_TTL_HOURS = 24

# --- fixed values: SQL column types per dialect for table DDL --------------
SQL_TYPES = {
    "postgresql": {
        "integer": "INTEGER",
        "bigint": "BIGINT",
        "float": "DOUBLE PRECISION",
        "decimal": "NUMERIC(18,2)",
        "string": "VARCHAR(255)",
        "text": "TEXT",
        "boolean": "BOOLEAN",
        "date": "DATE",
        "datetime": "TIMESTAMP",
        "timestamp": "TIMESTAMPTZ",
        "json": "JSONB",
    },
    "mysql": {
        "integer": "INT",
        "bigint": "BIGINT",
        "float": "DOUBLE",
        "decimal": "DECIMAL(18,2)",
        "string": "VARCHAR(255)",
        "text": "TEXT",
        "boolean": "TINYINT(1)",
        "date": "DATE",
        "datetime": "DATETIME",
        "timestamp": "TIMESTAMP",
        "json": "JSON",
    },
    "sqlite": {
        "integer": "INTEGER",
        "bigint": "INTEGER",
        "float": "REAL",
        "decimal": "REAL",
        "string": "TEXT",
        "text": "TEXT",
        "boolean": "INTEGER",
        "date": "TEXT",
        "datetime": "TEXT",
        "timestamp": "TEXT",
        "json": "TEXT",
    },
    # Embedded Derby, used for tests: the only JDBC driver shipped with Spark.
    "derby": {
        "integer": "INTEGER",
        "bigint": "BIGINT",
        "float": "DOUBLE",
        "decimal": "DECIMAL(18,2)",
        "string": "VARCHAR(255)",
        "text": "CLOB",
        "boolean": "BOOLEAN",
        "date": "DATE",
        "datetime": "TIMESTAMP",
        "timestamp": "TIMESTAMP",
        "json": "CLOB",
    },
}
