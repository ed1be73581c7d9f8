"""SQL text of other engines, made readable for Spark, and the row hash.

Only what the dialects name differently is renamed, outside of quoted text; the rest
is standard SQL that Spark parses itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions by their names elsewhere.
RENAMES = {
    "duckdb": {"list_value": "array", "strftime": "date_format", "arg_max": "max_by", "arg_min": "min_by", "list_contains": "array_contains", "list_aggregate": "aggregate", "epoch": "unix_timestamp", "json_extract_string": "get_json_object", "string_split": "split"},
    "datafusion": {"make_array": "array", "strpos": "instr", "to_timestamp_seconds": "timestamp_seconds", "unnest": "explode", "character_length": "length", "array_length": "size", "now": "current_timestamp"},
    "spark": {},
}
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*|.", re.S)
_CAST = re.compile(r"arrow_cast\(\s*((?:[^(),']|\([^()]*\))+?)\s*,\s*'(\w+)[^']*'\s*\)", re.I)
#: Arrow's type names.
ARROW_TYPES = {"Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint", "Float32": "float", "Float64": "double", "Utf8": "string", "LargeUtf8": "string", "Boolean": "boolean", "Date32": "date", "Date64": "date", "Timestamp": "timestamp", "Binary": "binary"}


def translate(text: str, dialect: str = "spark") -> str:
    """Spark SQL for a text of ``duckdb``, ``datafusion`` or ``spark``."""
    if dialect not in RENAMES:
        raise ValueError(f"unknown dialect {dialect!r}; known: {', '.join(sorted(RENAMES))}")
    if dialect == "spark":
        return text
    names = RENAMES[dialect]
    text = _CAST.sub(lambda m: f"CAST({m[1]} AS {ARROW_TYPES.get(m[2], m[2])})", text)
    tokens = _TOKEN.findall(text)
    out = []
    for i, token in enumerate(tokens):
        called = next((t for t in tokens[i + 1 :] if not t.isspace()), "") == "("
        if token.startswith('"'):
            token = "`" + token[1:-1].replace('""', '"').replace("`", "``") + "`"
        elif called and token.lower() in names:
            token = names[token.lower()]
        out.append(token)
    return "".join(out)


def row_hash(columns: Iterable[str | Column]) -> Column:
    """SHA-256 of the values as text joined by byte 1; a null is the word NULL between zero bytes."""
    values = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000NULL\u0000")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *values), 256)
