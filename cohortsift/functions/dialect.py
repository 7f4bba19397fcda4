"""Functions that step files may call and Spark does not have, as Spark SQL functions of the session.

Each is a ``CREATE TEMPORARY FUNCTION ... RETURN`` over built-in functions: Spark puts its body in
place of the call, so filters with it run without Python and in whole-stage code. A name that the
session knows already, be it the user's, stays as it is. Lists are of text; other items are read as text.

Defined results: NULL in, NULL out. ``strftime`` knows the parts below and refuses others.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Parts of a time, as strftime and as Spark write them.
_PARTS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%j": "DDD", "%p": "a", "%a": "E", "%A": "EEEE", "%b": "MMM", "%B": "MMMM",
}


def _time_format() -> str:
    """The SQL that turns a strftime format into Spark's: plain letters quoted, parts replaced."""
    text = r"""regexp_replace(replace(format, "'", "''"), r"(?<!%)([A-Za-z]+)", "'$1'")"""
    for part, sign in _PARTS.items():
        text = f"replace({text}, '{part}', '{sign}')"
    return f"if(contains({text}, '%'), raise_error('strftime: unknown part in ' || format), {text})"


#: Name, parameters, result and body of each function.
FUNCTIONS = (
    ("strftime", "at TIMESTAMP_NTZ, format STRING", "STRING", f"date_format(at, {_time_format()})"),
    ("regexp_matches", "text STRING, pattern STRING", "BOOLEAN", "text RLIKE pattern"),
    ("regexp_full_match", "text STRING, pattern STRING", "BOOLEAN", "text RLIKE ('^(?:' || pattern || r')\\z')"),
    ("list_contains", "list ARRAY<STRING>, item STRING", "BOOLEAN", "exists(list, x -> x <=> item) AND item IS NOT NULL"),
    ("list_has_any", "list ARRAY<STRING>, items ARRAY<STRING>", "BOOLEAN", "exists(list, x -> coalesce(array_contains(items, x), false))"),
    ("list_position", "list ARRAY<STRING>, item STRING", "INT", "nullif(array_position(list, item), 0)"),
    ("string_split", "text STRING, sep STRING", "ARRAY<STRING>", r"split(text, if(sep = '', '', r'\Q' || sep || r'\E'))"),
    ("prefix", "text STRING, start STRING", "BOOLEAN", "startswith(text, start)"),
    ("suffix", "text STRING, ending STRING", "BOOLEAN", "endswith(text, ending)"),
    ("strpos", "text STRING, part STRING", "INT", "instr(text, part)"),
    ("parse_filename", "path STRING", "STRING", "regexp_extract(path, r'([^/]*)$', 1)"),
)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, once."""
    for name, parameters, result, body in FUNCTIONS:
        if not spark.catalog.functionExists(name):
            spark.sql(f"CREATE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
