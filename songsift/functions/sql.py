"""The list parsers as functions of Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The same expressions as parse_list and parse_floats, in SQL text.
_PARSE_LIST = r"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS ARRAY<STRING> RETURN
coalesce(
  from_json(
    CASE WHEN contains(text, r'\x')
      THEN regexp_replace(text, r'(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{{2}})', r'$1\\u00$2')
      ELSE text END,
    'array<string>',
    map('allowBackslashEscapingAnyCharacter', 'true')),
  filter(
    transform(split(trim(btrim(trim(text), '[]')), ','), item -> btrim(item, r" '" || '"')),
    item -> item <> ''))
"""

_PARSE_FLOATS = r"""
CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS ARRAY<DOUBLE> RETURN
filter(
  transform(split(trim(translate(replace(text, '...', ' '), '[],', '   ')), r'\s+'),
    item -> try_cast(item AS DOUBLE)),
  item -> item IS NOT NULL)
"""


def register_functions(
    spark: SparkSession, parse_list: str = "parseStringList", parse_floats: str = "parseFloatList"
) -> None:
    """Make both parsers known to SQL queries of this session, without Python code."""
    spark.sql(_PARSE_LIST.format(name=parse_list))
    spark.sql(_PARSE_FLOATS.format(name=parse_floats))
