"""SQL registration of the scalar and table functions.

They are SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN <expression>``): Catalyst inlines
the body into the calling plan, so SQL users get the same code-generated expressions as the
DataFrame API, with no Python at run time.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# The body is one generator over the argument (no sub-query), so the function also works as a
# lateral table function over a column: ``FROM t, LATERAL name_rows(t.full_name)``.
_TOKENS = r"split(regexp_replace(full_name, '\\s+$', ''), '\\s+')"
_NAME_ROWS = f"""
        CREATE OR REPLACE TEMPORARY FUNCTION name_rows(full_name STRING)
        RETURNS TABLE (name STRING, surname STRING)
        RETURN SELECT inline(CASE
            WHEN full_name IS NULL OR full_name = '' THEN array()
            WHEN size({_TOKENS}) = 2
              THEN array(named_struct('name', {_TOKENS}[0], 'surname', {_TOKENS}[1]))
            WHEN size({_TOKENS}) = 4 AND {_TOKENS}[1] = 'and'
              THEN array(named_struct('name', {_TOKENS}[0], 'surname', {_TOKENS}[3]),
                         named_struct('name', {_TOKENS}[2], 'surname', {_TOKENS}[3]))
            ELSE array() END)"""

FUNCTIONS = {
    "greeting": """
        CREATE OR REPLACE TEMPORARY FUNCTION greeting(x STRING) RETURNS STRING
        RETURN concat('Hello ', x)""",
    "array_contains_strict": """
        CREATE OR REPLACE TEMPORARY FUNCTION array_contains_strict(arr ARRAY<STRING>, x STRING) RETURNS BOOLEAN
        RETURN CASE WHEN arr IS NULL OR x IS NULL THEN CAST(NULL AS BOOLEAN)
                    ELSE exists(arr, e -> e <=> x) END""",
    "total_score": """
        CREATE OR REPLACE TEMPORARY FUNCTION total_score(name STRING, score_list ARRAY<MAP<STRING, INT>>)
        RETURNS STRUCT<name: STRING, totalScore: BIGINT>
        RETURN named_struct('name', name, 'totalScore', coalesce(
            aggregate(score_list, 0L, (acc, m) -> acc + coalesce(
                aggregate(map_values(m), 0L, (a, v) -> a + coalesce(CAST(v AS BIGINT), 0L)), 0L)), 0L))""",
    "name_rows": _NAME_ROWS,
}


def register_functions(spark: SparkSession) -> list[str]:
    """Register every function in the current session; returns their names."""
    for ddl in FUNCTIONS.values():
        spark.sql(ddl)
    return list(FUNCTIONS)
