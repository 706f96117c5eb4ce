"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import BLANKS

# The blank characters as an SQL expression.
BLANKS_SQL = "||".join(f"chr({ord(c)})" for c in BLANKS)


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Named measures rounded to six digits, everything else unchanged."""
    for name in names:
        df = df.withColumn(name, r6(name))
    return df


def cut_sql(column: str, n: int) -> str:
    """Comment truncation as SQL."""
    text = f"coalesce({column},'nan')"
    return (
        f"case when length({text}) <= {n} then {text} "
        f"else rtrim(substr({text},1,{n}), {BLANKS_SQL}) end"
    )


# Places of comments in their threads, for the view ``threads``: paths of ids from the start, in order.
THREAD_PLACES = {
    "paths": """select * from (with recursive walk as (
  select conv_id, message_id, coalesce('1' || reply_to, '0') || '/' || message_id as path from threads t
  where reply_to is null or not exists (
    select 1 from threads p where p.conv_id = t.conv_id and p.message_id = t.reply_to)
  union all
  select t.conv_id, t.message_id, w.path || '/' || t.message_id
  from threads t join walk w on t.conv_id = w.conv_id and t.reply_to = w.message_id
) select * from walk)""",
    "places": """select conv_id, message_id, row_number() over (partition by conv_id order by path) as place from paths""",
}
