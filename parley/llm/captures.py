"""Web archive captures derived from the table of pages, as a DataFrame and as SQL.

Each page gives a full response, a revisit under a spelling of its own of the
URL, and for some pages a revisit before any response, a second response, and
revisits with changed, dated or no validators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def captures(pages: DataFrame) -> DataFrame:
    """record_id, url, ts, kind, headers."""
    rows = pages.selectExpr(
        "page_id as p", "url", "page_id * 1000 as t",
        """'"' || left(md5(html), 16) || '"' as tag""", "'day ' || (page_id % 28) as day",
    )
    text = "map_filter(map({}), (k, v) -> v is not null)"
    parts = [
        ("p % 5 = 0", 0, "url", "t - 5", "revisit", "'ETag', tag"),
        ("true", 1, "url", "t", "response",
         "'Content-Type', 'text/html', 'ETag', if(p % 4 = 3, null, tag), 'Last-Modified', day, "
         "'Cache-Control', 'max-age=60', 'Date', 'at ' || t"),
        ("true", 2, "url || '#again'", "t + 100", "revisit",
         """'etag', if(p % 7 = 0, '"other"', 'W/' || tag), 'date', 'at ' || (t + 100), """
         "'cache-control', 'max-age=600', 'content-type', 'text/plain'"),
        ("p % 3 = 0", 3, "url", "t + 200", "response",
         """'content-type', 'text/xml', 'Etag', '"v2 ' || p || '"', 'Date', 'at ' || (t + 200)"""),
        ("true", 4, "url", "t + 300", "revisit",
         """'ETag', if(p % 6 = 0, '"v2 ' || p || '"', null), 'Last-Modified', if(p % 2 = 1, day, null), 'Expires', 'at ' || (t + 900)"""),
    ]
    structs = [
        f"if({when}, named_struct('record_id', p * 10 + {n}, 'url', {url}, 'ts', {ts}, 'kind', '{kind}', "
        f"'headers', {text.format(headers)}), null)"
        for when, n, url, ts, kind, headers in parts
    ]
    made = F.expr(f"explode(filter(array({', '.join(structs)}), x -> x is not null))")
    return rows.select(made.alias("c")).select("c.*")


CAPTURES_SQL = """
  base as (
    select page_id p, url, page_id * 1000 t, '"' || left(md5(html), 16) || '"' tag, 'day ' || (page_id % 28) as day from pages
  ), captures as (
    select p * 10 as record_id, url, t - 5 as ts, 'revisit' as kind, null as ctype, tag as etag, null as modified,
      null as cache, null as date, null as expires from base where p % 5 = 0
    union all select p * 10 + 1, url, t, 'response', 'text/html', case when p % 4 = 3 then null else tag end, day,
      'max-age=60', 'at ' || t, null from base
    union all select p * 10 + 2, url || '#again', t + 100, 'revisit', 'text/plain',
      case when p % 7 = 0 then '"other"' else 'W/' || tag end, null, 'max-age=600', 'at ' || (t + 100), null from base
    union all select p * 10 + 3, url, t + 200, 'response', 'text/xml', '"v2 ' || p || '"', null, null,
      'at ' || (t + 200), null from base where p % 3 = 0
    union all select p * 10 + 4, url, t + 300, 'revisit', null, case when p % 6 = 0 then '"v2 ' || p || '"' end,
      case when p % 2 = 1 then day end, null, null, 'at ' || (t + 900) from base
  )"""
