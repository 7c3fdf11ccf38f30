"""Tables as the text operators want them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.core.runtime import current, spread, table


def doc_pages(spark, sf_dir) -> DataFrame:
    """`page, path, text, title, url, revision`: each page once; its path with its id, as sites share paths."""
    rows = current(spread(table(spark, sf_dir, "pages", "page_id", "path", "text", "title", "url", "revision", "loaded_at")), "page_id", "loaded_at")
    return rows.select(F.concat_ws("#", "path", "page_id").alias("page"), "path", F.coalesce("text", F.lit("")).alias("text"), "title", "url", "revision")


PAGES = "pg AS (SELECT concat_ws('#', path, page_id) AS page, path, coalesce(text, '') AS text, title, url, revision FROM pages QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY loaded_at DESC) = 1)"


def block() -> str:
    """The block mask without back-references: one alternative for each length of a fence."""
    fence = "|".join(f"^[ \\t]*{c}{{{n}}}[^\\n]*\\n.*?^[ \\t]*{c}{{{n}}}[ \\t]*$" for c in "`~" for n in range(8, 2, -1))
    return f"(?ms)\\A---\\n.*?\\n---\\n|{fence}"


BODY = """body AS (SELECT page, path, regexp_replace(text, '(?s)\\A---\\n.*?\\n---\\n', '') AS body,
         length(regexp_extract(text, '(?s)\\A---\\n.*?\\n---\\n')) - length(replace(regexp_extract(text, '(?s)\\A---\\n.*?\\n---\\n'), chr(10), '')) AS off FROM pg)"""


def masked(column: str) -> str:
    cut, kept = f"regexp_split_to_array({column}, '{block()}')", f"regexp_extract_all({column}, '{block()}')"
    return f"array_to_string(list_transform(list_zip({cut}, {kept}), lambda x: coalesce(x[1], '') || regexp_replace(coalesce(x[2], ''), '[^\\n]', '', 'g')), '')"


LINES = f"""{PAGES}, {BODY}, bl AS (SELECT *, {masked('body')} AS blank FROM body),
ln AS (SELECT page, path, CAST(generate_subscripts(string_split(blank, chr(10)), 1) + off AS INT) AS line, unnest(string_split(blank, chr(10))) AS text, unnest(string_split(body, chr(10))) AS raw FROM bl)"""


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]" if value else "CAST([] AS VARCHAR[])"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)})"
