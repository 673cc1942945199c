"""Boilerplate lines by their frequency relative to the site.

A line of a host is boilerplate when the share of the host's pages that hold it exceeds a ratio.
Pages are counted as different texts: copies of a page are one page, so that a page which was
crawled often does not turn its own content into boilerplate. Lines are compared lower-cased, with
white space at the ends cut and inner white space as one space, by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.base import ROW, numbered, or_empty, query, stored, table

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.02
#: Fewer different pages than this never make a line boilerplate: shares of small hosts mean little.
MIN_PAGES = 5
#: Pieces that a line of a host is spread over while its pages are looked up.
SALTS = 32


def plain_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_keys(text: Column) -> Column:
    """A hash per line; NULL for lines without a word."""
    plain = F.transform(F.split(text, "\n", -1), plain_line)
    return F.transform(plain, lambda x: F.when(x != "", F.xxhash64(x)))


def page_lines(pages: DataFrame) -> DataFrame:
    """``_row``, ``host``, ``_page`` (the text's hash), ``_lines`` (the line keys in order)."""
    return pages.select(ROW, "host", F.xxhash64("text").alias("_page"), line_keys(or_empty("text")).alias("_lines"))


def boilerplate_lines(lines: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """``host``, ``_line``, ``n_pages``, ``host_pages`` of the lines above the ratio."""
    pages = lines.groupBy("host", "_page").agg(F.first("_lines").alias("_lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    held = pages.select("host", F.explode(F.array_compact(F.array_distinct("_lines"))).alias("_line"))
    counts = held.groupBy("host", "_line").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    above = F.col("n_pages") > ratio * F.col("host_pages")
    return counts.join(totals, "host").filter(above)


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows of ``docs`` without boilerplate lines, ``n_lines`` and ``n_dropped`` added.

    Lines without a word are never dropped and not counted. A NULL text stays NULL and has no
    lines; a NULL host is a host of its own. Repeated rows are one page and are cleaned alike.
    A page of boilerplate only becomes an empty text. ``n_chars``, where ``docs`` has it, is
    the length of the new text. Lines are removed with their line break.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = numbered(docs.select(kept), "line-rows")
    lines = stored(page_lines(rows.select(ROW, F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit("")).alias("host"), "text")), "line-keys")
    common = boilerplate_lines(lines, ratio, min_pages).select("host", "_line")
    salted = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = (
        lines.select(ROW, "host", F.explode(F.array_compact(F.array_distinct("_lines"))).alias("_line"))
        .withColumn("_salt", F.pmod(F.col(ROW), F.lit(SALTS)).cast("int"))
        .join(salted, ["host", "_line", "_salt"])
        .groupBy(ROW)
        .agg(F.collect_set("_line").alias("_common"))  # at most the lines of the one page
    )
    parts = F.split("text", "\n", -1)
    keys = line_keys(F.col("text"))
    # No hit: the text as it was, without taking it apart.
    left = F.filter(F.zip_with(parts, keys, lambda p, k: F.when(k.isNull() | ~F.array_contains("_common", F.coalesce(k, F.lit(0))), p)), lambda p: p.isNotNull())
    out = (
        rows.join(hits, ROW, "left")
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(keys, lambda k: k.isNotNull()))).cast("bigint"))
        .withColumn("n_dropped", F.when(F.col("_common").isNull(), 0).otherwise(F.size(F.filter(keys, lambda k: F.array_contains("_common", F.coalesce(k, F.lit(0))) & k.isNotNull()))).cast("bigint"))
        .withColumn("text", F.when(F.col("_common").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    )
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*kept, "n_lines", "n_dropped")


_PLAIN = r"trim(regexp_replace(lower({0}), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"
_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
lines AS (
  SELECT r, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
plain AS (SELECT *, {_PLAIN.format('line')} AS p FROM lines),
totals AS (SELECT source, count(DISTINCT coalesce(text, '') || CASE WHEN text IS NULL THEN 'null' ELSE 'text' END) AS host_pages FROM docs GROUP BY 1),
common AS (
  SELECT source, p FROM (SELECT source, p, count(DISTINCT text) AS n FROM plain WHERE p <> '' GROUP BY 1, 2) JOIN totals USING (source)
  WHERE n >= {MIN_PAGES} AND n > {RATIO} * host_pages),
marked AS (SELECT plain.*, common.p IS NOT NULL AS dropped FROM plain LEFT JOIN common ON plain.source = common.source AND plain.p = common.p),
cleaned AS (
  SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS kept, count(*) FILTER (p <> '') AS n_lines, count(*) FILTER (dropped) AS n_dropped
  FROM marked GROUP BY r)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped
FROM docs LEFT JOIN cleaned USING (r)"""


@query("op6_line_dedup", _SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that their source repeats."""
    return drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
