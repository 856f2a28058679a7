"""Line dedup by site-relative frequency: drop lines found on more than a share of their site's pages.

Lines are counted once per page, by 64-bit hash, with map-side sums; a common line costs one row per task. Of each
site only the lines above the ratio are gathered: as every such line is on more than ``ratio`` of the pages, a site has
at most (mean distinct lines per page) / ratio of them, however many pages it has. Pages then meet the one row of
their site; a site with a third of all pages is split by adaptive execution, as this is a left join. Only built-in
functions are used.

A page without a site keeps its lines; null and empty texts have none. Lines are compared without white space at their
ends; blank lines are never counted nor dropped. A site with fewer than ``least_pages`` pages keeps its lines. Repeated
rows count as pages of their own. All other columns of the input are kept; working columns are named ``__…``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from landpulse.llm.tables import query, table
from landpulse.session import durable

WHITE = "\t\n\x0b\x0c\r "
RATIO = 0.2
LEAST_PAGES = 5

# How a page becomes lines: drop what is not text, break at block tags, drop other tags.
UNSEEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>"
BREAKS = r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|table|tr|td|th|h1|h2|h3|h4|h5|h6|br|body|html|form|pre|blockquote)\b[^>]*>"
TAGS = r"<[^>]*>"


def page_text(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN, ""), BREAKS, "\n"), TAGS, "")


def trimmed(line: Column) -> Column:
    """Without white space at the ends; most lines have none, which their first and last characters tell."""
    return F.when((F.ascii(line) <= 32) | (F.ascii(F.substring(line, -1, 1)) <= 32), F.trim(line, F.lit(WHITE))).otherwise(line)


def has_text(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_hash(line: Column) -> Column:
    return F.xxhash64(trimmed(line))


def boilerplate(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per site that has lines to drop: (__site, __drop: array of line hashes)."""
    full = F.filter(F.split(F.col(text), "\n", -1), has_text)
    seen = pages.filter(F.col(site).isNotNull()).select(F.col(site).alias("__site"), F.array_distinct(F.transform(full, line_hash)).alias("__hashes"))
    pages_of = seen.groupBy("__site").agg(F.count(F.lit(1)).alias("__pages")).filter(F.col("__pages") >= least_pages)
    # The outer form and the filter after it, as the plain form would have the array worked out once more to leave out empty ones.
    found = seen.select("__site", F.explode_outer("__hashes").alias("__line")).filter("__line is not null").groupBy("__site", "__line").agg(F.count(F.lit(1)).alias("__found"))
    often = found.filter("__found > 1").join(pages_of, "__site").filter(F.col("__found") > F.col("__pages") * F.lit(ratio))
    return often.groupBy("__site").agg(F.collect_list("__line").alias("__drop"))


def drop_lines(pages: DataFrame, site: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with __lines (lines with text), __dropped (how many went) and __kept (the remaining text)."""
    own = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    rows = pages.select(own.alias("__row"), F.col(f"`{site}`").alias("__site"), F.col(f"`{text}`").alias("__text"))
    drop = durable(boilerplate(rows, "__site", "__text", ratio, least_pages))  # small; its size then decides how it is joined
    joined = rows.join(drop, "__site", "left").withColumn("__all", F.split(F.coalesce(F.col("__text"), F.lit("")), "\n", -1))
    lines = F.size(F.filter("__all", has_text))
    stays = F.when(F.col("__drop").isNull(), F.col("__all")).otherwise(
        F.filter("__all", lambda x: ~has_text(x) | ~F.array_contains(F.col("__drop"), line_hash(x))))
    marked = joined.withColumn("__stays", stays)
    return marked.select(
        *[F.col("__row").getField(c).alias(c) for c in pages.columns],
        lines.cast("long").alias("__lines"), (F.size("__all") - F.size("__stays")).cast("long").alias("__dropped"),
        F.array_join("__stays", "\n").alias("__kept"),
        F.spark_partition_id().alias("__part"))  # not deterministic: filters on the counts stay above them


def sql_dropped(rows: str, ident: str, site: str, text: str) -> str:
    """CTEs ending in ``cleaned``: the rows of ``rows`` with n_lines, n_dropped and kept_text. ``ident`` must be unique."""
    trim = f"trim(l, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' ')"
    return f"""exploded AS (SELECT {ident}, {site} AS site, unnest(string_split(coalesce({text}, ''), chr(10))) AS l,
            unnest(range(len(string_split(coalesce({text}, ''), chr(10))))) AS k FROM {rows}),
        pages_of AS (SELECT {site} AS site, count(*) AS n_pages FROM {rows} WHERE {site} IS NOT NULL GROUP BY 1 HAVING count(*) >= {LEAST_PAGES}),
        often AS (SELECT site, {trim} AS line FROM exploded JOIN pages_of USING (site) WHERE {trim} <> ''
            GROUP BY 1, 2, n_pages HAVING count(DISTINCT {ident}) > n_pages * {RATIO}::DOUBLE AND count(DISTINCT {ident}) > 1),
        flagged AS (SELECT e.{ident}, e.k, e.l, {trim.replace('(l,', '(e.l,')} <> '' AS inked, o.line IS NOT NULL AS dropped
            FROM exploded e LEFT JOIN often o ON o.site = e.site AND o.line = {trim.replace('(l,', '(e.l,')}),
        cleaned AS (SELECT {ident}, count(*) FILTER (inked) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            coalesce(string_agg(l, chr(10) ORDER BY k) FILTER (NOT dropped), '') AS kept_text FROM flagged GROUP BY 1)"""


def site_of(url: Column) -> Column:
    """The lower-case host between ``//`` and the next of ``/ : ? #``; null without one."""
    host = F.translate(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(host != "", host)


SQL = f"""WITH sites AS (SELECT page_id, nullif(translate(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS site,
        regexp_replace(regexp_replace(regexp_replace(html, '{UNSEEN}', '', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g') AS page FROM pages),
    {sql_dropped('sites', 'page_id', 'site', 'page')}
    SELECT page_id, site, n_lines, n_dropped, kept_text FROM cleaned JOIN sites USING (page_id)"""


@query("op8_site_lines", SQL)
def op8_site_lines(spark: SparkSession, folder: str) -> DataFrame:
    # Stored, as the text of a page is dear to work out and read twice.
    pages = durable(table(spark, folder, "pages").select("page_id", site_of(F.col("url")).alias("site"), page_text(F.col("html")).alias("page")))
    return drop_lines(pages, "site", "page").select(
        "page_id", "site", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.col("__kept").alias("kept_text"))
