"""Reports what is wrong with crawled sites before they are compiled into a knowledge base.

Reads a table of fetched pages and writes two tables.

* ``pages``: a row for each page with its canonical address, title, hash and numbers of links, by whether
  the page has findings.
* ``findings``: a row for each thing wrong, by its code: ``broken-link`` (to a page of the same site that
  wasn't fetched), ``orphan`` (no other page links to it), ``copy`` (an earlier page has the same content),
  ``same-address`` (an earlier page has the same canonical address), ``missing-title``.

Each run makes both tables anew from all pages, so a run after any failure gives the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs._run import command, counted, log
from marlstone.functions.text import canonical_url
from marlstone.operators.graph import broken_links, orphans
from marlstone.sources.web import hrefs, page_title

DEFAULTS: dict[str, object] = {"pages": "", "output": ""}
#: The written tables; partitions come last.
FINDINGS = "page_id long, url string, detail string, code string"
PAGES = "page_id long, url string, address string, title string, sha256 string, n_links long, n_findings long, clean boolean"


def described(pages: DataFrame) -> DataFrame:
    """``(page_id, url, address, title, sha256, targets, site, place)``, rows repeated for one page and content once.

    Targets are the resolved addresses of its links, repeats included; place is the address without a
    slash at its end.  Null html is an empty page without a hash.
    """
    found = hrefs(F.coalesce("html", F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", canonical_url("url").alias("address"), F.coalesce(page_title(F.col("html")), F.lit("")).alias("title"), F.sha2("html", 256).alias("sha256"), F.transform(found, lambda h: canonical_url(h, "url")).alias("targets"))
    rows = rows.dropDuplicates(["page_id", "url", "sha256"])
    return rows.withColumns({"site": F.regexp_extract("address", r"^([a-z]+://[^/]*)/", 1), "place": F.regexp_replace("address", "/$", "")})


def findings_of(pages: DataFrame) -> DataFrame:
    """``(code, page_id, url, detail)`` of ``described`` pages."""
    links = pages.where("site <> ''").select("page_id", "url", "site", F.col("place").alias("src"), F.explode(F.array_distinct("targets")).alias("target"))
    inner = links.where(F.col("target").startswith(F.concat("site", F.lit("/")))).withColumn("dst", F.regexp_replace("target", "/$", ""))
    broken = broken_links(inner, pages.select(F.col("place").alias("rel_path")).distinct()).select(F.lit("broken-link").alias("code"), "page_id", "url", F.col("target").alias("detail"))
    lonely = orphans(pages.select("page_id", "url", F.col("place").alias("path")), inner.where("src <> dst"))
    lonely = lonely.select(F.lit("orphan").alias("code"), "page_id", "url", F.lit("").alias("detail"))

    def earlier(key: str, code: str) -> DataFrame:
        """Pages that have the key of one with a smaller page_id; ties by url."""
        first = pages.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("page_id", "url")).alias("first"))
        rows = pages.join(first, key).where(~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("url").eqNullSafe(F.col("first.url"))))
        return rows.select(F.lit(code).alias("code"), "page_id", "url", F.col("first.url").alias("detail"))

    untitled = pages.where(F.trim("title") == "").select(F.lit("missing-title").alias("code"), "page_id", "url", F.lit("").alias("detail"))
    return reduce(DataFrame.unionAll, [broken, lonely, earlier("sha256", "copy"), earlier("address", "same-address"), untitled])


def _of_page(pages: DataFrame, other: DataFrame) -> DataFrame:
    """``pages`` with the columns of ``other`` for the same page_id and url, nulls being equal."""
    other = other.withColumnsRenamed({"page_id": "their_id", "url": "their_url"})
    same = F.col("page_id").eqNullSafe(F.col("their_id")) & F.col("url").eqNullSafe(F.col("their_url"))
    return pages.join(other, same, "left").drop("their_id", "their_url")


def report(spark: SparkSession, pages: str, output: str) -> None:
    """Makes the report of the Parquet table ``pages(page_id, url, html)`` anew."""
    read, seen = counted(spark.read.parquet(pages).select("page_id", "url", "html"), "pages read")
    passing = f"{output}/described"
    described(read).write.mode("overwrite").parquet(passing)  # read several times below
    log.info("read %s pages of %s", seen.get["rows"], pages)
    known = spark.read.parquet(passing)
    found, n_found = counted(findings_of(known), "findings")
    found.write.mode("overwrite").partitionBy("code").parquet(f"{output}/findings")
    log.info("wrote %s findings", n_found.get["rows"])
    wrong = spark.read.schema(FINDINGS).parquet(f"{output}/findings").groupBy("page_id", "url").agg(F.count("*").alias("n_findings"))
    rows, n_pages = counted(_of_page(known, wrong).select("page_id", "url", "address", "title", "sha256", F.size("targets").cast("long").alias("n_links"), F.coalesce("n_findings", F.lit(0)).alias("n_findings")), "pages written")
    rows.withColumn("clean", F.col("n_findings") == 0).write.mode("overwrite").partitionBy("clean").parquet(f"{output}/pages")
    log.info("wrote %s pages", n_pages.get["rows"])


def output_of(spark: SparkSession, output: str) -> DataFrame:
    """``(page_id, url, address, title, n_links, n_findings, code, detail)``: every page with its findings; nulls for a page without one."""
    pages, found = spark.read.schema(PAGES).parquet(f"{output}/pages"), spark.read.schema(FINDINGS).parquet(f"{output}/findings")
    return _of_page(pages, found).select("page_id", "url", "address", "title", "n_links", "n_findings", "code", "detail")


if __name__ == "__main__":
    command("site-report", DEFAULTS, report)
