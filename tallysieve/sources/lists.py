"""Community lists in README files: HTML tables and pipe tables as listings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallysieve.functions.text import or_null, stripped, text
from tallysieve.functions.times import age_days
from tallysieve.sources.html import parse

MAX_AGE_DAYS = 7
CARRY = "↳"
#: Rows that a Python worker hands on at a time, however long the texts' tables are.
BATCH_ROWS = 2_000
_ROW_NAMES = ["source_name", "company", "title", "location", "apply_url", "age"]


def table_rows(text_: str | None) -> list[dict]:
    """Rows of four cells or more of all HTML tables, with table and row numbers."""
    out = []
    if "<table" not in (text_ or "").lower():
        return out
    for t, table in enumerate(parse(text_).all("table")):
        for r, row in enumerate((table.first("tbody") or table).all("tr")):
            cells = row.all("td")
            if len(cells) >= 4:
                link = next((a for a in cells[-2].all("a") if "href" in a.attrs), None)
                out.append({
                    "tbl": t, "pos": r, "company": cells[0].text(), "title": cells[1].text(), "location": cells[2].text() if len(cells) > 4 else "",
                    "apply_url": link.attrs["href"] if link else None, "age": cells[-1].text(),
                })
    return out


def carried(rows: DataFrame, *table: str) -> DataFrame:
    """Rows whose company is blank or an arrow take the last company above them in their table."""
    own = F.when(~F.col("company").isin(CARRY, ""), F.col("company"))
    w = Window.partitionBy(*table).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("company", F.coalesce(F.last(own, ignorenulls=True).over(w), "company"))


def html_table_rows(readmes: DataFrame) -> DataFrame:
    """Rows of the HTML tables of README texts; a task holds one text's rows and one batch of ``BATCH_ROWS``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for name, text_ in zip(batch["source_name"], batch["text"]):
                for row in _html_rows(text_):
                    held.append((name, *row))
                    if len(held) >= BATCH_ROWS:
                        yield pd.DataFrame(held, columns=_ROW_NAMES)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=_ROW_NAMES)

    return readmes.select(F.col("source_name").cast("string").alias("source_name"), "text").mapInPandas(read, ", ".join(f"{n} string" for n in _ROW_NAMES))


def _html_rows(text_: str) -> Iterator[tuple]:
    """Rows of all HTML tables; a blank company or an arrow takes the company above it in its table."""
    table, above = None, ""
    for row in table_rows(text_):
        if row["tbl"] != table:
            table, above = row["tbl"], ""
        if row["company"] not in (CARRY, ""):
            above = row["company"]
        yield above or row["company"], row["title"], row["location"], row["apply_url"], row["age"]


def _pipe_rows(text_: str) -> Iterator[tuple]:
    """Rows of five cells or more under a header and separator line."""
    above, inside = False, False
    for line in re.split(r"\r\n|\n|\r", text_):
        row = line.strip()
        if not row.startswith("|"):
            above = inside = False
            continue
        if inside:
            cells = [c.strip() for c in row.strip("|").split("|")]
            if len(cells) >= 5:
                link = re.search(r"""<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", cells[-2], re.I)
                plain = [re.sub(r"<[^>]*>", "", c).strip() for c in (*cells[:3], cells[-1])]
                yield *plain[:3], link[1] if link else None, plain[3]
        elif above and re.match(r"\s*\|[\s:|-]+\|\s*$", line):
            inside = True
        above = True


@udtf(returnType="company string, title string, location string, apply_url string, age string")
class ReadmeRows:
    """Table rows of a README text, of HTML tables and of pipe tables: ``FROM readmes, LATERAL readme_rows(text)``.

    A null text has none.  What a text carries from row to row stays in its one call, so no rows are shuffled.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from _html_rows(text)
            yield from _pipe_rows(text)


def readme_rows(readmes: DataFrame) -> DataFrame:
    """(source_name, company, title, location, apply_url, age) of README texts (source_name, text), by the table function."""
    spark = readmes.sparkSession
    spark.udtf.register("readme_rows", ReadmeRows)
    return spark.sql("SELECT source_name, r.* FROM {readmes}, LATERAL readme_rows(text) AS r", readmes=readmes)


def _cell_text(c: Column) -> Column:
    return stripped(F.regexp_replace(c, "<[^>]*>", ""))


def pipe_table_rows(readmes: DataFrame) -> DataFrame:
    """Rows of five cells or more under a header and separator line; no company is carried here."""
    lines = readmes.select("source_name", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("n", "line"))
    lines = lines.withColumn("row", stripped(F.col("line"))).withColumn("is_row", F.col("row").startswith("|"))
    w = Window.partitionBy("source_name").orderBy("n")
    lines = lines.withColumn("is_rule", F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    # A block of adjacent rows is a table from its first separator with a row above it on.
    lines = lines.withColumn("block", F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(w))
    in_block = Window.partitionBy("source_name", "block").orderBy("n")
    starts = F.col("is_rule") & F.coalesce(F.lag("is_row").over(in_block), F.lit(False)) & F.col("is_row")
    lines = lines.where("is_row").withColumn("starts", starts)
    body = lines.withColumn("seen", F.sum(F.col("starts").cast("int")).over(in_block.rowsBetween(Window.unboundedPreceding, -1)))
    cells = F.transform(F.split(F.regexp_replace(F.col("row"), r"^\|+|\|+$", ""), r"\|"), stripped)
    rows = body.where("seen >= 1").withColumn("c", cells).where(F.size("c") >= 5)
    link = or_null(F.regexp_extract(F.element_at("c", -2), r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)""", 1))
    return rows.select("source_name", _cell_text(F.get("c", F.lit(0))).alias("company"), _cell_text(F.get("c", F.lit(1))).alias("title"), _cell_text(F.get("c", F.lit(2))).alias("location"), link.alias("apply_url"), _cell_text(F.element_at("c", -1)).alias("age"))


def listings(rows: DataFrame, now: Column) -> DataFrame:
    """Complete rows of at most ``MAX_AGE_DAYS`` days as listings; the id derives from the link."""
    days = age_days(F.col("age"), F.to_date(now))
    kept = rows.withColumn("days", days).where((text(F.col("company")) != "") & (text(F.col("title")) != "") & (text(F.col("apply_url")) != "") & (F.col("days") <= MAX_AGE_DAYS))
    return kept.select(
        F.concat(F.lit("gh:"), F.left(F.sha1("apply_url"), F.lit(16))).alias("id"),
        "title",
        "company",
        "location",
        F.col("apply_url").alias("url"),
        "apply_url",
        F.date_format(now - F.make_dt_interval("days"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("posted_at"),
        F.lit(None).cast("string").alias("description"),
        F.lit(False).alias("is_easy_apply"),
        F.concat(F.lit("github:"), "source_name").alias("search_term"),
    )


def readme_listings(readmes: DataFrame, now: Column) -> DataFrame:
    """Listings of README texts (source_name, text) of both table forms."""
    return listings(html_table_rows(readmes).unionByName(pipe_table_rows(readmes)), now)


def read_readmes(spark, path: str) -> DataFrame:
    """README files as (source_name, text); the name is the file's."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)?$", 1).alias("source_name"), F.col("value").alias("text"))


def raw_url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(owner, repository, branch) of a raw-file url; null if it is none."""
    part = lambda k: or_null(F.regexp_extract(url, r"^https?://raw\.githubusercontent\.com/([^/]+)/([^/]+)/(?:refs/heads/)?([^/]+)/", k))
    return part(1), part(2), part(3)


def latest_commit(feed: Column) -> Column:
    """The newest entry's id of a commit feed: the second id of the text."""
    return F.get(F.regexp_extract_all(feed, F.lit(r"<id>([^<]*)</id>"), 1), F.lit(1))


def changed(feeds: DataFrame, state: DataFrame) -> DataFrame:
    """(source_name, commit) of feeds (source_name, feed) whose newest commit is not the state's (key, value)."""
    now = feeds.select("source_name", latest_commit(F.col("feed")).alias("commit")).where("commit IS NOT NULL")
    known = state.select(F.col("key").alias("source_name"), "value")
    return now.join(known, "source_name", "left").where(~F.col("commit").eqNullSafe(F.col("value"))).select("source_name", "commit")
