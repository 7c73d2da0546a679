"""URL filter by a dated list: validity intervals and an as-of join, in DataFrame functions only.

A listing says on a day that an entry (a host or a parent domain) is added or
removed.  Days become validity intervals; a capture is blocked if its host or
one of the host's parent domains was on the list on the day of the fetch.

The as-of join is an equi-join: intervals are cut at month ends, so a capture
meets only the pieces of its entry in its own month (31 at most), and verdicts
are looked up once per distinct (host, day), then joined back to the captures.
A host with a third of all captures thus costs one lookup a day; the join back is
an equi-join that AQE may split.

Defined cases: a null or unparsable URL has no host and is not blocked; a capture
without a day is not blocked; listings without entry or day are ignored; an
entry both added and removed on one day is on the list from that day; repeated
listings count once; repeated captures are judged row by row; hosts and entries
are compared in lower case, without a final dot; an empty list blocks nothing and
no captures give no rows; URLs may have any length; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Behind user information, in front of a port; an address in square brackets is read whole.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)"


def _name(c: Column) -> Column:
    return F.nullif(F.rtrim(F.lower(c), F.lit(".")), F.lit(""))


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; null if there is none."""
    return _name(F.regexp_extract(url, HOST, 1))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of at least two labels (a host of one label stands alone)."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(listings: DataFrame) -> DataFrame:
    """entry, valid_from, valid_to (exclusive, null: still valid) from listings (entry, listed_on, added)."""
    days = (listings.select(_name(F.col("entry")).alias("entry"), F.col("listed_on").cast("date").alias("valid_from"), "added")
            .where("entry is not null and valid_from is not null and added is not null")
            .groupBy("entry", "valid_from").agg(F.bool_or("added").alias("added")))
    ordered = Window.partitionBy("entry").orderBy("valid_from")          # at most one row a day
    return days.withColumn("valid_to", F.lead("valid_from").over(ordered)).where("added").select("entry", "valid_from", "valid_to")


def judge(captures: DataFrame, listings: DataFrame) -> DataFrame:
    """captures (page_id, url, fetched) as page_id, host, fetched, blocked, n_active, entry, listed_on (of the longest entry)."""
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    asked = seen.where("host is not null and fetched is not null").select("host", "fetched").distinct()
    last_day = seen.agg(F.max("fetched")).scalar()
    pieces = (validity_intervals(listings).withColumn("last_day", last_day).where(F.col("valid_from") <= F.col("last_day"))
              .withColumn("month", F.explode(F.sequence(
                  F.trunc("valid_from", "month"),
                  F.trunc(F.coalesce(F.least(F.date_sub("valid_to", 1), "last_day"), "last_day"), "month"),
                  F.expr("interval 1 month"))))
              .select("entry", "month", "valid_from", "valid_to"))
    met = (asked.withColumn("entry", F.explode(domains_of(F.col("host")))).withColumn("month", F.trunc("fetched", "month"))
           .join(pieces, ["entry", "month"])
           .where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))))
    verdict = met.groupBy("host", "fetched").agg(
        F.count("*").alias("n_active"), F.max_by("entry", F.length("entry")).alias("entry"),
        F.max_by("valid_from", F.length("entry")).alias("listed_on"))
    return (seen.join(verdict, ["host", "fetched"], "left")
            .select("page_id", "host", "fetched", F.col("n_active").isNotNull().alias("blocked"),
                    F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), "entry", "listed_on"))


def filter_captures(captures: DataFrame, listings: DataFrame) -> DataFrame:
    """page_id, host, fetched of the captures that were not on the list when they were fetched."""
    return judge(captures, listings).where("not blocked").select("page_id", "host", "fetched")


# ---------------------------------------------------------------- the driver's tables

def _number(c: Column, salt: str) -> Column:
    """A number below 2^24 from a text."""
    return F.conv(F.substring(F.md5(F.concat(c, F.lit(salt))), 1, 6), 16, 10).cast("int")


def derived_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a day of the year 2024 for every page (the table has no fetch time)."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("page_id").cast("string"), "f") % 366).alias("fetched"))


def derived_listings(pages: DataFrame) -> DataFrame:
    """Up to four dated listings of every host and parent domain that occurs in the pages."""
    names = (pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("entry")).distinct())
    turns = F.array(*[F.struct(
        F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("entry"), f"d{k}") % 366).alias("listed_on"),
        (_number(F.col("entry"), f"a{k}") % 2 == 0).alias("added"), (_number(F.col("entry"), f"u{k}") % 3 == 0).alias("used")) for k in range(4)])
    return names.select("entry", F.explode(turns).alias("t")).where("t.used").select("entry", "t.listed_on", "t.added")


def _sql_number(c: str, salt: str) -> str:
    return f"('0x' || substr(md5({c} || '{salt}'), 1, 6))::INT"


ORACLE = f"""
WITH seen AS (
  SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '{HOST}', 1)), '.'), '') AS host,
         DATE '2024-01-01' + {_sql_number("page_id::VARCHAR", "f")} % 366 AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS labels FROM seen WHERE host IS NOT NULL),
names AS (SELECT host, array_to_string(labels[i:], '.') AS entry
          FROM (SELECT host, labels, unnest(range(1, greatest(2, len(labels)))) AS i FROM hosts)),
entries AS (SELECT DISTINCT entry FROM names),
listings AS (
  {" UNION ALL ".join(f"SELECT entry, DATE '2024-01-01' + {_sql_number('entry', f'd{k}')} % 366 AS listed_on, {_sql_number('entry', f'a{k}')} % 2 = 0 AS added FROM entries WHERE {_sql_number('entry', f'u{k}')} % 3 = 0" for k in range(4))}),
days AS (SELECT entry, listed_on, bool_or(added) AS added FROM listings GROUP BY ALL),
spans AS (SELECT entry, listed_on, lead(listed_on) OVER (PARTITION BY entry ORDER BY listed_on) AS ends, added FROM days),
met AS (
  SELECT s.host, s.fetched, n.entry, p.listed_on
  FROM (SELECT DISTINCT host, fetched FROM seen) s JOIN names n USING (host)
  JOIN spans p ON p.entry = n.entry AND p.added AND s.fetched >= p.listed_on AND (p.ends IS NULL OR s.fetched < p.ends)),
verdict AS (SELECT host, fetched, count(*) AS n_active, max_by(entry, length(entry)) AS entry, max_by(listed_on, length(entry)) AS listed_on
            FROM met GROUP BY ALL)
SELECT page_id, seen.host, CAST(seen.fetched AS DATE) AS fetched, n_active IS NOT NULL AS blocked, coalesce(n_active, 0)::BIGINT AS n_active,
       entry, CAST(listed_on AS DATE) AS listed_on
FROM seen LEFT JOIN verdict ON seen.host = verdict.host AND seen.fetched = verdict.fetched
"""
