"""Queries of readers and validation over bid files written out of the order lines, with their SQL.

Some of the written rows break a rule, by the numbers of their line: a missing id, an amount that
is none or not positive, an unknown date, an unknown label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.storage import new_path
from bidgraph.plans.tables import table
from bidgraph.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CTE |= {
    "raw_bids": """
      SELECT CASE WHEN l_partkey % 97 = 0 THEN '  ' ELSE ' S' || l_suppkey || ' ' END AS company_id, 'T' || l_orderkey AS tender_id, CASE WHEN l_partkey % 3 = 0 THEN 'nan' ELSE 'P' || (l_suppkey % 40) END AS person_id,
        CASE WHEN l_partkey % 89 = 0 THEN 'unknown' WHEN l_partkey % 83 = 0 THEN '0' WHEN l_partkey % 2 = 0 THEN '₹1,' || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || '.50' ELSE CAST(l_partkey AS VARCHAR) END AS bid_amount,
        CASE WHEN l_partkey % 79 = 0 THEN 'not-a-date' WHEN l_partkey % 2 = 0 THEN strftime(l_shipdate, '%d/%m/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS bid_date,
        CASE WHEN l_linenumber = 1 THEN ' Awarded' WHEN l_linenumber = 2 THEN 'LOST' ELSE '' END AS result, CASE WHEN l_partkey % 73 = 0 THEN 'maybe' WHEN l_partkey % 5 = 0 THEN 'Yes' WHEN l_partkey % 5 = 1 THEN '0.0' ELSE '' END AS label,
        l_partkey, l_suppkey, l_shipdate, l_linenumber FROM lineitem""",
    "judged_bids": """
      SELECT *, list_filter([CASE WHEN l_partkey % 97 = 0 THEN 'company_id: missing' END, CASE WHEN l_partkey % 89 = 0 OR l_partkey % 83 = 0 THEN 'bid_amount: not a positive amount' END,
        CASE WHEN l_partkey % 79 = 0 THEN 'bid_date: unknown format' END, CASE WHEN l_partkey % 73 = 0 THEN 'label: not 0 or 1' END], lambda x: x IS NOT NULL) AS errors FROM raw_bids""",
    "valid_bids": """
      SELECT 'S' || l_suppkey AS company_id, tender_id, CASE WHEN l_partkey % 3 > 0 THEN person_id END AS person_id, CASE WHEN l_partkey % 2 = 0 THEN 1000 + l_partkey % 1000 + 0.5::DOUBLE ELSE l_partkey::DOUBLE END AS bid_amount,
        CAST(l_shipdate AS DATE) AS bid_date, nullif(trim(result), '') AS result, l_linenumber = 1 AS is_winner, CASE WHEN l_partkey % 5 = 0 THEN 1 WHEN l_partkey % 5 = 1 THEN 0 END AS label FROM judged_bids WHERE len(errors) = 0""",
}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def raw_bids(spark, folder):
    """The written rows, all as text, under names that the readers know."""
    line, part = table(spark, folder, "lineitem"), F.col("l_partkey")
    text = lambda c: F.col(c).cast("string")
    return line.select(
        F.when(part % 97 == 0, "  ").otherwise(F.concat(F.lit(" S"), text("l_suppkey"), F.lit(" "))).alias("Vendor ID"), F.concat(F.lit("T"), text("l_orderkey")).alias("Contract-ID"),
        F.when(part % 3 == 0, "nan").otherwise(F.concat(F.lit("P"), (F.col("l_suppkey") % 40).cast("string"))).alias("director_id"),
        F.when(part % 89 == 0, "unknown").when(part % 83 == 0, "0").when(part % 2 == 0, F.concat(F.lit("₹1,"), F.lpad((part % 1000).cast("string"), 3, "0"), F.lit(".50"))).otherwise(text("l_partkey")).alias("Bid Value"),
        F.when(part % 79 == 0, "not-a-date").when(part % 2 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("bid_date"),
        F.when(F.col("l_linenumber") == 1, " Awarded").when(F.col("l_linenumber") == 2, "LOST").otherwise("").alias("Outcome"),
        F.when(part % 73 == 0, "maybe").when(part % 5 == 0, "Yes").when(part % 5 == 1, "0.0").otherwise("").alias("label"),
    )


def written(spark, folder, ending: str) -> str:
    path = f"{new_path(spark, 'bids')}.{ending}"
    rows = raw_bids(spark, folder)
    rows.write.option("header", True).option("escape", '"').csv(path) if ending == "csv" else rows.write.json(path)
    return path


_COLUMNS = ("company_id", "tender_id", "person_id", "bid_amount", "bid_date", "result", "is_winner", "label")


@query(f"SELECT {', '.join(_COLUMNS)} FROM valid_bids")
def ingest_csv(spark, folder):
    return files.load(spark, written(spark, folder, "csv"))[0].select(*_COLUMNS)


@query(f"SELECT {', '.join(_COLUMNS)} FROM valid_bids")
def ingest_json(spark, folder):
    return files.load(spark, written(spark, folder, "jsonl"))[0].select(*_COLUMNS)


@query("SELECT trim(company_id) AS company_id, tender_id, errors FROM judged_bids WHERE len(errors) > 0")
def ingest_rejects(spark, folder):
    rejects = files.load(spark, written(spark, folder, "jsonl"))[1]
    return rejects.select(F.trim("company_id").alias("company_id"), "tender_id", "errors")


@query("""SELECT count(*) FILTER (WHERE len(errors) = 0) AS valid, count(*) FILTER (WHERE len(errors) = 0 AND l_partkey % 5 = 0) AS positive, count(*) FILTER (WHERE len(errors) = 0 AND l_partkey % 5 = 1) AS negative,
  count(*) FILTER (WHERE len(errors) = 0) AS amounts, count(*) FILTER (WHERE len(errors) = 0 AND l_partkey % 3 > 0) AS persons, 0::BIGINT AS addresses, count(*) FILTER (WHERE len(errors) > 0) AS rejected, count(*) AS total, ['no addresses'] AS warnings FROM judged_bids""")
def ingest_report(spark, folder):
    return files.report(*files.load(spark, written(spark, folder, "csv")))


@query("SELECT trim(concat_ws(' ', company_id, tender_id, array_to_string(errors, ', '))) AS message FROM judged_bids WHERE len(errors) > 0 ORDER BY concat_ws(' ', company_id, tender_id, array_to_string(errors, ', ')) LIMIT 25")
def ingest_messages(spark, folder):
    return files.messages(files.load(spark, written(spark, folder, "csv"))[1]).select(F.trim("message").alias("message"))


@query("SELECT count(*) AS n FROM raw_bids")
def feed_fingerprint(spark, folder):
    """The feed's digest doesn't depend on the order of its rows: one row only if two orders agree."""
    rows = raw_bids(spark, folder)
    return files.fingerprint(rows).unionByName(files.fingerprint(rows.orderBy("Bid Value"))).distinct().select("n")
