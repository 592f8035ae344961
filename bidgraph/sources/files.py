"""Readers and writers of bid files, keyed upserts and change fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidgraph.functions import clean
from bidgraph.functions.settings import COLUMN_ALIASES

REQUIRED = ("company_id", "tender_id")
FIELDS = ("company_id", "tender_id", "company_name", "person_id", "person_name", "department_id", "department_name", "address", "result", "bid_amount", "tender_value", "bid_date", "label")
LISTS = ("records", "data", "rows", "bids")


def canonical_columns(df: DataFrame) -> DataFrame:
    """Columns under their canonical names; of two with one name, the last given value counts."""
    named: dict[str, list[str]] = {}
    for c in df.columns:
        key = c.strip().lower().replace(" ", "_").replace("-", "_")
        named.setdefault(COLUMN_ALIASES.get(key.replace("_", ""), COLUMN_ALIASES.get(key, key)), []).append(c)
    out = df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in reversed(cs)]).alias(name) for name, cs in named.items()])
    missing = [c for c in REQUIRED if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return out


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return canonical_columns(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A list of records, an object that holds one, or JSON lines."""
    df = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    held = [c for c in LISTS if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]
    if held:
        df = df.select(F.explode(held[0]).alias("r")).select("r.*")
    return canonical_columns(df)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv(spark, path)
    if ending in ("json", "jsonl"):
        return read_json(spark, path, lines=ending == "jsonl")
    if ending == "parquet":
        return canonical_columns(spark.read.parquet(path))
    raise ValueError(f"unsupported file type: {ending}")


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects): typed bids, and raw rows with their ``errors``."""
    text = raw
    for c in FIELDS:
        if c not in raw.columns:
            text = text.withColumn(c, F.lit(None).cast("string"))
    c = lambda name: F.col(name).cast("string")
    amount = clean.parse_money(c("bid_amount"))
    checks = [
        (clean.identifier(c("company_id")).isNull(), "company_id: missing"),
        (clean.identifier(c("tender_id")).isNull(), "tender_id: missing"),
        (clean.money_error(c("bid_amount")) | F.coalesce(amount <= 0, F.lit(False)), "bid_amount: not a positive amount"),
        (clean.money_error(c("tender_value")), "tender_value: not an amount"),
        (clean.date_error(c("bid_date")), "bid_date: unknown format"),
        (clean.label_error(c("label")), "label: not 0 or 1"),
    ]
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]))
    seen = text.withColumn("errors", errors)
    extras = [x for x in raw.columns if x not in FIELDS]
    names = ("company_name", "person_id", "person_name", "department_id", "department_name", "address", "result")
    valid = seen.where(F.size("errors") == 0).select(
        clean.identifier(c("company_id")).alias("company_id"), clean.identifier(c("tender_id")).alias("tender_id"), *[clean.blank_to_null(c(n)).alias(n) for n in names],
        amount.alias("bid_amount"), clean.parse_money(c("tender_value")).alias("tender_value"), clean.parse_date(c("bid_date")).alias("bid_date"), clean.parse_label(c("label")).alias("label"),
        clean.is_winner(c("result")).alias("is_winner"), *[F.col(f"`{x}`") for x in extras],
    )
    return valid, seen.where(F.size("errors") > 0).select(*[F.col(f"`{x}`") for x in raw.columns], "errors")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of a file of bids; an error if it has no valid row."""
    valid, rejects = validate(read_path(spark, path))
    if valid.isEmpty():
        raise ValueError("no valid bid records; first problems: " + "; ".join(r.message for r in messages(rejects, 3).collect()))
    return valid, rejects


def messages(rejects: DataFrame, limit: int = 25) -> DataFrame:
    """(message): the first problems in the order of their texts, at most ``limit``."""
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REQUIRED if c in rejects.columns]
    rows = rejects.select(F.concat_ws(" ", *ids, F.array_join("errors", ", ")).alias("message"))
    return rows.orderBy("message").limit(limit)


def one_source(path: str | None = None, rows: DataFrame | None = None) -> str:
    """Which of the two inputs is given; an error unless it is exactly one."""
    given = [name for name, value in (("path", path), ("rows", rows)) if value is not None]
    if len(given) != 1:
        raise ValueError("give exactly one of path and rows")
    return given[0]


def report(valid: DataFrame, rejects: DataFrame) -> DataFrame:
    """One row: totals, label counts and warnings."""
    v = valid.agg(F.count("*").alias("valid"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count("bid_amount").alias("amounts"), F.count("person_id").alias("persons"), F.count("address").alias("addresses"))
    r = rejects.agg(F.count("*").alias("rejected"))
    one = F.lit(1).alias("one")
    both = v.select(one, "*").join(r.select(one, "*"), "one").drop("one")
    warnings = F.array_compact(F.array(
        F.when((F.col("positive") == 0) != (F.col("negative") == 0), F.lit("labels have one class")), F.when(F.col("amounts") == 0, F.lit("no bid amounts")),
        F.when(F.col("persons") == 0, F.lit("no persons")), F.when(F.col("addresses") == 0, F.lit("no addresses")),
    ))
    return both.select("*", (F.col("valid") + F.col("rejected")).alias("total"), warnings.alias("warnings"))


def to_csv(df: DataFrame, path: str) -> None:
    """Arrays joined by "; "."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), "; ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both by key, the highest version of each; rows that ``new`` lacks stay."""
    both = old.unionByName(new, allowMissingColumns=True)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(version)))
    return both.withColumn("_place", place).where("_place = 1").drop("_place")


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a digest of the rows that does not depend on their order."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    parts = df.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return parts.select(F.sha1(F.concat_ws(":", "n", "s", "x")).alias("fingerprint"), "n")
