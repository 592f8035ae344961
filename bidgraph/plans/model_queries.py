"""Queries of the learnt scores, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidgraph.operators import model, signals
from bidgraph.plans.network_queries import projection, whole_features, whole_signals
from bidgraph.plans.risk_queries import SETTINGS, core, r4
from bidgraph.operators.graph import company_labels
from bidgraph.plans.sql import CTE, with_tables
from bidgraph.plans.storage import materialize
from bidgraph.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CTE |= {
    "supplier_scores": "SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS label, floor((s_acctbal + 1000) / 110) / 100 AS score FROM supplier",
    "score_steps": """SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM supplier_scores GROUP BY score)""",
}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql)
        return f

    return register


def supplier_scores(spark, folder):
    s = table(spark, folder, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 3 == 0, 1).otherwise(0).alias("label"), (F.floor((F.col("s_acctbal") + 1000) / 110) / 100).alias("score"))


@query("SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier), 4) AS s_acctbal FROM supplier")
def scaled_balance(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    return model.scale(rows, columns=("s_acctbal",)).select("s_suppkey", r4("s_acctbal"))


@query("SELECT s_suppkey, round(percent_rank() OVER (ORDER BY s_acctbal), 4) AS percentile FROM supplier")
def rank_percentile(spark, folder):
    return model.rank_percentiles(table(spark, folder, "supplier"), "s_suppkey", ["s_acctbal"]).select("s_suppkey", r4("percentile"))


@query()
def anomaly_scores(spark, folder):
    return model.anomaly_scores(whole_features(spark, folder))


@query()
def data_split(spark, folder):
    return model.split(company_labels(core(spark, folder)[0]))


@query()
def risk_probability(spark, folder):
    parts = core(spark, folder)
    features = whole_features(spark, folder, parts)
    found = model.probabilities(features, company_labels(parts[0]), projection(spark, folder, parts))
    return found if found is not None else model.anomaly_scores(features).withColumnRenamed("anomaly", "model_probability")


@query()
def blended_scores(spark, folder):
    """Rule and anomaly scores blended, riskiest first."""
    features = whole_features(spark, folder)
    anomaly = model.anomaly_scores(features).withColumnRenamed("anomaly", "model_probability")
    return signals.score_companies(whole_signals(features), SETTINGS, anomaly).select("company", "rule_score", "model_probability", "risk_score", "risk_level").orderBy(F.desc("risk_score"), "company")


@query("""SELECT tp AS true_positive, fp AS false_positive, pos - tp AS false_negative, neg - fp AS true_negative, round(tp / (tp + fp), 4)::DOUBLE AS precision, round(tp / pos, 4)::DOUBLE AS recall, round(2 * tp / (tp + fp + pos), 4)::DOUBLE AS f1,
  round(area / (pos * neg), 4)::DOUBLE AS roc_auc, round(ap / pos, 4)::DOUBLE AS average_precision FROM (SELECT (sum(p) FILTER (WHERE score >= 0.5))::BIGINT AS tp, (sum(n) FILTER (WHERE score >= 0.5))::BIGINT AS fp, sum(p)::BIGINT AS pos, sum(n)::BIGINT AS neg, sum(n * (tp - p / 2)) AS area, sum(p * tp / (tp + fp)) AS ap FROM score_steps)""")
def score_metrics(spark, folder):
    m = model.metrics(supplier_scores(spark, folder))
    return m.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1", "roc_auc", "average_precision")})


@query("""WITH cuts AS (SELECT DISTINCT round(score, 4) AS cut FROM supplier_scores UNION SELECT 0.5),
  f AS (SELECT cut, coalesce(round(2 * sum(label) FILTER (WHERE score >= cut) / (count(*) FILTER (WHERE score >= cut) + (SELECT sum(label) FROM supplier_scores)), 9), 0)::DOUBLE AS f1 FROM cuts, supplier_scores GROUP BY cut)
  SELECT f1, median(cut)::DOUBLE AS threshold FROM f GROUP BY f1 ORDER BY f1 DESC LIMIT 1""")
def score_threshold(spark, folder):
    return model.best_threshold(supplier_scores(spark, folder))
