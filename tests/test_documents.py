from pyspark.sql import functions as F

from bidgraph.operators import documents as D
from bidgraph.sources.store import Store
from bidgraph.streaming import batches, jobs


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


RFP = "TENDER RFP\nMinimum 3 years experience. Valid GST registration. PAN card required."


def test_requirements(spark):
    found = one(spark, RFP, D.eligibility_requirements)
    assert {r.type: r.requirement for r in found} == {"experience": "Minimum 3 years experience", "tax": "Valid GST registration", "identity": "PAN information"}
    assert one(spark, RFP, D.required_documents) == ["GST certificate", "PAN card"]
    assert one(spark, RFP, D.tender_title) == "TENDER RFP"
    assert one(spark, "Minimum 10 years of work", D.eligibility_requirements)[0].requirement == "Minimum 10 years experience"
    assert one(spark, "Average annual turnover of I50 lakh", D.eligibility_requirements)[0].requirement == "Minimum turnover 50 lakh"
    assert {r.type for r in one(spark, "Delivery within 45 days. Bid validity of 90 days. EMD Rs. 5,000", D.technical_requirements)} == {"delivery", "bid_validity", "emd"}
    assert one(spark, "on 15/03/2024 and 3 March 2024", D.important_dates) == ["15/03/2024", "3 March 2024"]


def test_status(spark):
    assert one(spark, None, D.relevance) == "empty" and one(spark, "poem", D.relevance) == "wrong_document" and one(spark, "a tender", D.relevance) == "success"
    assert one(spark, "GST", D.document_status) == "wrong_document"
    assert one(spark, "This GST certificate is issued to the company named in it.", D.document_status) == "valid"


def test_eligibility(spark):
    tenders = spark.createDataFrame([("T", [("Minimum 3 years experience", "experience"), ("Valid GST registration", "tax")], ["GST certificate"])], "tender_id string, requirements array<struct<requirement string, type string>>, documents array<string>")
    bidders = spark.createDataFrame([("T", "B1", 5.0, None, "27ABCDE1234F1Z5", None, None, ["gst certificate "]), ("T", "B2", None, None, None, None, None, None)], "tender_id string, bidder_id string, years_experience double, turnover double, gstin string, pan string, udyam string, documents array<string>")
    found = {r.bidder_id: (r.status, r.score) for r in D.eligibility(tenders, bidders).collect()}
    assert found == {"B1": ("Pre-check Passed", 100.0), "B2": ("Needs Documents", 0.0)}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(f"C{i % 3}", f"T{i % 2}", "10", i) for i in range(12)] + [(None, "T1", "10", 99)]
    spark.createDataFrame(rows, "company_id string, tender_id string, bid_amount string, sec int").select("company_id", "tender_id", "bid_amount", F.timestamp_seconds("sec").alias("ts")).write.parquet(str(src))
    read = lambda: spark.readStream.schema("company_id string, tender_id string, bid_amount string, ts timestamp").parquet(str(src))
    valid, rejects = jobs.submissions(read())

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run(valid, "valid_bids")) == 6 and len(run(rejects, "rejected_bids")) == 1
    best = {r.tender_id: r.bids for r in run(jobs.running_tenders(read().withColumn("bid_amount", F.col("bid_amount").cast("double"))), "best", "complete")}
    assert best == {"T0": 6, "T1": 7}
    steps = spark.createDataFrame([("b", 1, "Verified"), ("b", 2, "Flagged")], "bid_id string, action_seq int, new_status string")
    status = Store(spark, str(tmp_path / "s"), ["bid_id"])
    sink = batches.status_sink(status, str(tmp_path / "audit"))
    sink(steps, 0)
    for _ in range(2):  # a batch that comes again changes nothing
        sink(spark.createDataFrame([("b", 3, "Verified")], steps.schema), 1)
    assert spark.read.parquet(str(tmp_path / "audit/batch=1")).first().previous_status == "Flagged"
    assert tuple(status.read().first()) == ("b", "Verified", 3, 3)
    table = Store(spark, str(tmp_path / "u"), ["bid_id"])
    up = batches.upsert_sink(table, "action_seq")
    up(steps, 0)
    up(spark.createDataFrame([("c", 1, "x")], steps.schema), 1)
    up(spark.createDataFrame([("b", 5, "y"), ("b", 4, "z")], steps.schema), 7)
    held = lambda: sorted(map(tuple, table.read().collect()))
    assert held() == [("b", 5, "y"), ("c", 1, "x")]
    up(spark.createDataFrame([("b", 6, "again")], steps.schema), 7)
    assert held() == [("b", 5, "y"), ("c", 1, "x")]
