"""Ingestion, identity, graph, features and scores on literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from bidgraph.functions import clean
from bidgraph.functions.settings import Settings
from bidgraph.operators import features, graph, identity, model, networks, pairs, portfolio, signals
from bidgraph.sources import files

S = Settings()
COLUMNS = "company_id string, company_name string, person_id string, person_name string, tender_id string, department_id string, department_name string, address string, bid_amount double, tender_value double, bid_date date, label int, result string, row_seq long"


def bids(spark, rows):
    """Rows of (company, tender, amount, result, person), in feed order."""
    full = [(c, None, p, p and f"Dr {p}", t, "D1", None, None, a, 100.0, None, None, r, i) for i, (c, t, a, r, p) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("15/03/2024", (2024, 3, 15)), ("03/04/2024", (2024, 4, 3)), ("03/15/2024", (2024, 3, 15)), ("2024-01-02", (2024, 1, 2)), ("2024/1/2", (2024, 1, 2)), ("2024-01-02T03:04:05", (2024, 1, 2)), ("not-a-date", None), (None, None)],
)
def test_dates(spark, text, want):
    assert one(spark, clean.parse_date, text) == (want and datetime.date(*want))


@pytest.mark.parametrize(("text", "want"), [("1,250,000.50", 1250000.5), ("₹ 10", 10.0), ("$5", 5.0), ("1d", None), ("", None), ("-3", -3.0), (None, None)])
def test_money(spark, text, want):
    assert one(spark, clean.parse_money, text) == want


def test_validation(spark):
    raw = spark.createDataFrame([("C1", "T1", "1,250,000.50", "15/03/2024", "Awarded"), (None, "T2", None, None, None), ("C2", "T2", None, "not-a-date", None), ("C3", "T3", "0", None, None)], "Vendor_ID string, `Contract-ID` string, `Bid Value` string, date string, Outcome string")
    valid, rejects = files.validate(files.canonical_columns(raw))
    row = valid.first()
    assert (row.company_id, row.bid_amount, row.bid_date, row.is_winner) == ("C1", 1250000.5, datetime.date(2024, 3, 15), True)
    assert sorted(len(r.errors) for r in rejects.collect()) == [1, 1, 1]
    report = files.report(valid, rejects).first()
    assert (report.valid, report.rejected, report.total) == (1, 3, 4)
    with pytest.raises(ValueError):
        files.canonical_columns(raw.select("date"))


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Vendor ID,Contract_ID,Bid Value,Outcome\nC1,T1,100,WIN\n")
    (tmp_path / "a.json").write_text('{"records":[{"company_id":"C1","tender_id":"T1"}]}')
    (tmp_path / "b.json").write_text('[{"company_id":"C1","tender_id":"T1"},{"company_id":"C2","tender_id":"T1"}]')
    (tmp_path / "c.jsonl").write_text('{"company_id":"C1","tender_id":"T1"}\n')
    assert files.read_path(spark, str(tmp_path / "a.csv")).first().company_id == "C1"
    assert [files.read_path(spark, str(tmp_path / n)).count() for n in ("a.json", "b.json", "c.jsonl")] == [1, 2, 1]
    with pytest.raises(ValueError):
        files.read_path(spark, str(tmp_path / "a.txt"))


def test_csv_upsert_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 1), (2, [], 1)], "id int, tags array<string>, v int")
    files.to_csv(df, str(tmp_path / "out"))
    assert "1,a; b,1" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    new = spark.createDataFrame([(2, ["z"], 2), (3, ["n"], 2)], "id int, tags array<string>, v int")
    assert sorted((r.id, r.v) for r in files.upsert(df, new, ["id"], "v").collect()) == [(1, 1), (2, 2), (3, 2)]
    assert files.fingerprint(df).first() == files.fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert files.fingerprint(df).first() != files.fingerprint(new).first()


def test_keys(spark):
    def key(f, text):
        return one(spark, lambda c: f(clean.base_clean(clean.fold_accents(c))), text)

    assert key(clean.company_key, "ABC Infra Pvt. Ltd.") == key(clean.company_key, "A.B.C. INFRA PRIVATE LIMITED") == "abc infra"
    assert key(clean.company_key, "Shakti Buildcon LLP") == key(clean.company_key, "shakti  buildcon llp")
    assert key(clean.company_key, "Apex Infra") != key(clean.company_key, "Orion Infra")
    assert key(clean.company_key, "The Company Ltd") == "the company ltd"
    assert key(clean.person_key, "Dr. Rahul Sharma") == key(clean.person_key, "Sharma Rahul")
    assert key(clean.address_key, "12/A, MG Road, Bhilai") == key(clean.address_key, "12 A  M.G. Rd., BHILAI")
    assert key(clean.company_key, "Société Générale") == "societe generale"


def test_formats(spark):
    assert one(spark, clean.is_gst, "27ABCDE1234F1Z5") and not one(spark, clean.is_gst, "not-a-gst")
    assert one(spark, clean.is_pan, "ABCDE1234F") and not one(spark, clean.is_pan, "bad")
    assert one(spark, clean.mask_phone, "9812345621") == "98XXXXXX21"
    assert one(spark, clean.mask_account, "001234560091") == "XXXX XXXX 0091" and one(spark, clean.mask_account, "12") == "12"
    assert one(spark, clean.person_slug, " A. K.  Rao ") == "PER-a-k-rao" and one(spark, clean.person_slug, " ") is None
    files_ = spark.createDataFrame([("a.pdf", "JVBERi0xLjQ="), ("b.docx", "UEsDBA=="), ("c.pdf", "UEsDBA=="), ("d.doc", None)], "n string, c string")
    assert [r[0] for r in files_.select(clean.has_document_signature(F.col("n"), F.col("c"))).collect()] == [True, True, False, False]


def test_identity_last_name_wins(spark):
    feed = [("C1", "Apex Infra Pvt Ltd"), ("C1-B", "APEX INFRA PRIVATE LIMITED"), ("C2", "One Ltd"), ("C2", "Two Ltd")]
    df = bids(spark, [(c, f"T{i}", 1.0, None, None) for i, (c, _) in enumerate(feed)])
    names = spark.createDataFrame([(i, n) for i, (_, n) in enumerate(feed)], "row_seq long, n string")
    df = df.join(names, "row_seq").withColumn("company_name", F.col("n")).drop("n")
    merged = identity.merged_groups(df, "company").first()
    assert merged.aliases == ["C1", "C1-B"] and merged.display == "Apex Infra Pvt Ltd"
    resolved = {(r.company_id, r.company) for r in identity.resolve(df).collect()}
    assert len(resolved) == 3 and len({c for i, c in resolved if i == "C2"}) == 1


def test_facts_and_pairs(spark):
    df = identity.resolve(bids(spark, [("C1", "T1", 100.0, None, "P1"), ("C1", "T1", 90.0, "WIN", "P1"), ("C2", "T1", 95.0, None, "P1"), ("C1", "T2", 100.0, "lost", "P1"), ("C2", "T2", 99.0, "won", "P1"), ("C3", "T3", 5.0, "won", "P2")]))
    facts, dim = graph.bid_facts(df), graph.tender_dim(df)
    fact = facts.where("company = 'C_C1' AND tender = 'T_T1'").first()
    assert (fact.bid_amount, fact.is_winner, facts.count()) == (90.0, True, 5)
    pair = pairs.pair_features(df, facts, dim).collect()
    assert len(pair) == 1 and pair[0].shared_tenders == 2 and pair[0].alternating_wins == 1 and pair[0].shared_directors == 1
    assert graph.ownership(df).count() == 2
    edges = graph.edges(df, pairs.cobid_pairs(pairs.pair_rows(facts)))
    nodes = graph.nodes(df, df)
    assert graph.schema_violations(edges, nodes).count() == 0
    hops, induced = graph.ego_network(edges, spark.createDataFrame([("C_C3",)], "id string"), depth=1)
    assert {r.hops for r in hops.collect()} == {0, 1} and induced.count() >= 2
    tender = {r.tender: r for r in features.tender_features(facts, dim).collect()}
    assert tender["T_T3"].single_bidder and tender["T_T1"].n_bidders == 2 and tender["T_T1"].winner == "C_C1"
    matrix = features.company_features(df, facts, dim, pairs.pair_features(df, facts, dim), S)
    assert tuple(matrix.columns[1:28]) == features.FEATURES


def test_large_tender_is_whole(spark):
    n = 400
    df = identity.resolve(bids(spark, [(f"C{i}", "T1", 100.0 + i, None, None) for i in range(n)]))
    facts, dim = graph.bid_facts(df), graph.tender_dim(df)
    assert pairs.cobid_pairs(pairs.pair_rows(facts)).count() == n * (n - 1) // 2
    assert pairs.oversized_tenders(facts, 300).first().bidders == n


@pytest.mark.parametrize(("score", "level"), [(0.0, "LOW"), (24.9, "LOW"), (25.0, "MEDIUM"), (49.9, "MEDIUM"), (50.0, "HIGH"), (74.9, "HIGH"), (75.0, "CRITICAL"), (100.0, "CRITICAL")])
def test_bands(spark, score, level):
    assert one(spark, signals.risk_level, score, "double") == level


@pytest.mark.parametrize(("rule", "prob", "want"), [(1.0, 0.0, 60.0), (0.8, None, 80.0), (5.0, 5.0, 100.0), (-1.0, None, 0.0)])
def test_blend(spark, rule, prob, want):
    df = spark.createDataFrame([(rule, prob)], "r double, m double")
    assert df.select(signals.blended(F.col("r"), F.col("m"), S)).first()[0] == want


def test_wording(spark):
    texts = spark.createDataFrame([("clean text",), ("a Guilty party",), ("guiltyness",)], "t string")
    assert signals.wording_violations(texts, "t").count() == 1


def test_networks(spark):
    e = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 4.0), ("a", "c", 5.0), ("c", "d", 1.0), ("x", "y", 9.0)], "a string, b string, weight double")
    deg = {r.id: r for r in networks.degrees(e).collect()}
    assert deg["c"].neighbours == 3 and deg["c"].degree_centrality == 3 / 5
    clus = {r.id: r.clustering_coefficient for r in networks.clustering(e).collect()}
    assert clus["a"] == 1.0 and abs(clus["c"] - 1 / 3) < 1e-12 and clus["d"] == 0.0
    pr = {r.id: r.pagerank for r in networks.pagerank(e).collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and pr["c"] > pr["d"]
    roots = {r.node: r.root for r in networks.components(e.select("a", "b")).collect()}
    assert roots == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    between = {r.id: r.betweenness for r in networks.betweenness(e).collect()}
    assert between["c"] == 4 / 20 and between["a"] == 0
    groups = rows(networks.dense_groups(e))
    assert groups == [(["a", "b", "c"], 3, 4.0)]
    member = {r.id: r.community for r in networks.communities(e).collect()}
    assert set(member) == {"a", "b", "c", "d", "x", "y"} and member["x"] == member["y"] != member["a"]


def test_entropy(spark):
    member = spark.createDataFrame([(c, 1) for c in "abc"], "company string, community int")
    facts = spark.createDataFrame([(c, f"t{i}") for i in range(6) for c in "abc"], "company string, tender string")
    even = spark.createDataFrame([(f"t{i}", "abc"[i % 3]) for i in range(6)], "tender string, winner string")
    row = networks.cluster_behaviour(member, facts, even).first()
    assert abs(row.entropy - 1) < 1e-12 and row.capture == 1.0 and row.cluster_tenders == 6
    assert networks.cluster_behaviour(member, facts, even.withColumn("winner", F.lit("a"))).first().entropy == 0.0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    m = model.metrics(df, 0.5).first()
    assert (m.true_positive, m.false_positive, m.roc_auc) == (2, 1, 0.75) and abs(m.average_precision - (1 + 2 / 3) / 2) < 1e-12
    assert model.best_threshold(df).first().f1 == 0.8
    parts = rows(model.split(spark.range(400).select(F.col("id").alias("company"), (F.col("id") % 2).cast("int").alias("label"))))
    assert len(parts) == 400 and {p for *_, p in parts} == {"train", "validation", "test"}


def test_portfolio(spark):
    b = spark.createDataFrame([("B-1", "T1", "D1", 100.0), ("B-a", "T1", "D2", 100.0), ("B-0", "T1", "D3", None), ("B-z", "T1", "D3", 0.0)], "bid_id string, tender_id string, bidder_id string, bid_amount double")
    assert portfolio.lowest_bids(b).first().bid_id == "B-1"
    people = spark.createDataFrame([("BID-1", "98", "11"), ("BID-2", "98 ", "22"), ("BID-3", " ", "22"), ("BID-4", "", None)], "bidder_id string, phone string, bank_account string")
    assert sorted(rows(portfolio.registry_edges(people))) == [("BID-1", "BID-2", ["sharedPhone"]), ("BID-2", "BID-3", ["sharedBank"])]
    steps = spark.createDataFrame([("T1", 1, "publish"), ("T1", 2, "remove"), ("T1", 3, "award"), ("T1", 4, "withdraw"), ("T2", 1, "withdraw"), ("T2", 2, "remove")], "tender_id string, seq int, action string")
    assert sorted(rows(portfolio.replay_tenders(steps))) == [("T1", "Awarded", 4), ("T2", "Removed", 2)]
    new = spark.createDataFrame([(" Acme ", 1), ("Zed", 2), ("acme", 3), ("Yen", 4)], "company_name string, seq int")
    old = spark.createDataFrame([("B-7", "ACME")], "bidder_id string, company_name string")
    ids = {r.seq: r.bidder_id for r in portfolio.number_submissions(new, old).collect()}
    assert ids[1] == ids[3] == "B-7" and {ids[2], ids[4]} == {"B-8", "B-9"}
