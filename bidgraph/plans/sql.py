"""SQL of the derived tables, as parts of one WITH clause that the oracles share."""

from __future__ import annotations

from bidgraph.functions.settings import ADDRESS_ABBREVIATIONS, LEGAL_SUFFIXES, PERSON_TITLES
from bidgraph.sources.market import CTE as MARKET

CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[.’'']', '', 'g'), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "list_filter(string_split({0}, ' '), lambda t: t <> '')"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def company_key(cleaned: str) -> str:
    kept = f"array_to_string(list_filter(string_split({cleaned}, ' '), lambda t: t <> '' AND t NOT IN ({_in(LEGAL_SUFFIXES)})), ' ')"
    return f"CASE WHEN {kept} <> '' THEN {kept} ELSE {cleaned} END"


def person_key(cleaned: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({cleaned}, ' '), lambda t: t <> '' AND t NOT IN ({_in(PERSON_TITLES)}))), ' ')"


def address_key(cleaned: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ADDRESS_ABBREVIATIONS.items()) + "}"
    return f"array_to_string(list_sort(list_transform({_WORDS.format(cleaned)}, lambda t: coalesce({table}[t], t))), ' ')"


def _kind(kind: str, raw: str, name: str, prefix: str, key) -> dict[str, str]:
    return {
        f"{kind}_spelt": f"SELECT {raw} AS raw, {name} AS name, min(row_seq) AS f, max(row_seq) AS l, {CLEAN.format(name)} AS cleaned FROM bids GROUP BY {raw}, {name}",
        f"{kind}_obs": f"SELECT raw, '{prefix}_' || substr(sha1({key('cleaned')}), 1, 12) AS canonical, trim(name) AS display, f, l FROM {kind}_spelt",
        f"{kind}_map": f"SELECT raw, arg_max(canonical, l) AS canonical FROM {kind}_obs GROUP BY raw",
        f"{kind}_first": f"SELECT canonical, raw, min(f) AS seq, arg_min(display, f) AS display FROM {kind}_obs GROUP BY canonical, raw",
        f"{kind}_entity": f"SELECT canonical, arg_min(display, seq) AS display, list(raw ORDER BY seq) AS aliases FROM {kind}_first GROUP BY canonical",
    }


CTE: dict[str, str] = {
    **MARKET,
    **_kind("company", "company_id", "company_name", "C", company_key),
    **_kind("person", "person_id", "person_name", "P", person_key),
    **_kind("department", "department_id", "department_name", "D", company_key),
    **_kind("address", "address", "address", "A", address_key),
    "resolved": """
      SELECT b.*, c.canonical AS company, p.canonical AS person, d.canonical AS department, a.canonical AS addr, 'T_' || tender_id AS tender, result = 'Awarded' AS won
      FROM bids b LEFT JOIN company_map c ON b.company_id = c.raw LEFT JOIN person_map p ON b.person_id = p.raw
        LEFT JOIN department_map d ON b.department_id = d.raw LEFT JOIN address_map a ON b.address = a.raw""",
    "facts": """
      SELECT company, tender, min(bid_amount) AS bid_amount, bool_or(won) AS is_winner, arg_min(tender_value, row_seq) AS tender_value,
        arg_min(bid_date, row_seq) AS bid_date, arg_min(result, row_seq) AS result FROM resolved GROUP BY company, tender""",
    "dim": """
      SELECT tender, arg_max(company, row_seq) FILTER (WHERE won) AS winner, arg_max(department, row_seq) AS department,
        arg_max(tender_value, row_seq) AS tender_value, min(row_seq) AS tender_seq FROM resolved GROUP BY tender""",
    "pair_rows": """
      SELECT a.tender, d.winner, d.tender_seq, a.company AS company_a, b.company AS company_b,
        abs(a.bid_amount - b.bid_amount) / greatest(abs(a.bid_amount), abs(b.bid_amount)) AS gap
      FROM facts a JOIN facts b ON a.tender = b.tender AND a.company < b.company JOIN dim d ON a.tender = d.tender""",
    "cobid": "SELECT company_a, company_b, count(*) AS shared_tenders, avg(gap) AS mean_price_gap FROM pair_rows GROUP BY company_a, company_b",
    "won_rows": "SELECT *, lag(winner) OVER (PARTITION BY company_a, company_b ORDER BY tender_seq) AS prev FROM pair_rows WHERE winner IN (company_a, company_b)",
    "alternating": "SELECT company_a, company_b, count(*) FILTER (WHERE prev <> winner) AS alternating_wins FROM won_rows GROUP BY company_a, company_b",
    "person_of": "SELECT DISTINCT person AS attr, company FROM resolved",
    "address_of": "SELECT DISTINCT addr AS attr, company FROM resolved",
    "person_pairs": "SELECT a.company AS a, b.company AS b, count(*) AS shared FROM person_of a JOIN person_of b ON a.attr = b.attr AND a.company < b.company GROUP BY 1, 2",
    "address_pairs": "SELECT a.company AS a, b.company AS b, count(*) AS shared FROM address_of a JOIN address_of b ON a.attr = b.attr AND a.company < b.company GROUP BY 1, 2",
    "n_of": "SELECT company, count(*) AS n FROM facts GROUP BY company",
    "community": "SELECT company, arg_min(supplier % 25, row_seq) AS community FROM resolved GROUP BY company",
    "documents_of": """
      SELECT DISTINCT f.company, f.tender, sha256(coalesce(d.text, '')) AS hash FROM resolved f
        JOIN (SELECT doc_id, text, count(*) OVER () AS n FROM documents) d ON (f.row_seq.l_orderkey * 31 + f.supplier) % d.n = d.doc_id""",
    "document_pairs": """
      SELECT a.company AS a, b.company AS b, count(DISTINCT a.hash) AS shared FROM documents_of a
        JOIN documents_of b ON a.tender = b.tender AND a.hash = b.hash AND a.company < b.company GROUP BY 1, 2""",
    "pairs": """
      SELECT p.company_a, p.company_b, p.shared_tenders, p.shared_tenders / greatest(1, least(na.n, nb.n)) AS cobid_ratio, p.mean_price_gap,
        coalesce(alternating_wins, 0) AS alternating_wins, coalesce(pp.shared, 0) AS shared_directors, coalesce(ap.shared, 0) AS shared_addresses,
        coalesce(dp.shared, 0) AS shared_document_hashes, coalesce(ca.community = cb.community, false) AS same_community
      FROM cobid p LEFT JOIN alternating w USING (company_a, company_b) JOIN n_of na ON na.company = company_a JOIN n_of nb ON nb.company = company_b
        LEFT JOIN person_pairs pp ON pp.a = company_a AND pp.b = company_b LEFT JOIN address_pairs ap ON ap.a = company_a AND ap.b = company_b
        LEFT JOIN document_pairs dp ON dp.a = company_a AND dp.b = company_b
        LEFT JOIN community ca ON ca.company = company_a LEFT JOIN community cb ON cb.company = company_b""",
    "edges": """
      SELECT DISTINCT company AS src, tender AS dst, 'BIDS_IN' AS edge_type, 1.0::DOUBLE AS weight FROM resolved
      UNION ALL SELECT DISTINCT company, tender, 'WINS', 1.0::DOUBLE FROM resolved WHERE won
      UNION ALL SELECT attr, company, 'DIRECTOR_OF', 1.0::DOUBLE FROM person_of
      UNION ALL SELECT attr, company, 'OWNS', 1.0::DOUBLE FROM person_of WHERE attr IN (SELECT attr FROM person_of GROUP BY attr HAVING count(*) > 1)
      UNION ALL SELECT company, attr, 'REGISTERED_AT', 1.0::DOUBLE FROM address_of
      UNION ALL SELECT DISTINCT tender, department, 'ISSUED_BY', 1.0::DOUBLE FROM resolved
      UNION ALL SELECT company_a, company_b, 'CO_BID', shared_tenders::DOUBLE FROM cobid""",
    "nodes": """
      SELECT DISTINCT tender AS id, 'Tender' AS node_type, tender_id AS display FROM resolved
      UNION ALL SELECT canonical, 'Company', display FROM company_entity WHERE canonical IN (SELECT company FROM resolved)
      UNION ALL SELECT canonical, 'Person', display FROM person_entity WHERE canonical IN (SELECT person FROM resolved)
      UNION ALL SELECT canonical, 'Department', display FROM department_entity WHERE canonical IN (SELECT department FROM resolved)
      UNION ALL SELECT canonical, 'Address', display FROM address_entity WHERE canonical IN (SELECT addr FROM resolved)""",
    "undirected": "SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight) AS weight FROM edges GROUP BY 1, 2",
    "projection": """
      SELECT a, b, sum(w) AS weight FROM (SELECT company_a AS a, company_b AS b, shared_tenders * 1.0 AS w FROM cobid
        UNION ALL SELECT a, b, shared * 2.0 FROM person_pairs UNION ALL SELECT a, b, shared * 1.5 FROM address_pairs) GROUP BY a, b""",
    "tender_base": """
      SELECT f.tender, count(f.company) AS n_bidders, min(bid_amount) AS min_bid, max(bid_amount) AS max_bid, count(bid_amount) AS n_amounts,
        max(bid_amount) FILTER (WHERE company = winner) AS winning_bid, any_value(d.tender_value) AS tender_value, any_value(winner) AS winner, any_value(department) AS department
      FROM facts f JOIN dim d ON f.tender = d.tender GROUP BY f.tender""",
    "losing": """
      SELECT f.tender, avg((bid_amount - winning_bid) / winning_bid) AS mean_losing_margin, stddev_pop((bid_amount - winning_bid) / winning_bid) AS losing_margin_std
      FROM facts f JOIN tender_base t ON f.tender = t.tender WHERE winning_bid > 0 AND bid_amount > winning_bid GROUP BY f.tender""",
    "tender_features": """
      SELECT t.tender, n_bidders, CASE WHEN n_amounts >= 2 THEN (max_bid - min_bid) / max_bid END AS bid_spread, min_bid, max_bid, winning_bid, tender_value,
        (winning_bid - tender_value) / nullif(tender_value, 0) AS winning_margin_vs_estimate, mean_losing_margin, losing_margin_std, n_bidders <= 1 AS single_bidder, department, winner
      FROM tender_base t LEFT JOIN losing l ON t.tender = l.tender""",
    "bid_features": """
      SELECT company, count(*) AS n_tenders, count(*) FILTER (WHERE company = winner) AS n_wins,
        count(*) FILTER (WHERE company <> winner) AS n_lost,
        count(*) FILTER (WHERE company <> winner AND (bid_amount - winning_bid) / winning_bid BETWEEN 0.01 AND 0.12) AS n_cover,
        count(*) FILTER (WHERE company = winner AND n_bidders <= 1) AS solo_wins, avg(bid_amount / nullif(t.tender_value, 0)) AS bid_to_estimate_ratio,
        stddev_pop(bid_amount / nullif(t.tender_value, 0)) AS bid_ratio_std
      FROM facts f JOIN tender_base t ON f.tender = t.tender GROUP BY company""",
    "pair_ends": "SELECT company_a AS company, company_b AS peer, * EXCLUDE (company_a, company_b) FROM pairs UNION ALL SELECT company_b, company_a, * EXCLUDE (company_a, company_b) FROM pairs",
    "pair_summary": """
      SELECT company, count(*) AS cobid_partners, max(shared_tenders) AS max_cobid_count, avg(shared_tenders) AS mean_cobid_weight,
        min(mean_price_gap) FILTER (WHERE shared_tenders >= 3) AS min_gap, avg(mean_price_gap) FILTER (WHERE shared_tenders >= 3) AS mean_gap,
        count(*) FILTER (WHERE shared_document_hashes > 0) AS document_peers FROM pair_ends GROUP BY company""",
    "person_peers": "SELECT company, count(*) AS peers, max(shared) AS max_shared FROM (SELECT a AS company, shared FROM person_pairs UNION ALL SELECT b, shared FROM person_pairs) GROUP BY company",
    "address_peers": "SELECT company, count(*) AS peers FROM (SELECT a AS company FROM address_pairs UNION ALL SELECT b FROM address_pairs) GROUP BY company",
    "dept": "SELECT company, max(n) / sum(n) AS department_concentration FROM (SELECT company, department, count(*) AS n FROM facts JOIN dim USING (tender) GROUP BY company, department) GROUP BY company",
    "features": """
      SELECT f.company, n_tenders, n_wins, n_wins / n_tenders AS win_rate, coalesce(pp.peers, 0) AS shared_director_peers, coalesce(pp.max_shared, 0) AS max_shared_directors,
        coalesce(ap.peers, 0) AS shared_address_peers, coalesce(cobid_partners, 0) AS cobid_partners, coalesce(max_cobid_count, 0) AS max_cobid_count,
        coalesce(max_cobid_count / n_tenders, 0) AS top_partner_ratio, coalesce(mean_cobid_weight, 0) AS mean_cobid_weight, coalesce(min_gap, 1.0) AS min_pair_price_gap,
        coalesce(mean_gap, 1.0) AS mean_pair_price_gap, CASE WHEN n_lost > 0 THEN n_cover / n_lost ELSE 0 END AS complementary_bid_ratio,
        coalesce(bid_to_estimate_ratio, 0) AS bid_to_estimate_ratio, coalesce(bid_ratio_std, 0) AS bid_ratio_std, coalesce(department_concentration, 0) AS department_concentration,
        solo_wins, coalesce(document_peers, 0) AS document_peers
      FROM bid_features f LEFT JOIN pair_summary s USING (company) LEFT JOIN person_peers pp USING (company) LEFT JOIN address_peers ap USING (company) LEFT JOIN dept USING (company)""",
    "company_fired": """
      SELECT company, 'SHARED_DIRECTORS' AS code, least(1, greatest(0, (shared_director_peers - 1) / 3)) * 0.6 + 0.4 AS severity, 1.0 AS weight FROM features WHERE shared_director_peers >= 1
      UNION ALL SELECT company, 'SHARED_ADDRESS', least(1, greatest(0, (shared_address_peers - 1) / 3)) * 0.6 + 0.4, 0.85 FROM features WHERE shared_address_peers >= 1
      UNION ALL SELECT company, 'REPEATED_CO_BIDDING', least(1, greatest(0, (top_partner_ratio - 0.6) / 0.4)) * 0.6 + 0.4, 0.95 FROM features WHERE max_cobid_count >= 3 AND top_partner_ratio >= 0.6
      UNION ALL SELECT company, 'BID_PRICE_SIMILARITY', least(1, greatest(0.4, 1 - min_pair_price_gap / 0.03 * 0.6)), 1.0 FROM features WHERE min_pair_price_gap <= 0.03
      UNION ALL SELECT company, 'DUPLICATE_BID_DOCUMENTS', 1.0, 1.2 FROM features WHERE document_peers > 0
      UNION ALL SELECT company, 'COVER_BID_PATTERN', least(1, greatest(0, (complementary_bid_ratio - 0.6) / 0.4)) * 0.6 + 0.4, 0.9 FROM features WHERE complementary_bid_ratio >= 0.6 AND n_tenders >= 3
      UNION ALL SELECT company, 'MARKET_CONCENTRATION', least(1, department_concentration), 0.6 FROM features WHERE department_concentration >= 0.9 AND n_tenders >= 3
      UNION ALL SELECT company, 'UNCONTESTED_AWARDS', least(1, 0.4 + solo_wins / n_tenders), 0.55 FROM features WHERE solo_wins >= 2""",
    "scores": """
      SELECT company, coalesce(rule_score, 0) AS rule_score, round(least(1, coalesce(rule_score, 0)) * 100, 2) AS risk_score, coalesce(codes, []) AS codes FROM features
        LEFT JOIN (SELECT company, sum(severity * weight) / 9.15 AS rule_score, list(code ORDER BY code) AS codes FROM company_fired GROUP BY company) USING (company)""",
    "tender_fired": """
      SELECT tender, 'TIGHT_BID_CLUSTER' AS code, least(1, 1 - bid_spread / 0.06) AS severity FROM tender_features WHERE n_bidders > 1 AND bid_spread <= 0.06
      UNION ALL SELECT tender, 'UNIFORM_LOSING_MARGINS', 0.8 FROM tender_features WHERE mean_losing_margin BETWEEN 0.01 AND 0.12 AND losing_margin_std < 0.03
      UNION ALL SELECT tender, 'SINGLE_BIDDER', 0.6 FROM tender_features WHERE single_bidder
      UNION ALL SELECT tender, 'NO_PRICE_PRESSURE', 0.5 FROM tender_features WHERE winning_margin_vs_estimate > -0.02""",
    "relations": """
      SELECT *, least(1, CASE WHEN shared_directors > 0 THEN 0.35 ELSE 0 END + CASE WHEN shared_addresses > 0 THEN 0.25 ELSE 0 END
        + CASE WHEN shared_tenders >= 3 THEN 0.2 + least(0.15, 0.02 * shared_tenders) ELSE 0 END
        + CASE WHEN mean_price_gap <= 0.03 AND shared_tenders >= 3 THEN 0.3 ELSE 0 END + CASE WHEN shared_document_hashes > 0 THEN 0.45 ELSE 0 END
        + CASE WHEN alternating_wins >= 3 THEN 0.2 ELSE 0 END) AS risk,
        shared_directors > 0 OR shared_addresses > 0 OR shared_tenders >= 3 OR shared_document_hashes > 0 OR alternating_wins >= 3 AS reasoned FROM pairs""",
}


#: Parts that refer to themselves.
RECURSIVE = {"registry_reach"}


def with_tables(final: str) -> str:
    """``final`` after a WITH clause of the parts that it uses, directly or through others."""
    import re

    used: set[str] = set()

    def visit(text: str) -> None:
        for name in CTE:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(CTE[name])

    visit(final)
    parts = [f"{name} AS ({body.strip()})" for name, body in CTE.items() if name in used]
    final = final.strip()
    if parts and final.startswith("WITH ") and not final.startswith("WITH RECURSIVE "):
        return "WITH " + ",\n".join([*parts, final.removeprefix("WITH ")])
    if used & RECURSIVE and not final.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final
    if final.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*parts, final.removeprefix("WITH RECURSIVE ")])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + final
