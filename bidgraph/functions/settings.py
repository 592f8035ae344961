"""Thresholds, weights and fixed word lists; every job takes ``Settings`` as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds and weights of the signals.
WEIGHTS = {
    "SHARED_DIRECTORS": 1.00,
    "SHARED_ADDRESS": 0.85,
    "REPEATED_CO_BIDDING": 0.95,
    "BID_PRICE_SIMILARITY": 1.00,
    "DUPLICATE_BID_DOCUMENTS": 1.20,
    "COVER_BID_PATTERN": 0.90,
    "WINNER_ROTATION": 1.00,
    "MARKET_CONCENTRATION": 0.60,
    "HIGH_CENTRALITY": 0.40,
    "DENSE_SUBGROUP": 0.70,
    "UNCONTESTED_AWARDS": 0.55,
}


@dataclass(frozen=True)
class Settings:
    min_shared_directors: int = 1
    min_shared_address_peers: int = 1
    min_cobid_events: int = 3
    high_cobid_ratio: float = 0.60
    bid_similarity_pct: float = 0.03
    cover_low: float = 0.01
    cover_high: float = 0.12
    min_rotation_tenders: int = 4
    rotation_entropy_min: float = 0.70
    max_cluster_win_concentration: float = 0.85
    high_degree_percentile: float = 0.95
    min_community_size: int = 3
    rule_weight: float = 0.6
    model_weight: float = 0.4
    alert_threshold: float = 50.0
    max_entities: int = 50
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))


# Result words, column aliases, legal suffixes, titles and address abbreviations.
WIN_TOKENS = ("win", "won", "winner", "awarded", "award", "success", "1", "true", "yes")
LOSS_TOKENS = ("lose", "lost", "loser", "rejected", "unsuccessful", "0", "false", "no")
POSITIVE_LABELS = ("1", "1.0", "true", "yes", "flagged", "positive")
NEGATIVE_LABELS = ("0", "0.0", "false", "no", "cleared", "negative")
COLUMN_ALIASES = {
    "companyid": "company_id",
    "company": "company_name",
    "companyname": "company_name",
    "vendor_id": "company_id",
    "vendor_name": "company_name",
    "bidder_id": "company_id",
    "bidder_name": "company_name",
    "personid": "person_id",
    "director_id": "person_id",
    "director_name": "person_name",
    "personname": "person_name",
    "tenderid": "tender_id",
    "contract_id": "tender_id",
    "departmentid": "department_id",
    "dept_id": "department_id",
    "buyer_id": "department_id",
    "registered_address": "address",
    "company_address": "address",
    "bid": "bid_amount",
    "bid_value": "bid_amount",
    "amount": "bid_amount",
    "estimated_value": "tender_value",
    "tendervalue": "tender_value",
    "date": "bid_date",
    "biddate": "bid_date",
    "outcome": "result",
    "status": "result",
}
LEGAL_SUFFIXES = (
    "pvt", "private", "ltd", "limited", "llp", "llc", "inc", "incorporated", "corp", "corporation",
    "co", "company", "plc", "gmbh", "sa", "sarl", "bv", "and", "the",
)
PERSON_TITLES = ("mr", "mrs", "ms", "dr", "shri", "smt", "sri", "prof", "er")
ADDRESS_ABBREVIATIONS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "blvd": "boulevard",
    "ln": "lane", "dr": "drive", "sq": "square", "apt": "apartment", "flr": "floor", "fl": "floor",
    "bldg": "building", "blk": "block", "no": "number", "opp": "opposite", "nr": "near", "ind": "industrial",
    "estt": "estate", "sec": "sector", "ph": "phase", "plt": "plot",
}
PROHIBITED_TERMS = ("fraudulent", "fraudster", "guilty", "criminal", "convicted", "proven collusion", "confirmed cartel")
RISK_LANGUAGE = {
    "LOW": "low risk",
    "MEDIUM": "medium risk - monitor",
    "HIGH": "high risk - review recommended",
    "CRITICAL": "high risk - priority review recommended",
}
# What to do about each signal.
RECOMMENDED_ACTIONS = {
    "SHARED_DIRECTORS": "Pull corporate registry filings for the named officers.",
    "SHARED_ADDRESS": "Verify the registered premises and tenancy records.",
    "REPEATED_CO_BIDDING": "Compare bid documents for shared formatting or metadata.",
    "BID_PRICE_SIMILARITY": "Request the underlying cost breakdowns for both bidders.",
    "COVER_BID_PATTERN": "Review the losing bids for token or non-responsive content.",
    "WINNER_ROTATION": "Chart award history across the group and check capacity claims.",
    "MARKET_CONCENTRATION": "Interview the procuring department on supplier selection.",
    "HIGH_CENTRALITY": "Map the entity's full relationship network before prioritising.",
    "DENSE_SUBGROUP": "Treat the cluster as one case file rather than separate entities.",
    "UNCONTESTED_AWARDS": "Check whether tender specifications were unduly restrictive.",
    "TIGHT_BID_CLUSTER": "Compare unit rates line by line across the received bids.",
    "UNIFORM_LOSING_MARGINS": "Examine whether losing bids were prepared independently.",
    "SINGLE_BIDDER": "Review publication reach and qualification criteria.",
    "NO_PRICE_PRESSURE": "Benchmark the award price against comparable contracts.",
}
# Display codes and labels of the signals.
SIGNAL_META = {
    "SHARED_DIRECTORS": ("sharedDirector", "Shared Director"),
    "SHARED_ADDRESS": ("sharedAddress", "Shared Address"),
    "REPEATED_CO_BIDDING": ("repeatedCoBidding", "Repeated Co-Bidding"),
    "BID_PRICE_SIMILARITY": ("bidPriceSimilarity", "Bid Price Similarity"),
    "DUPLICATE_BID_DOCUMENTS": ("duplicateBidDocuments", "Identical Bid Documents"),
    "COVER_BID_PATTERN": ("coverBidPattern", "Cover Bid Pattern"),
    "WINNER_ROTATION": ("winnerRotation", "Winner Rotation"),
    "MARKET_CONCENTRATION": ("marketConcentration", "Market Concentration"),
    "HIGH_CENTRALITY": ("highCentrality", "High Network Centrality"),
    "DENSE_SUBGROUP": ("denseSubgroup", "Dense Bidding Subgroup"),
    "UNCONTESTED_AWARDS": ("uncontestedAwards", "Uncontested Awards"),
    "sharedPhone": ("sharedPhone", "Shared Phone Number"),
    "sharedBank": ("sharedBank", "Shared Bank Account"),
}
