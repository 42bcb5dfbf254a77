"""Vocabulary and default knobs.  All are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field

EVENT_TYPES = ("legislative_action", "executive_action", "statement", "economic_release", "judicial_action", "poll_release", "campaign_finance_filing", "election_result", "controversy", "nomination", "regulatory_action", "geopolitical")
TOPICS = ("inflation_cost_of_living", "taxation", "trade_tariffs", "immigration", "healthcare", "energy_climate", "labor_jobs", "housing", "monetary_policy", "fiscal_debt", "foreign_policy_defense", "social_abortion", "crime_justice", "tech_ai_regulation", "education", "agriculture")
STANCES = ("strongly_support", "support", "lean_support", "neutral_unclear", "lean_oppose", "oppose", "strongly_oppose")
TIERS = ("T1", "T2", "T3", "T4")
SOURCE_TIER = {"government_primary": "T1", "official_statement": "T1", "data_release": "T1", "press_release": "T2", "poll": "T2", "news": "T3", "social_post": "T4"}
TIER_WEIGHT = {"T1": 1.0, "T2": 0.8, "T3": 0.6, "T4": 0.4}
STATUS_BONUS = {"fact_checked": 1.0, "corroborated": 0.8, "single_source": 0.3, "unverified": 0.0, "contradicted": 0.5}
TYPE_IMPORTANCE = {"Race": 1.0, "Politician": 0.6, "EconomicIndicator": 0.7, "Policy_Bill": 0.5}
EDGE_TYPES = ("SUPPORTS", "OPPOSES", "PROPOSES", "VOTED_FOR", "VOTED_AGAINST", "AFFECTS", "EXPOSED_TO", "LOCATED_IN", "COMPETES_IN", "ENDORSES", "FUNDED_BY", "RESPONDS_TO", "CORRELATES_WITH")
#: Full-match patterns of raw ids by namespace.
ID_FORMATS = {
    "bioguide": r"^[A-Z][0-9]{6}$",
    "fec": r"^([HSP][0-9A-Z]{8}|C[0-9]{8})$",
    "fred": r"^[A-Z0-9_]{1,30}$",
    "fips": r"^[0-9]{2}$",
    "race": r"^[A-Z]{2}-[A-Z]+-[0-9]{4}$",
    "bill": r"^[0-9]{1,3}-(s|hr|sjres|hjres|sconres|hconres|sres|hres)-[0-9]{1,5}$",
}
SERIES_KIND = {"CPIAUCSL": "pct_change", "CPILFESL": "pct_change", "PCEPI": "pct_change", "PCEPILFE": "pct_change", "UNRATE": "rate", "CIVPART": "rate", "PAYEMS": "change_thousands"}
LOOKBACK_DAYS = {"daily": 60, "weekly": 90, "monthly": 180, "quarterly": 400, "annual": 800}
RATER_PRIORITY = ("cook", "inside_elections", "sabato")
#: Rating labels of the raters: those of cards by the order in which headers are searched for them.
CARD_LABELS = {
    "solid democrat": "safe_d",
    "likely democrat": "likely_d",
    "lean democrat": "lean_d",
    "toss up": "tossup",
    "lean republican": "lean_r",
    "likely republican": "likely_r",
    "solid republican": "safe_r",
}
FEED_LABELS = {
    "solid democrat": "safe_d",
    "safe democrat": "safe_d",
    "likely democrat": "likely_d",
    "lean democrat": "lean_d",
    "tilt democrat": "tossup_d",
    "toss-up": "tossup",
    "tilt republican": "tossup_r",
    "lean republican": "lean_r",
    "likely republican": "likely_r",
    "solid republican": "safe_r",
    "safe republican": "safe_r",
}
#: FIPS code, postal code and name of the states.
STATES = (
    ("01", "AL", "Alabama"), ("02", "AK", "Alaska"), ("04", "AZ", "Arizona"), ("05", "AR", "Arkansas"), ("06", "CA", "California"),
    ("08", "CO", "Colorado"), ("09", "CT", "Connecticut"), ("10", "DE", "Delaware"), ("11", "DC", "District of Columbia"), ("12", "FL", "Florida"),
    ("13", "GA", "Georgia"), ("15", "HI", "Hawaii"), ("16", "ID", "Idaho"), ("17", "IL", "Illinois"), ("18", "IN", "Indiana"),
    ("19", "IA", "Iowa"), ("20", "KS", "Kansas"), ("21", "KY", "Kentucky"), ("22", "LA", "Louisiana"), ("23", "ME", "Maine"),
    ("24", "MD", "Maryland"), ("25", "MA", "Massachusetts"), ("26", "MI", "Michigan"), ("27", "MN", "Minnesota"), ("28", "MS", "Mississippi"),
    ("29", "MO", "Missouri"), ("30", "MT", "Montana"), ("31", "NE", "Nebraska"), ("32", "NV", "Nevada"), ("33", "NH", "New Hampshire"),
    ("34", "NJ", "New Jersey"), ("35", "NM", "New Mexico"), ("36", "NY", "New York"), ("37", "NC", "North Carolina"), ("38", "ND", "North Dakota"),
    ("39", "OH", "Ohio"), ("40", "OK", "Oklahoma"), ("41", "OR", "Oregon"), ("42", "PA", "Pennsylvania"), ("44", "RI", "Rhode Island"),
    ("45", "SC", "South Carolina"), ("46", "SD", "South Dakota"), ("47", "TN", "Tennessee"), ("48", "TX", "Texas"), ("49", "UT", "Utah"),
    ("50", "VT", "Vermont"), ("51", "VA", "Virginia"), ("53", "WA", "Washington"), ("54", "WV", "West Virginia"), ("55", "WI", "Wisconsin"),
    ("56", "WY", "Wyoming"),
)
#: Node types that a mention of a type may mean; others mean their own type alone.
SEARCH_TYPES = {
    "Politician": ("Politician", "Candidate"),
    "Candidate": ("Candidate", "Politician"),
    "Committee": ("Committee", "InterestGroup_PAC"),
    "InterestGroup_PAC": ("InterestGroup_PAC", "Committee"),
}
STANCE_HOLDERS = ("Politician", "Candidate", "Party", "Agency")
STRUCTURAL_ROLES = ("author", "sponsor", "voter")
RELEVANT_SOURCES = ("congress", "senate_votes", "fec")
#: Series of the ticker and what is shown of each.
TICKER = {
    "CPIAUCSL": "yoy",
    "CPILFESL": "yoy",
    "PCEPI": "yoy",
    "UNRATE": "level",
    "PAYEMS": "change",
    "DFF": "level",
    "DGS10": "level",
    "T10Y2Y": "level",
}
SOURCE_PREFERENCE = ("fred", "bls")
#: Tags of sources by the end of their host.
HOST_TAGS = {
    "congress.gov": "CNG",
    "stlouisfed.org": "FRED",
    "bls.gov": "BLS",
    "fec.gov": "FEC",
    "x.com": "X",
    "twitter.com": "X",
    "senate.gov": "PR",
    "house.gov": "PR",
    "whitehouse.gov": "WH",
    "cookpolitical.com": "COOK",
    "centerforpolitics.org": "SABATO",
    "insideelections.com": "INSIDE",
    "nytimes.com": "NYT",
}
#: Words that go at the start and the end of a mention.
TITLES = "the honorable|honorable|hon|senator|sen|representative|rep|congressman|congresswoman|dr|mr|mrs|ms|gov|governor"
SUFFIXES = "jr|sr|ii|iii|iv"


@dataclass(frozen=True)
class Knobs:
    """Job parameters."""

    t_high: float = 0.85
    t_low: float = 0.70
    window_hours: int = 48
    min_overlap: int = 1
    knn: int = 10
    tiebreak_confidence: float = 0.6
    related_days: int = 30
    related_sim: float = 0.70
    tolerance_pct: float = 0.05
    tolerance_thousands: float = 5.0
    numeric_penalty: float = 0.5
    stance_confidence: float = 0.6
    review_confidence: float = 0.5
    rating_weight: dict = field(default_factory=lambda: {"tossup": 1.0, "lean": 0.8})
    match_weight: dict = field(default_factory=lambda: {"state": 1.0, "politician": 0.9, "federal": 0.6})
    weights: tuple = (1.0, 0.5, 0.5, 0.5, 0.75)
    half_life_hours: float = 48.0
    election_days: float = 60.0
    default_importance: float = 0.4
    incumbent_importance: float = 1.0
    feed_days: int = 14
    fuzzy_accept: float = 90.0
    fuzzy_margin: float = 8.0
    candidates: int = 5
    max_spans: int = 40
    rsch_events: int = 8
    rsch_sim: float = 0.5
    rsch_records: int = 30
    embed_chars: int = 2000
    regression: float = 0.02


KNOBS = Knobs()
