"""The word lists, ranks, rates and limits of the rules, in their order of meaning."""

from __future__ import annotations

# Categories of search terms.
SEARCH_TERMS = {
    "isin": ["LU0", "LU1", "LU2", "IE00", "IE0", "FR00", "DE00", "GB00", "CH0", "ISIN"],
    "fee": ["management fee", "entry fee", "exit fee", "ongoing charges", "TER", "OCF", "expense ratio"],
    "restriction": ["investment restriction", "may not invest", "shall not", "maximum", "minimum", "limit"],
    "leverage": ["leverage", "borrowing", "VaR", "commitment approach", "gross exposure"],
    "derivative": ["derivative", "hedging", "forward", "swap", "option", "future"],
    "dividend": ["dividend", "distribution", "payment date", "ex-dividend", "record date", "quarterly", "annually", "semi-annual"],
}
# Columns that hold the name of what a row is about.
NAME_COLUMNS = ["Share Class", "Class", "Name", "Fund", "Sub-Fund"]
# Keyword groups of restrictions; the first group that matches wins.
RESTRICTIONS = {
    "concentration_limit": ["single issuer", "issuer", "concentration", "counterparty"],
    "geographic_limit": ["geographic", "country", "region", "eu ", "european", "emerging"],
    "sector_limit": ["sector", "industry"],
    "liquidity_limit": ["liquid", "liquidity"],
    "asset_limit": ["bond", "equity", "debt", "fixed income", "stock"],
}
MAX_WORDS = ["max", "not more than", "no more than", "shall not exceed", "up to"]
MIN_WORDS = ["min", "at least"]
# Word forms of holding periods in days.
PERIODS = [
    ("one month", 30), ("1 month", 30), ("three months", 90), ("3 months", 90), ("six months", 180), ("6 months", 180),
    ("one year", 365), ("1 year", 365),
]
# Reliability of source types.
RELIABILITY = {"toc": 1.0, "table": 0.9, "section": 0.8, "body_text": 0.6, "inferred": 0.4, "unknown": 0.3}
# Placeholder cells and confirming words of referring cells.
PLACEHOLDERS = ["", "-", "n/a", "na", "—", "–"]
REFERRALS = ["see", "refer", "available", "consult"]
# Reasons for which a missing value needs no further work.
BENIGN_REASONS = ["not_in_document", "not_applicable", "in_external_doc", "inherited"]
REASONS = [*BENIGN_REASONS, "extraction_failed"]
# Separators that a normalised name writes as a space.
SEPARATORS = [" - ", " – ", " — ", "-"]
# Constraint types of the schema, and the families of limits.
PREDEFINED = [
    "asset_limit", "concentration_limit", "geographic_limit", "sector_limit", "liquidity_limit", "leverage_limit", "var_limit",
    "duration_limit", "derivative_policy", "derivative_limit", "esg_policy", "exclusion_policy", "hedging_policy",
    "hedging_target", "investor_eligibility", "minimum_investment", "minimum_subsequent", "holding_period",
    "distribution_country",
]
CONSTRAINT_FAMILIES = {
    "investment": ["asset_limit", "concentration_limit", "geographic_limit", "sector_limit", "liquidity_limit"],
    "risk": ["leverage_limit", "var_limit", "duration_limit"],
    "derivative": ["derivative_policy", "derivative_limit"],
}
# Fields that a table's type speaks of; words of references to other documents, their fields and names.
TABLE_FIELDS = [("isin", "isin"), ("fee", "fee"), ("share", "share_class")]
EXTERNAL_WORDS = ["kiid", "key investor", "annual report", "supplement", "www.", "http"]
REFERENCE_FIELDS = [("isin", "isin"), ("fee", "fee"), ("charge", "fee"), ("performance", "performance"), ("risk", "risk_profile")]
EXTERNAL_NAMES = [
    ("kiid", "KIID"), ("key investor", "KIID"), ("annual report", "Annual Report"), ("supplement", "Supplement"),
    ("www.", "Website"), ("http", "Website"),
]
# Headers of a column by which rows are looked up.
LOOKUP_COLUMNS = ["fund name", "sub-fund", "fund", "name", "share class", "class", "class name"]
# Words near which dividend dates and valuation times stand, and the patterns of dates and times.
DIVIDEND_WORDS = ["dividend", "distribution", "payment"]
VALUATION_WORDS = ["valuation point", "valuation time", "nav calculation", "pricing"]
DATES = [
    r"\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
    r"(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}",
    r"\d{1,2}/\d{1,2}",
]
TIME = r"(\d{1,2}[:.]\d{2})\s*(?:a\.?m\.?|p\.?m\.?|CET|GMT|UTC|hours)?"
# Words for documents outside the one at hand and what each stands for, in the order in which they count.
EXTERNAL_DOCUMENTS = [
    ("kiid", "KIID"), ("kid", "KIID"), ("key investor information", "KIID"), ("key investor document", "KIID"),
    ("key information document", "KIID"), ("priips", "KIID"),
    ("annual report", "Annual Report"), ("semi-annual report", "Annual Report"), ("semi annual report", "Annual Report"),
    ("audited accounts", "Annual Report"),
    ("factsheet", "Factsheet"), ("fund factsheet", "Factsheet"), ("fact sheet", "Factsheet"), ("monthly report", "Factsheet"),
    ("supplement", "Supplement"), ("addendum", "Supplement"), ("prospectus", "Prospectus"), ("master prospectus", "Prospectus"),
    ("base prospectus", "Prospectus"), ("term sheet", "TermSheet"), ("terms and conditions", "TermSheet"),
    ("sfdr", "SFDR"), ("art. 6", "SFDR"), ("art. 8", "SFDR"), ("art. 9", "SFDR"), ("article 6", "SFDR"), ("article 8", "SFDR"),
    ("article 9", "SFDR"), ("sustainability disclosure", "SFDR"), ("pre-contractual disclosure", "SFDR"),
    ("website", "Website"), ("www.", "Website"), ("http", "Website"), ("investor portal", "Website"), ("client portal", "Website"),
    ("fund centre", "Website"), ("fund center", "Website"),
    ("upon request", "Upon Request"), ("on request", "Upon Request"), ("not disclosed", "Not Disclosed"),
    ("not available", "Not Disclosed"), ("contact the administrator", "Upon Request"),
    ("contact the management company", "Upon Request"),
]
# Phrases that refer a reader elsewhere.
REFERRAL_PHRASES = [
    "see", "refer to", "refer", "available in", "available at", "available on", "found in", "consult", "published in",
    "disclosed in", "contained in", "detailed in", "set out in", "specified in", "listed in", "shown in", "please contact",
    "contact", "upon request", "on request", "not included", "not disclosed", "not available", "not shown", "please see",
    "please refer", "kindly refer", "readers should refer", "appendix", "annex", "schedule", "exhibit", "full details",
    "further information", "more information", "additional information", "available from", "provided by", "obtainable from",
    "can be obtained", "separately disclosed", "published separately", "disclosed separately", "investors should consult",
    "shareholders should refer",
]
# Words by which a sentence speaks of a field.
FIELD_WORDS = {
    "isin": ["isin", "isin code", "isin codes", "identifier", "identifiers"],
    "performance": ["performance", "past performance", "historical performance", "returns", "track record"],
    "ongoing_charges": ["ongoing charge", "ongoing charges", "ter", "total expense ratio", "ocf", "ongoing cost"],
    "management_fee": ["management fee", "management fees", "annual management charge", "amc"],
    "entry_fee": ["entry fee", "entry charge", "subscription fee", "initial charge"],
    "exit_fee": ["exit fee", "exit charge", "redemption fee", "redemption charge"],
    "risk_profile": ["risk profile", "risk indicator", "risk level", "srri", "risk rating", "risk category"],
    "distribution_policy": ["distribution", "dividend", "income distribution"],
    "benchmark": ["benchmark", "index", "reference index", "comparator", "performance comparator"],
    "nav": ["nav", "net asset value", "nav per share", "unit price", "share price"],
    "minimum_investment": ["minimum investment", "minimum subscription", "minimum initial", "investment minimum"],
    "fund_size": ["fund size", "aum", "assets under management", "total assets", "net assets"],
    "inception_date": ["inception", "launch date", "commencement date", "fund launch"],
    "dealing_frequency": ["dealing", "valuation day", "dealing day", "subscription day", "redemption day"],
    "volatility": ["volatility", "standard deviation", "sharpe ratio", "risk metrics"],
}
