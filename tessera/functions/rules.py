"""Fixed values that results depend on: word lists, patterns, weights and per-country rules. Only data, plainly listed."""

from __future__ import annotations

from dataclasses import dataclass, field

# Company names.
LEGAL_SUFFIXES = [
    "LTD", "LIMITED", "INC", "INCORPORATED", "CORP", "CORPORATION", "GMBH", "AG", "SA", "SE", "NV", "BV", "PLC", "LLC", "LP", "LLP",
    r"SDN\s*BHD", "BERHAD", "BHD", "PTE", "PTY", "CO", "COMPANY", "GROUP", "HOLDINGS", "HOLDING", r"S\s*A", r"S\s*R\s*L", "SPA", "OYJ",
    "ASA", "AB", "KK", "AKTIENGESELLSCHAFT", r"SOCIETE\s*DES\s*PRODUITS",
]
MIN_BRAND_LENGTH = 4
GENERIC_WORDS = [
    "ASIA", "ASIA PACIFIC", "PACIFIC", "GLOBAL", "INTERNATIONAL", "MALAYSIA", "SINGAPORE", "INDONESIA", "THAILAND", "PHILIPPINES",
    "VIETNAM", "CAMBODIA", "LAOS", "MYANMAR", "BRUNEI", "BURMA", "SERVICE", "SERVICES", "CAPITAL", "FINANCIAL", "FINANCE",
    "INVESTMENT", "INVESTMENTS", "MANAGEMENT", "MANAGER", "MANAGERS", "TRADING", "TRADE", "TECHNOLOGY", "TECHNOLOGIES", "TECH",
    "ENERGY", "POWER", "PROPERTY", "PROPERTIES", "DEVELOPMENT", "DEVELOPMENTS", "SOLUTION", "SOLUTIONS", "INDUSTRY", "INDUSTRIES",
    "RESOURCE", "RESOURCES", "VENTURE", "VENTURES", "PARTNER", "PARTNERS", "PARTNERSHIP", "BANK", "BANKING", "CITY", "URBAN",
    "FUND", "FUNDS", "TRUST", "TRUSTS", "EQUITY", "EQUITIES", "ASSET", "ASSETS", "ADVISOR", "ADVISORS", "ADVISERS", "PORTFOLIO",
    "PORTFOLIOS", "GROWTH", "INCOME", "VALUE", "HOLDING", "HOLDINGS", "ENTERPRISE", "ENTERPRISES", "CORPORATE",
]
MISSING_BRAND_PENALTY = 15

# Registry names.
REGISTRY_REPLACEMENTS = [
    (r"\bSDN\s+BHD\b", "SDN BHD"), (r"\bSENDIRIAN\s+BERHAD\b", "SDN BHD"), (r"\bBHD\b", "BHD"), (r"\bBERHAD\b", "BHD"),
    (r"\bPTE\s+LTD\b", "PTE LTD"), (r"\bPRIVATE\s+LIMITED\b", "PTE LTD"), (r"\bLIMITED\b", "LTD"), (r"\bCOMPANY\b", "CO"),
]
REGISTRY_GENERIC = ["SDN", "BHD", "BERHAD", "SENDIRIAN", "LTD", "LIMITED", "PTE", "CO", "COMPANY", "CORPORATION", "CORP", "GROUP", "HOLDING", "HOLDINGS", "M", "MALAYSIA", "ASIA", "GLOBAL", "INTERNATIONAL"]
REGISTRY_WEAK = [
    "AGRIBUSINESS", "ASSET", "BANK", "CAPITAL", "CENTRE", "CONSULTANTS", "DEVELOPMENT", "DORMITORY", "ENGINEERING", "ENTERPRISE", "FOOD",
    "FRESH", "GUARD", "HEALTHCARE", "HOLIDAY", "INDUSTRIES", "INDUSTRY", "INVESTMENT", "LAND", "MANAGEMENT", "MANUFACTURING", "MEDICAL",
    "MINERALS", "RESOURCES", "SECURITY", "SERVICES", "SOLUTIONS", "SYSTEMS", "TECH", "TECHNOLOGIES", "TECHNOLOGY", "TOURS", "TRADING",
    "TRAINING", "TRAVEL", "VENTURES", "WEALTH",
]
REGISTRY_FIRST_TOKEN_RATIO = 92
REGISTRY_LINK = "/single-report/malaysia-company/"

# Kinds of entity.
NOMINEE_MARKERS = [" NOMINEE", "NOMINEES", " CUSTODIAN", "TRUSTEE"]
FUND_MARKERS = [
    " FUND", " FUNDS", " PORTFOLIO", " PRS ", " MONEY MARKET", " BOND", " SUKUK", " EQUITY", " EQUITIES", " INCOME", " BALANCED", " ETF",
    " AMANAH SAHAM", " UNIT TRUST", " WHOLESALE", " MULTI ASSET", " MIXED ASSET", " ASIA EQUITIES", " GLOBAL TACTICAL", " SHARIAH ", " DANA ",
]
FUND_PREFIXES = ["ASN ", "ASB ", "ASM ", "AMGLOBAL ", "AMDYNAMIC ", "AMCIO SERIES"]

# Coverage score, in the order they are added up.
SCORE_WEIGHTS = [("size_scaled", 0.25), ("appears_in_edgar", 0.15), ("foreign_parent", 0.15), ("has_inferred_parent", 0.10), ("in_address_cluster", 0.05), ("is_non_consolidating", 0.05)]
MISSING_WEIGHTS = [("has_parent_link", 0.15), ("has_ultimate_link", 0.10)]
LARGE_SIZE = 0.6
REASONS = [
    ("appears_in_edgar", 1, "us_filing_presence"), ("foreign_parent", 1, "foreign_parent_signal"), ("has_inferred_parent", 1, "inferred_parent_match"),
    ("in_address_cluster", 1, "shared_address_cluster"), ("is_non_consolidating", 1, "non_consolidating_entity"),
    ("has_parent_link", 0, "missing_direct_parent"), ("has_ultimate_link", 0, "missing_ultimate_parent"),
]

# Review queue.
SOURCE_PENALTY = {
    "unassigned": 0.25, "reporting_exception_no_country": 0.20, "phase3_jurisdiction_model": 0.18, "phase2_address_cluster": 0.12,
    "phase1_name_match": 0.08, "gleif_direct_parent": 0.03, "gleif_ultimate_parent": 0.0, "manual_verified": 0.0,
}
OTHER_PENALTY, REGISTRY_BONUS, FUND_DISCOUNT, NOMINEE_DISCOUNT, HIGH_GAP, REVIEW_LIMIT = 0.10, 0.02, 0.20, 0.12, 0.4, 500
SOURCE_REASONS = {
    "phase3_jurisdiction_model": "validate_model_only_investor_economy", "phase2_address_cluster": "verify_address_cluster_parent",
    "phase1_name_match": "verify_name_matched_parent", "reporting_exception_no_country": "review_non_consolidating_no_uie",
    "unassigned": "find_parent_or_investor_economy",
}
WEAK_SOURCES = ["unassigned", "reporting_exception_no_country", "phase3_jurisdiction_model", "phase2_address_cluster", "phase1_name_match"]
KNOWN_SOURCES = ["manual_verified", "gleif_ultimate_parent", "gleif_upstream_ultimate_parent", "gleif_direct_parent", "gleif_upstream_direct_parent"]
INFERRED_SOURCES = ["phase1_name_match", "phase2_address_cluster", "phase3_jurisdiction_model"]

# Regions of rare countries. JE stands twice in the published list; the later entry, OFFSHORE, holds.
MIN_COUNTRY_SAMPLES = 15
REGIONS = {
    "EUROPE": ["DE", "GB", "FR", "NL", "CH", "SE", "DK", "IT", "IE", "BE", "AT", "ES", "NO", "FI", "LU", "GG"],
    "ASIA_OTHER": ["IN", "HK", "KR", "TW", "TH", "PH", "ID", "VN", "BD", "NZ", "AU"],
    "MIDEAST_AFRICA": ["AE", "SA", "KW", "QA", "BH", "DJ", "ZA"],
    "AMERICAS_OTHER": ["CA", "BR", "MX"],
    "OFFSHORE": ["KY", "BM", "VG", "MU", "JE"],
}

# Position data.
POSITION_ENTRY = {"Inward": "Net (liabilities less assets)", "Outward": "Net (assets less liabilities)"}
POSITION_ENTITY, POSITION_INSTRUMENT, POOLED_FLOOR = "All entities", "All financial instruments", 500
HOSTS = ["MY", "SG", "TH", "ID", "PH", "VN", "KH", "BN", "LA", "MM", "TL"]


@dataclass(frozen=True)
class CountryRules:
    """What differs by host country: address words, office addresses, name features, legal suffixes."""

    code: str
    abbreviations: dict[str, str] = field(default_factory=dict)
    office_markers: list[str] = field(default_factory=list)
    name_features: list[tuple[str, str]] = field(default_factory=list)
    extra_suffixes: list[str] = field(default_factory=list)


# Used where a country names none of its own.
DEFAULT_ABBREVIATIONS = {
    "JLN": "JALAN", "JLN.": "JALAN", "LRG": "LORONG", "LRG.": "LORONG", "TMN": "TAMAN", "TMN.": "TAMAN", "KG": "KAMPUNG", "KG.": "KAMPUNG",
    "SRI": "SERI", "BT": "BUKIT", "BT.": "BUKIT", "NO": "NO", "NO.": "NO",
}
DEFAULT_OFFICES = ["LABUAN", "WISMA UOA", "MENARA UOA"]

CO_LTD = ("has_co_ltd", r"\bCO\.\s*LTD\b")
# Host countries.
COUNTRIES = {
    c.code: c
    for c in [
        CountryRules("MY", {"JLN": "JALAN", "TMN": "TAMAN", "KG": "KAMPUNG", "BDR": "BANDAR", "PERSIARAN": "PERSIARAN", "LRG": "LORONG", "BTU": "BATU", "SRI": "SERI"}, ["LABUAN", "WISMA UOA", "MENARA UOA"], [("has_sdn_bhd", r"\bSDN\b"), ("has_berhad", r"\bBERHAD\b"), ("has_local_country", r"\bMALAYSIA\b")]),
        CountryRules("SG", {"BLK": "BLOCK", "RD": "ROAD", "ST": "STREET", "AVE": "AVENUE", "DR": "DRIVE", "CRES": "CRESCENT"}, ["RAFFLES PLACE", "MARINA BAY", "SUNTEC TOWER", "CENTENNIAL TOWER", "CAPITAL TOWER"], [("has_pte_ltd", r"\bPTE\b"), ("has_local_country", r"\bSINGAPORE\b")], [r"PTE\s*\.?\s*LTD"]),
        CountryRules("PH", {"BGY": "BARANGAY", "BRGY": "BARANGAY", "STO": "SANTO", "STA": "SANTA", "AVE": "AVENUE", "BLVD": "BOULEVARD"}, ["MAKATI", "BGC", "BONIFACIO GLOBAL CITY", "AYALA AVENUE", "RCBC PLAZA"], [("has_inc_ph", r"\bINC(?:ORPORATED)?\b"), ("has_corp_ph", r"\bCORP(?:ORATION)?\b"), ("has_local_country", r"\bPHILIPPINE|PILIPINAS\b")]),
        CountryRules("TH", {"SOI": "SOI", "MOO": "MOO"}, ["SATHORN", "SILOM"], [CO_LTD, ("has_local_country", r"\bTHAILAND\b")]),
        CountryRules("ID", {"JL": "JALAN", "GG": "GANG"}, ["SUDIRMAN", "MEGA KUNINGAN"], [("has_pt", r"\bPT\b"), ("has_tbk", r"\bTBK\b"), ("has_local_country", r"\bINDONESIA\b")]),
        CountryRules("VN", {"TP": "THANH PHO", "Q": "QUAN", "P": "PHUONG", "TX": "THI XA", "TT": "THI TRAN", "DUONG": "DUONG"}, ["DISTRICT 1", "QUAN 1", "BITEXCO", "SAIGON TRADE CENTER", "LOTTE CENTER", "KEANGNAM", "LANDMARK 72"], [CO_LTD, ("has_jsc", r"\bJSC\b"), ("has_llc_vn", r"\bLLC\b"), ("has_local_country", r"\bVIET\s*NAM|VIETNAM\b")], ["JSC", "TNHH"]),
        CountryRules("KH", {"ST": "STREET", "BLV": "BOULEVARD", "KH": "KHAN", "SK": "SANGKAT"}, ["PHNOM PENH TOWER", "EXCHANGE SQUARE", "CANADIA TOWER", "VATTANAC CAPITAL"], [CO_LTD, ("has_plc_kh", r"\bPLC\b"), ("has_local_country", r"\bCAMBODIA|KAMPUCHEA\b")]),
        CountryRules("BN", {"JLN": "JALAN", "KG": "KAMPONG", "SPG": "SIMPANG"}, ["BANDAR SERI BEGAWAN"], [("has_sdn_bhd", r"\bSDN\s*BHD\b"), ("has_local_country", r"\bBRUNEI\b")]),
        CountryRules("LA", {}, ["VIENTIANE"], [CO_LTD, ("has_local_country", r"\bLAO\b")]),
        CountryRules("MM", {}, ["YANGON"], [CO_LTD, ("has_local_country", r"\bMYANMAR\b")]),
        CountryRules("TL", {"RUA": "RUA", "AV": "AVENIDA"}, ["DILI", "TIMOR PLAZA"], [("has_lda", r"\bLDA\b"), ("has_unipessoal", r"\bUNIPESSOAL\b"), ("has_local_country", r"\bTIMOR|TIMOR.LESTE\b")]),
    ]
}


def country_rules(code: str) -> CountryRules:
    """The rules of a country; empty ones for a code that is not listed."""
    return COUNTRIES.get(code.upper(), CountryRules(code.upper()))


def supported_countries() -> list[str]:
    return sorted(COUNTRIES)
