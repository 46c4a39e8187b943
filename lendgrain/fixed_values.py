"""Fixed values the results depend on: rules, word lists, thresholds and labels.

Everything here is data. Operators take these tables as parameters, so a portfolio
may swap in its own.
"""

from __future__ import annotations

# --- Pricing -------------------------------------------------------------------------
BASE_RATE_PCT = 9.0
BASE_LIMIT_CR = 10.0

# Id, name, rate penalty (bps), limit cut (%), manual review, severity, trigger.
RULES = [
    ("P-01", "Ghost Input Trap", 100, 10, False, None, "GSTR-2A vs 3B mismatch > 15% (Perfios)"),
    ("P-02", "Hidden Family Web", 75, 10, True, None, "RPT outflows to director-connected entities (manual)"),
    ("P-03", "Statutory Default / Auditor Qualification", 150, 20, False, None,
     "CARO 2020 Clause (vii) default or qualified/adverse auditor opinion"),
    ("P-04", "Emphasis of Matter / Going Concern", 75, 0, True, None, "Auditor flagged going concern or material uncertainty"),
    ("P-07", "PRIMARY-01: Site Visit Risk", 75, 10, True, "HIGH", "Adverse observations from factory visit or management interview"),
    ("P-09", "Financial Restatement", 200, 40, True, "CRITICAL", "Prior year financial comparative figures restated by >2%"),
    ("P-14", "CORP-01: Company Not Active", 0, 100, True, "CRITICAL", "MCA21 shows company struck off or under liquidation"),
    ("P-10", "Auditor Rotation / Change", 75, 10, True, "HIGH", "Change in statutory auditor detected across reporting periods"),
    ("P-13", "Adverse Media Detected", 50, 0, True, None, "NewsScanner found high-severity red flags (fraud, ED raid, etc.)"),
    ("P-16", "MGMT-01: Negative Management Sentiment", 50, 5, False, "MEDIUM",
     "MD&A analysis shows negative sentiment using Loughran-McDonald lexicon"),
    ("P-15", "LEGAL-01: Active Court Proceedings", 100, 15, True, "HIGH",
     "High-risk court cases found via eCourts public API (NCLT/winding up/fraud/DRT)"),
    ("P-17", "SHARE-01: High Promoter Pledge", 75, 10, True, "HIGH",
     "Promoter shares pledged > 50% — distress signal, forced selling risk"),
    ("P-18", "SHARE-02: Low Promoter Holding", 50, 5, False, "MEDIUM", "Promoter holding below 26% — low skin in the game"),
    ("P-19", "SITE-01: Low Capacity Utilisation", 100, 15, False, "HIGH", "Factory operating below 60% capacity"),
    ("P-20", "SITE-02: Premises Vacant / Shut", 150, 25, False, "HIGH", "Physical premises found vacant or non-operational"),
    ("P-21", "SITE-03: Labour Dispute", 100, 15, False, "HIGH", "Active labour dispute or strike at site"),
    ("P-22", "SITE-04: Management Non-Cooperative", 125, 20, False, "HIGH", "Management refused to cooperate in due diligence"),
    ("P-23", "SITE-05: Inventory Build-up", 50, 10, False, "MEDIUM", "Excess unsold inventory observed"),
    ("P-24", "SITE-06: Poor Asset Condition", 50, 10, False, "MEDIUM", "Machinery in poor/deteriorating condition"),
    ("P-25", "SITE-07: Key Man Risk", 50, 5, False, "MEDIUM", "Business entirely dependent on single person"),
    ("P-26", "SITE-08: Records Not Maintained", 100, 20, False, "HIGH", "Books/records not maintained or produced"),
    ("P-27", "RATING-03: Sub-Investment Grade / Downgrade", 75, 10, False, "HIGH",
     "Credit rating below investment grade or recent downgrade detected"),
    ("P-06", "FRAUD-01: Circular Trading Network", 200, 30, True, "CRITICAL",
     "Counterparty intelligence detected shared directors, shell companies, or circular money flows among transaction parties"),
    ("P-28", "BANK-02: Circular Bank Transactions", 150, 25, False, "HIGH",
     "Round-trip money flows detected in bank statements (A→B→A within 7 days)"),
    ("P-29", "BANK-03: Cash Deposit Anomaly", 50, 10, False, "MEDIUM",
     "Large cash deposits detected near GST filing dates — possible revenue inflation"),
    ("P-30", "BENCHMARK-01: Sector Underperformance", 50, 10, False, "MEDIUM",
     "Company underperforming sector benchmarks by >25% on key margin ratios"),
    ("P-31", "XVER-01: Revenue Verification Mismatch", 100, 15, True, "HIGH",
     "Cross-verification found claimed revenue not supported by bank deposits or GST data"),
    ("P-32", "XVER-02: Compliance Claim Contradicted", 75, 10, True, "HIGH",
     "Annual report compliance claims contradicted by external bureau data"),
    ("P-33", "RECON-01: GST-Bank Turnover Mismatch", 125, 20, True, "HIGH",
     "High variance detected between GST turnover and bank statement credits"),
]

RULE_SCHEMA = (
    "rule_id string, name string, rate_penalty_bps int, limit_reduction_pct int, "
    "requires_manual_review boolean, severity string, trigger string"
)

# Pre-disbursement conditions by rule, in memo order, then the standing ones.
RULE_CONDITIONS = [
    ("P-03", "Obtain auditor clarification on CARO Clause (vii) default"),
    ("P-06", "Investigate circular trading flows; obtain management explanation and counterparty confirmation"),
    ("P-13", "Obtain management response to adverse media findings"),
    ("P-07", "Re-verify plant capacity through independent chartered engineer assessment"),
    ("P-33", "Reconcile GST turnover with bank credits; obtain CA-certified reconciliation statement"),
    ("P-28", "Investigate round-trip bank transactions; obtain counterparty details and purpose of transfers"),
    ("P-09", "Obtain explanation for silent financial restatements from auditor"),
]
STANDING_CONDITIONS = [
    "Obtain board resolution authorizing the proposed borrowing",
    "Submit latest 12-month bank statements for all operative accounts",
    "Submit ITR acknowledgements for last 3 assessment years",
    "Execute necessary security documents and create charge with ROC",
]

# --- Bank statements -----------------------------------------------------------------
# Header aliases in order of preference.
DATE_COLUMNS = ["transactiontimestamp", "transactiondate", "valuedate", "date", "transaction date", "txn date"]
NARRATION_COLUMNS = ["narration", "description", "particulars"]
DEBIT_COLUMNS = ["debit", "withdrawal"]
CREDIT_COLUMNS = ["credit", "deposit"]
BALANCE_COLUMNS = ["currentbalance", "balance", "closing balance"]
TXN_ID_COLUMNS = ["txnid", "reference"]
# Cash markers, tax filing days of the month and the window before them.
CASH_WORDS = ["cash", "deposit", "cdm", "cash deposit"]
FILING_DAYS = [1, 11, 20]
SPIKE_WINDOW_DAYS = 3
SPIKE_MULTIPLE = 3
SPIKE_FLOOR = 100_000.0
ROUND_TRIP_DAYS = 7
ROUND_TRIP_MIN = 10_000.0
RUPEES_PER_CRORE = 1e7

# --- Supply chain --------------------------------------------------------------------
# Keyword lists of the nine text flags.
SUPPLY_KEYWORDS = {
    "commodity_exposure": [
        "commodity", "commodity prices", "input price volatility", "volatile raw material prices",
        "price fluctuation in steel", "price fluctuation in crude", "agri commodity",
    ],
    "weather_exposure": ["weather", "monsoon", "seasonal", "seasonality", "rainfall", "climate"],
    "import_dependency": [
        "import dependence", "import dependency", "imported raw material", "dependent on imports",
        "foreign supplier",
    ],
    "supplier_concentration_high": [
        "supplier concentration", "single supplier", "few suppliers", "limited supplier base",
        "concentrated supplier",
    ],
    "customer_concentration_high": [
        "customer concentration", "concentrated customer", "few customers", "single customer",
        "top 2 customers", "top two customers",
    ],
    "buyer_payment_risk": [
        "delayed payment", "payment delays", "slow collections", "overdue receivables",
        "collection challenges", "extended credit period", "payment reliability", "receivable risk",
        "collections remained weak",
    ],
    "receivables_stretched": [
        "trade receivables increased", "receivables increased", "stretched receivables",
        "high receivable days", "collection period increased", "debtor days increased",
    ],
    "buyer_type_is_weak_or_unorganized": [
        "unorganized buyers", "small buyers", "local traders", "fragmented buyer base",
        "small retailers", "informal channel",
    ],
    "single_product_dependency": [
        "single product", "single-product", "majority of revenue from one product",
        "dependence on one product",
    ],
}
SUPPLIER_LABELS = ["major supplier", "key supplier", "principal supplier"]
BUYER_LABELS = ["major customer", "key customer", "major buyer", "top customer"]
PRODUCT_LABELS = ["major products", "principal products", "products"]
MATERIAL_LABELS = ["principal raw materials", "raw materials", "key inputs", "major inputs"]
SUPPLIER_SHARE = ("top supplier", 50)
CUSTOMER_SHARE = ("top customer", 40)
# Flag -> explanation, in memo order.
SUPPLY_REASONS = [
    ("commodity_exposure", "Input costs appear commodity-linked"),
    ("weather_exposure", "Business shows weather/seasonality sensitivity"),
    ("import_dependency", "Input sourcing appears import-dependent"),
    ("supplier_concentration_high", "High supplier concentration detected"),
    ("customer_concentration_high", "High customer concentration detected"),
    ("buyer_payment_risk", "Buyer payment reliability concerns are indicated"),
    ("receivables_stretched", "Trade receivables language suggests payment stretch"),
    ("buyer_type_is_weak_or_unorganized", "Downstream buyers appear small/unorganized"),
    ("single_product_dependency", "Revenue appears dependent on a narrow product set"),
]
NO_SUPPLY_REASON = "No strong upstream or downstream stress signals were detected"
SUPPLIER_NOTE = "Supplier not explicitly identified; upstream risk inferred from generic disclosures."
BUYER_NOTE = "Buyer not explicitly identified; risk inferred from customer concentration language."
NOT_IDENTIFIED = "Not explicitly identified"
SUPPLY_OPENINGS = {
    "Low": "Supply-chain risk appears low based on available disclosures. The borrower does not appear "
           "materially dependent on unstable suppliers or weak downstream counterparties.",
    "Moderate": "Supply-chain risk appears moderate due to some dependence on concentrated suppliers/customers "
                "and exposure to input or collection variability.",
    "High": "Supply-chain risk appears high because the borrower's operating stability depends on a weak or "
            "concentrated link in the value chain, particularly on the %s side.",
}

# --- Audit report --------------------------------------------------------------------
# Statutory-default, qualification and emphasis patterns (Java dialect).
STATUTORY_PATTERNS = [
    r"(?iu)(caro[\s,\-]*2020[\s\S]{0,200}?clause[\s\-]*\(?\s*vii\s*\)?|"
    r"clause[\s\-]*\(?\s*vii\s*\)?[\s\S]{0,200}?caro[\s,\-]*2020)",
    r"(?iu)(statutory\s+dues[\s\S]{0,200}?(?:not\s+deposited|outstanding|overdue|arrear|default)|"
    r"(?:provident\s+fund|pf|esi|tds|gst|custom\s+dut|income[\s-]tax|service\s+tax)[\s\S]{0,150}?"
    r"(?:not\s+deposited|arrear|default|overdue|outstanding))",
    r"(?iu)(amounts?\s+(?:not\s+)?deposited[\s\S]{0,200}?(?:pf|esi|tds|gst|income.tax|custom))",
]
STATUTORY_LABEL = "CARO / statutory-dues"
PARAGRAPH_REST = r"[\s\S]{0,300}?(?=\n\n|\z)"
QUALIFICATION_PHRASES = [
    ("Except for", r"except\s+for"), ("Adverse opinion", r"adverse\s+opinion"),
    ("Qualified opinion", r"qualified\s+opinion"), ("Disclaimer of opinion", r"disclaimer\s+of\s+opinion"),
]
EMPHASIS_PHRASES = [
    ("Emphasis of Matter", r"emphasis\s+of\s+matter"), ("Material Uncertainty", r"material\s+uncertainty"),
    ("Going Concern", r"going[\s-]+concern"),
]
SNIPPET_LENGTH = 400
ANNEXURE_MARK = "\n\n=== ANNEXURE ===\n\n"

# --- Financial figures ---------------------------------------------------------------
# Amount shapes, then the ordered patterns and exclusions per figure.
AMOUNT_OR_UNIT = (
    r"([\d,]{5,}\.?\d*|[\d,]{1,}[.]\d+|[\d,]{1,}\s*(?:cr|crore|mn|million|bn|billion|lakh))"
)
LEAD_IN = r"[\s\S]{0,100}?(?:of|was|at|is|:|Rs\.?|₹|€)?\s*"
SIGNED_4 = r"(\([\d,]{4,}\.?\d*\)|[\d,]{4,}\.?\d*)"
FIGURE_PATTERNS = {
    "Revenue": (
        [
            r"revenue\s+from\s+operations" + LEAD_IN + AMOUNT_OR_UNIT,
            r"revenue\s+from\s+contracts\s+with\s+customers" + LEAD_IN + AMOUNT_OR_UNIT,
            r"total\s+(?:revenue|income)" + LEAD_IN + AMOUNT_OR_UNIT,
            r"(?:total\s+)?revenue\s*(?:stood\s+at|is|was|of|:|)[\s\S]{0,50}?[`₹\$€]?\s*([\d,]+\.?\d*)"
            r"\s*(bn|billion|cr|crore|mn|million)",
            r"revenue[\s]+([\d,]{5,}\.?\d*)",
            r"total\s+revenue[\s]+([\d,]{4,}\.?\d*)",
        ],
        [
            r"decreased\s+by", r"increased\s+by",
            r"(?:decreased|increased|decline|growth)\s+(?:by\s+)?[`₹€]?\s*[\d,]+",
            r"(\d+\.?\d*)\s*%",
        ],
    ),
    "EBITDA": (
        [
            r"(?:cash\s+)?ebitda[\s\S]{0,80}?([\d,]+\.?\d*)\s*(?:mn|cr|bn|billion|crore)",
            r"(?:cash\s+)?ebitda\s+(?:stood\s+at\s+)?[`₹]?\s*([\d,]+\.?\d*)",
            r"operating\s+(?:profit|ebitda)[\s\S]{0,60}?([\d,]+\.?\d*)\s*(?:mn|cr|bn)",
        ],
        [r"ebitda\s+margin[\s\S]{0,30}?(\d+\.?\d*)\s*%"],
    ),
    "PAT": (
        [
            r"(?:loss|profit)\s+for\s+the\s+year\s+amounting\s+to\s+[`₹]?\s*(\([\d,]+\.?\d*\))",
            r"(?:profit|loss)\s*[/\(]?\s*(?:loss)?\s*\)?\s+for\s+the\s+(?:year|period)[\s\S]{0,80}?" + SIGNED_4,
            r"net\s+(?:profit|loss)\s+after\s+tax[\s\S]{0,60}?[`₹]?\s*" + SIGNED_4 + r"\s*(?:mn|cr|bn)",
        ],
        [r"(\d+)\s+percent", r"(\d+\.?\d*)\s*(?:%|per\s*cent)"],
    ),
    "Total Debt": (
        [
            r"total\s+(?:borrowings?|debt)[\s\S]{0,80}?[`₹]?\s*([\d,]+\.?\d*)\s*(?:mn|cr|bn|crore)",
            r"(?:long.term\s+borrowings?[\s\S]{0,30}?short.term\s+borrowings?|total\s+debt)"
            r"[\s\S]{0,60}?[`₹]?\s*([\d,]+\.?\d*)",
            r"total\s+financial\s+liabilities[\s\S]{0,60}?([\d,]+\.?\d*)",
        ],
        [],
    ),
    "Net Worth": (
        [
            r"total\s+equity[\s\S]{0,60}?[`₹]?\s*" + SIGNED_4 + r"\s*(?:mn|cr|bn|crore|million)?",
            r"shareholders['s]*\s+(?:fund|equity)[\s\S]{0,60}?[`₹]?\s*(\([\d,]+\.?\d*\)|[\d,]{4,}\.?\d*)",
            r"net\s+worth[\s\S]{0,60}?[`₹]?\s*" + SIGNED_4,
        ],
        [r"(\d+\.?\d*)\s*%", r"increased\s+by\s+\d+"],
    ),
}
# Words that every match of each figure pattern holds, in lower case, alternatives by "|".
FIGURE_NEEDLES = {
    "Revenue": [
        ("revenue", "operations"), ("contracts", "customers"), ("total", "revenue|income"), ("revenue",), ("revenue",),
        ("total", "revenue")],
    "EBITDA": [("ebitda",), ("ebitda",), ("operating", "profit|ebitda")],
    "PAT": [("amounting", "profit|loss"), ("profit|loss", "year|period"), ("net", "profit|loss", "tax")],
    "Total Debt": [("total", "borrowing|debt"), ("borrowing|debt",), ("financial", "liabilities")],
    "Net Worth": [("total", "equity"), ("shareholders", "fund|equity"), ("net", "worth")],
}
CURRENCY_SIGN = r"[`₹\$]"
PAGE_HINT = r"(?iu)page|p\.\d+|\d{1,3}\s*$"
AUDITOR_SIGNATURE = (
    r"(?iu)for\s+([a-zA-Z\s&,\.\-]{5,80}?(?:chartered\s+accountants|associates|llp|&\s+co\.?))"
)
AUDITOR_TAIL = r"(?iu)(?:firm|registration).*$"
AUDITOR_MENTION = r"(?:For|Sd/-)\s+([A-Z][A-Za-z\s&.]+(?:LLP|Associates|Co\b|Company))"

# --- Ratings -------------------------------------------------------------------------
# Rating scale from best to worst; the first ten are investment grade.
RATING_SCALE = [
    "AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "C", "D",
]
INVESTMENT_GRADES = RATING_SCALE[:10]
RATING_MENTION = (
    r"(?iu)(CRISIL|ICRA|CARE|India\s+Ratings?|Brickwork|Acuit[eé])\s+([A-D]{1,3}[+-]?(?:\s*\([A-Za-z]+\))?)"
)
AGENCY_NEEDLE = "crisil|icra|care|india|brickwork|acuit"
RATING_OUTLOOK = r"(?iu)(?:outlook|watch)\s*[:\s]*\s*(stable|negative|positive|developing|watch)"
DOWNGRADE_PATTERNS = [
    r"(?iu)(downgrad|revis\w+\s+downward)",
    r"(?iu)rat(?:ing|ed)\s+(?:has been|was)\s+(?:downgrad|lower|revis)",
    r"(?iu)from\s+([A-D]{1,3}[+-]?)\s+to\s+([A-D]{1,3}[+-]?)",
]

# --- Shareholding --------------------------------------------------------------------
# Section markers and the ordered percentage patterns per holder class.
HOLDING_MARKERS = [
    "statement showing shareholding pattern", "shareholding pattern as on", "category of shareholders",
    "promoter and promoter group", "table i - summary statement",
]
HOLDING_SECTION_LENGTH = 8000
HOLDING_PATTERNS = {
    "promoter_holding_pct": [
        r"promoter[s]?\s+(?:and\s+promoter\s+group\s+)?holding[:\s]+(\d+\.?\d*)\s*%",
        r"promoter[s]?\s+(?:and\s+promoter\s+group\s+)?[\s\S]{0,30}?(\d+\.?\d*)\s*%",
        r"(\d+\.?\d*)\s*%[\s\S]{0,30}?held\s+by\s+promoter",
        r"promoter\s+shareholding[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"promoters\s+hold[\s\S]{0,30}?(\d+\.?\d*)\s*%",
        r"promoter[s]?[\s\S]{0,100}?(\d+\.\d+)[\s\S]{0,20}?(\d+\.\d+)[\s\S]{0,20}?(\d+\.\d+)",
        r"(?:a\)|1\))\s*promoter[\s\S]{0,200}?(\d{1,2}\.\d{2})",
    ],
    "pledged_pct": [
        r"pledged[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"(\d+\.?\d*)\s*%[\s\S]{0,30}?pledged",
        r"pledge[d]?\s+shares[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"encumbered[\s\S]{0,50}?(\d+\.?\d*)\s*%",
    ],
    "fii_holding_pct": [
        r"foreign\s+institutional\s+investor[s]?[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"fii[s]?[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"foreign\s+portfolio\s+investor[s]?[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"fpi[s]?[\s\S]{0,50}?(\d+\.?\d*)\s*%",
    ],
    "government_holding_pct": [
        r"government[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"central\s+government[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"state\s+government[\s\S]{0,50}?(\d+\.?\d*)\s*%",
        r"president\s+of\s+india[\s\S]{0,50}?(\d+\.?\d*)\s*%",
    ],
}

# --- Collateral ----------------------------------------------------------------------
# Secured and unsecured borrowing patterns.
SECURED_PATTERN = (
    r"(?iu)((first|second|exclusive|pari[- ]passu|hypothecation|charge|pledge)[^.]{0,80}"
    r"(fixed assets|inventory|receivables|current assets|property|plant|machinery))"
)
UNSECURED_PATTERN = r"(?iu)(unsecured\s+(?:loans|borrowings|debentures|facilities))"

# --- Tone of the management discussion -----------------------------------------------
# Negative, positive and uncertainty words, and headwind markers.
NEGATIVE_WORDS = [
    "abandon", "abandoned", "adverse", "adversely", "bankrupt", "bankruptcy", "breach", "cancellation", "ceased",
    "collapse", "conflict", "contraction", "crisis", "damage", "decay", "decline", "declining", "default", "defect",
    "deficit", "delinquent", "depressed", "deteriorate", "deterioration", "disappointing", "disruption",
    "disruptions", "distress", "downsize", "downturn", "drop", "erosion", "fail", "failure", "fraud", "headwind",
    "headwinds", "impairment", "investigation", "litigation", "loss", "losses", "negative", "penalty", "recession",
    "regulation", "regulatory", "restructuring", "severe", "shortfall", "sluggish", "suffer", "suspend", "threat",
    "weakness", "write-off", "writeoff", "winding", "insolvency", "insolvent", "npa", "overdue", "unpaid",
    "delinquency", "stressed", "under-recovery", "underperform",
]
POSITIVE_WORDS = [
    "achieve", "achieved", "achievement", "advantage", "beneficial", "benefit", "boom", "boost", "breakthrough",
    "capable", "confident", "efficiency", "efficient", "empower", "enable", "excellent", "exceptional", "expansion",
    "favorable", "gain", "gains", "growth", "improve", "improvement", "improving", "innovation", "innovative",
    "leadership", "momentum", "opportunity", "optimistic", "outperform", "outperformed", "profitable", "progress",
    "prosperity", "rebound", "recovery", "resolve", "reward", "stable", "strength", "strengthen", "strong", "success",
    "successful", "surge", "synergy", "upturn", "valuable", "robust", "resilient", "sustainable",
]
UNCERTAIN_WORDS = [
    "ambiguous", "anticipate", "approximately", "assume", "assumes", "assumption", "believe", "believes", "caution",
    "cautious", "could", "depend", "dependence", "doubt", "doubtful", "fluctuate", "fluctuating", "fluctuation",
    "imprecise", "incomplete", "indefinite", "likely", "may", "might", "nearly", "pending", "perhaps", "possible",
    "possibly", "predict", "preliminary", "probable", "probably", "random", "risk", "risks", "roughly", "sometimes",
    "somewhat", "speculate", "speculation", "subject to", "suppose", "tentative", "uncertain", "uncertainties",
    "uncertainty", "unclear", "unconfirmed", "unexpected", "unforeseen", "unknown", "unpredictable", "unproven",
    "unsettled", "unusual", "variable", "volatile", "volatility",
]
HEADWIND_MARKERS = [
    "headwind", "regulation", "disruption", "inflation", "supply chain", "decline", "threat", "challenge", "risk",
    "pressure", "adversely", "uncertainty", "competition", "slowdown", "downturn", "stressed", "agr", "dues",
    "spectrum", "debt", "borrowing", "default", "npa",
]
TONE_LEXICON = {"negative": NEGATIVE_WORDS, "positive": POSITIVE_WORDS, "uncertain": UNCERTAIN_WORDS}

# --- Management ambidexterity --------------------------------------------------------
# Exploration and exploitation dictionaries (McKenny et al., 2018).
EXPLORATION_WORDS = [
    "beta-phase", "beta-testing", "breakthrough", "breakthroughs", "clinical studies", "clinical study",
    "clinical test", "clinical testing", "clinical tests", "clinical trial", "clinical trials", "creative", "develop",
    "developed", "developing", "development", "developmental", "developments", "develops", "experiment",
    "experimental", "experimentalism", "experimentalist", "experimentalists", "experimentalize", "experimentally",
    "experimentarian", "experimentarians", "experimentation", "experimentations", "experimentative", "experimentator",
    "experimented", "experimenter", "experimenters", "experimenting", "experimentist", "experimentists",
    "experimentor", "experimentors", "experiments", "innovate", "innovated", "innovates", "innovating", "innovation",
    "innovations", "innovative", "innovativeness", "innovator", "innovators", "innovatory", "inventions", "IPR&D",
    "IPRD", "laboratories", "laboratory", "labs", "launch", "launched", "launches", "launching", "new drug",
    "new drugs", "new generic product", "new generic products", "new mobile product", "new mobile products",
    "new offering", "new offerings", "new product", "new products", "new program", "new programming", "new programs",
    "new system", "new systems", "new technologies", "new technology", "novel", "patent application",
    "patent applications", "patent development", "patent developments", "Phase 1", "Phase 1a", "Phase 1b", "Phase 2",
    "Phase 2a", "Phase 2b", "Phase 3", "Phase 4", "Phase I", "Phase I/II", "Phase Ia", "Phase IB", "Phase II",
    "Phase Iia", "Phase Iib", "Phase III", "Phase IV", "pioneer", "pioneered", "preclinical", "pre-clinical",
    "proof of concept", "prototype", "prototypes", "prototyping", "R&D", "research", "researching", "unveiled",
]
EXPLOITATION_WORDS = [
    "adaptations", "advertising", "commercialization", "commercialize", "commercialized", "commercializes",
    "commercializing", "commoditized", "commoditizing", "current offering", "current offerings", "current product",
    "current products", "efficience", "efficiencies", "efficiency", "efficient", "efficiently", "existing offering",
    "existing offerings", "existing product", "existing products", "existing technology", "exploit", "exploitability",
    "exploitable", "exploitation", "exploitational", "exploitationally", "exploitations", "exploitative",
    "exploitatively", "exploitatory", "exploited", "exploiting", "exploitive", "exploitively", "exploits",
    "exploiture", "extension", "extensions", "implement", "implementable", "implemental", "implementation",
    "implementations", "implemented", "implementer", "implementers", "implementing", "implementor", "implementors",
    "implements", "integrate", "integration", "maintenance", "manufacture", "manufactured", "manufacturing",
    "marketed", "marketing", "new features", "new formulation", "new formulations", "new indication",
    "new indications", "optimization", "optimize", "optimized", "optimizes", "optimizing", "optimum", "produce",
    "produced", "produces", "producing", "production", "productions", "productivity", "promotion", "promotional",
    "promotions", "redesign", "reengineering", "re-engineering", "refine", "refined", "refinedly", "refinedness",
    "refinement", "refinements", "refines", "refining", "reformulated", "reformulating", "reformulation", "refreshed",
    "re-launch", "replicated", "replication", "replicators", "retooled", "salesforce", "salespeople", "salespersons",
    "standardized", "streamline", "throughput", "upgrade", "upgraded", "upgrades", "upgrading", "version", "versions",
]
AMBIDEXTERITY_LEXICON = {"exploration": EXPLORATION_WORDS, "exploitation": EXPLOITATION_WORDS}

# --- Site visits ---------------------------------------------------------------------
# Rule -> (description, ordered patterns). Pricing comes from the rule table.
SITE_SIGNALS = [
    ("P-19", "Factory/plant operating below 60% capacity — indicates weak demand or operational issues", [
        r"\b(\d{1,3})\s*%\s*capacity\b", r"operating\s+at\s+(\d{1,3})\s*(?:percent|%)",
        r"capacity\s+utilis?ation\s+(?:of\s+)?(\d{1,3})\s*(?:percent|%)", r"running\s+at\s+(\d{1,3})\s*%",
        r"plant\s+(?:is\s+)?(?:at|running)\s+(\d{1,3})\s*%",
    ]),
    ("P-20", "Physical premises found vacant, shut or non-operational during site visit", [
        r"\bvacant\b", r"\bshut\s*down\b", r"\bclosed\b(?!\s+account)", r"\bnon.?operational\b",
        r"\bno\s+(?:activity|workers|production)\b", r"\bempty\s+(?:plant|factory|premises|floor)\b",
        r"\bpremises\s+(?:appear|found|seem)\s+(?:vacant|empty|abandoned)\b",
    ]),
    ("P-21", "Active labour dispute or strike reported at site visit", [
        r"\bworkers?\s+(?:on\s+strike|striking)\b", r"\blabou?r\s+dispute\b",
        r"\bunion\s+(?:dispute|strike|action)\b", r"\bstrike\b", r"\bwork\s*(?:ers?)?\s*stoppage\b",
    ]),
    ("P-22", "Management was unavailable, evasive or refused to cooperate during due diligence", [
        r"\bmanagement\s+(?:unavailable|absent|refused|evasive|uncooperative)\b",
        r"\brefused\s+to\s+(?:meet|answer|provide|show|disclose)\b",
        r"\bnot\s+(?:available|present|cooperative)\b", r"\bevasive\s+(?:on|about|regarding)\b",
        r"\bdid\s+not\s+(?:respond|cooperate|allow)\b",
    ]),
    ("P-23", "Excess / unsold inventory observed — possible demand slowdown or cash flow stress", [
        r"\binventory\s+(?:piled|excess|overstocked|accumulate|bloated)\b", r"\bexcess\s+(?:stock|inventory)\b",
        r"\bstock\s+(?:piling|pile.?up|accumulation)\b", r"\bwarehouses?\s+(?:full|overflow|packed)\b",
        r"\bunsold\s+(?:goods|stock|inventory)\b",
    ]),
    ("P-24", "Machinery / equipment found in poor or deteriorating condition during site visit", [
        r"\bmachinery\s+(?:old|outdated|obsolete|worn|rusted|broken|not\s+maintained)\b",
        r"\bequipment\s+(?:poor|bad|deteriorat|obsolete|aged)\b", r"\bpoor\s+(?:maintenance|upkeep|condition)\b",
        r"\bfixed\s+assets?\s+(?:deteriorat|worn|old)\b", r"\binfrastructure\s+(?:poor|bad|deteriorat)\b",
    ]),
    ("P-25", "Business appears entirely dependent on single promoter / individual — key man risk", [
        r"\bkey\s+(?:person|man|management)\s+(?:risk|dependency|dependent)\b",
        r"\bentire(?:ly)?\s+(?:dependent|run)\s+by\s+(?:one|single|1)\s+(?:person|promoter|individual)\b",
        r"\bno\s+second\s+(?:line|tier)\s+(?:of\s+)?management\b", r"\bsole\s+decision\s+maker\b",
    ]),
    ("P-26", "Books of accounts or business records not maintained or made available", [
        r"\bbooks?\s+(?:not\s+)?(?:maintained|updated|available|produced)\b",
        r"\brecords?\s+(?:not\s+)?(?:maintained|available|produced|incomplete)\b",
        r"\bno\s+(?:books|accounts?|records?)\b",
        r"\baccounts?\s+(?:not\s+maintained|incomplete|not\s+available)\b",
    ]),
]
CAPACITY_RULE, CAPACITY_THRESHOLD = "P-19", 60
# Literal red-flag phrases of the second scanner and what they mean.
SITE_RED_FLAGS = [
    ("management evasive", "Management was evasive during interview"),
    ("books not available", "Books of accounts unavailable for inspection"),
    ("factory closed", "Factory found non-operational"),
    ("workers absent", "Significant worker absenteeism observed"),
    ("post-dated cheques", "Post-dated cheques issued — liquidity concern"),
    ("director unavailable", "Promoter/Director unavailable for meeting"),
    ("attached by bank", "Assets attached by lending bank"),
    ("stock not found", "Inventory levels inconsistent with records"),
    ("machinery idle", "Machinery found idle — capacity concern"),
    ("no orders", "No confirmed order book visible"),
]

# --- Adverse media -------------------------------------------------------------------
# Keyword weights, mitigating words and the flag threshold.
MEDIA_WEIGHTS = [
    ("fraud", 2.0), ("fraudulent", 2.0), ("scam", 2.0), ("ponzi", 3.0), ("money laundering", 2.5),
    ("benami", 2.5), ("rbi penalty", 2.0), ("sebi penalty", 2.0), ("enforcement directorate", 2.0),
    ("ed raid", 2.5), ("cbi", 1.5), ("fir", 1.5), ("nclt", 1.5), ("insolvency", 2.0), ("bankruptcy", 2.0),
    ("liquidation", 2.0), ("winding up", 2.0), ("default", 1.0), ("npa", 1.5), ("non-performing", 1.5),
    ("wilful defaulter", 3.0), ("loan restructuring", 1.0), ("lawsuit", 1.0), ("cheque bounce", 1.5),
    ("cheque dishonour", 1.5), ("section 138", 1.5), ("penalty", 1.0), ("fine", 0.8),
    ("shell company", 2.5), ("bogus", 2.0), ("fictitious", 2.0), ("round tripping", 2.5),
]
MEDIA_MITIGANTS = [
    "resolved", "settled", "dismissed", "acquitted", "exonerated", "no merit", "quashed", "withdrawn",
    "compliance restored", "paid in full",
]
MEDIA_THRESHOLD = 3.0
CONCERN_WORDS = ["winding up", "nclt", "insolvency", "bankruptcy", "closure"]

# --- Sections and headings -----------------------------------------------------------
# Section -> (start keywords, end keywords).
SECTIONS = [
    ("auditors_report",
     ["independent auditor's report", "independent auditors' report", "independent auditor report"],
     ["annexure to the independent auditor's report", "annexure to independent auditor's report",
      "annexure a", "annexure b", "balance sheet", "statement of profit and loss", "financial statements"]),
    ("auditors_annexure",
     ["annexure to the independent auditor's report", "annexure to independent auditor's report",
      "annexure a", "annexure b"],
     ["balance sheet", "statement of profit and loss", "consolidated financial statements",
      "cash flow statement"]),
    ("mda_report",
     ["management discussion and analysis", "management's discussion and analysis", "md&a",
      "management discussion & analysis", "management discussion",
      "operational and financial performance", "financial review"],
     ["corporate governance", "report on corporate governance", "board's report", "directors' report",
      "business responsibility report", "financial statements", "standalone financial statements"]),
]
FALLBACK_SECTION, FALLBACK_PHRASE = "auditors_report", "independent auditor"
HEADING_KEYWORDS = [
    "overview", "business overview", "industry overview", "financial performance", "financial review",
    "results of operations", "operating results", "segment analysis", "business segments", "revenue", "expenses",
    "profitability", "cash flow", "liquidity", "capital resources", "working capital", "risk", "risk factors",
    "risk management", "outlook", "future outlook", "forward looking", "strategy", "business strategy",
    "growth strategy", "opportunities", "challenges", "critical accounting", "gst", "gstr", "msme", "rbi", "sebi",
    "cibil", "nbfc", "capex", "opex", "ebitda", "pat", "pbt", "roce",
]

# --- Entity names --------------------------------------------------------------------
# Company suffixes, ticker aliases and words that mark a line as no name.
COMPANY_SUFFIXES = [
    " Private Limited", " Pvt. Ltd.", " Pvt Ltd", " Corporation", " Limited", " Ltd.", " Ltd",
    " Inc.", " Inc", " Corp.", " Corp",
]
TICKER_NAMES = [("CDEL", "Coffee Day Enterprises"), ("TCS", "Tata Consultancy Services")]
NOT_A_COMPANY = r"(?iu)(20\d{2}|\bFY\d{2}\b|Integrated|Statutory|Financial)"

# White space of Unicode that ASCII patterns miss.
UNICODE_SPACES = (
    "\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Text clean-up -------------------------------------------------------------------
# Typographic characters and their plain forms.
PLAIN_CHARACTERS = [
    ("\u2019", "'"), ("\u2018", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "--"),
    ("\u00a0", " "), ("\u2002", " "), ("\u2003", " "), ("\u2009", " "),
]

# --- Auditor lists -------------------------------------------------------------------
# List type | firm | severity | reason
AUDITOR_LISTS = [
    ("BLACKLISTED", "Gupta Sharma & Associates", "HIGH",
     "Failed to flag related party transactions in 3 consecutive audits; NFRA order dated 14-Sep-2023 "
     "for professional misconduct"),
    ("BLACKLISTED", "Rajesh Kumar & Co", "CRITICAL",
     "Audit firm involved in IL&FS subsidiary audits; RBI flagged for inadequate verification of NPA "
     "classification"),
    ("BLACKLISTED", "PKR & Associates", "MEDIUM",
     "ICAI disciplinary action for issuing clean audit report despite known going concern issues; "
     "suspended from practice for 6 months"),
    ("BLACKLISTED", "Maxwell Patel LLP", "LOW",
     "Under monitoring — audited 3 accounts that subsequently turned NPA within 12 months of clean "
     "audit opinion"),
    ("WATCHLIST", "SR Batliboi & Co LLP", "INFO",
     "Large firm — no adverse findings, but NFRA inspection pending for FY24 audits"),
]
AUDITOR_LIST_SCHEMA = "list_type string, firm string, severity string, reason string"

# --- Base terms model ----------------------------------------------------------------
# Model features with the sector medians that fill gaps.
RATIO_MEDIANS = {
    "dscr": 1.3, "leverage_ratio": 3.2, "current_ratio": 1.35, "revenue_growth_pct": 8.0,
    "gst_compliance_pct": 85.0, "promoter_holding_pct": 52.0, "years_in_business": 12.0,
}

# --- Orders of status and severity ---------------------------------------------------
STATUS_ORDER = ["MISMATCH", "PARTIAL_MATCH", "MATCH", "UNVERIFIABLE"]
SEVERITY_ORDER = ["HIGH", "MEDIUM", "LOW", "INFO"]
FLAG_SEVERITY_ORDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
