"""Fixed values.

Everything in this module is data that results depend on: labels, header
texts, tokens, rates and limits. Change them through ``Settings`` or through
your own ``Contract`` objects, not here.
"""

# Cell texts that the extract readers treat as "no value".
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# The characters that count as white space at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Text of a missing cell, and the label that replaces it.
MISSING_TEXT = "nan"
UNKNOWN = "Unknown"

# First calendar year taken as a real incident date.
FIRST_VALID_YEAR = 2000

# File name patterns per source, the preferred format first.
SOURCE_PATTERNS = {
    "Radius": ("*Radius*MDA*.csv", "*Radius*MDA*.json", "*Radius*MDA*.parquet"),
    "Fusion": ("*Fusion*Quality*.csv", "*Fusion*Quality*.json", "*Fusion*Quality*.parquet"),
    "Vision_OAK": ("*Vision*OAK*.csv", "*Vision*OAK*.json", "*Vision*OAK*.parquet"),
    "Vision_MAS": ("*Vision*MAS*.csv", "*Vision*MAS*.json", "*Vision*MAS*.parquet"),
    "OBI": ("*Feedback*Report*01QUALC009*.csv", "*Feedback*Report*01QUALC009*.xls"),
}

# Plant -> factor to US dollars; any other plant counts as 1.
FX_RATES = {
    "MCC Monterrey": "0.05",
    "MCC Guadalajara": "0.05",
    "MCC Montreal": "0.74",
}

# Alert limits in US dollars.
SINGLE_INCIDENT_USD = 50_000
WEEKLY_TOTAL_USD = 200_000

# Lower limits (inclusive) of the customer risk tiers, and the window in days.
HIGH_RISK_USD = 100_000
MEDIUM_RISK_USD = 30_000
RISK_WINDOW_DAYS = 90
RISK_TIERS = ("High", "Medium", "Low")

# Sizes of the ranked tables.
TOP_DEFECTS = 10
TOP_CUSTOMERS = 15
REPORT_DEFECTS = 15
REPORT_CUSTOMERS = 20
REPORT_PAIRS = 15
HEATMAP_ROWS = 10
PARETO_RANGE = (5, 20)

# Column headers of the display tables.
DETAIL_HEADERS = {
    "incident_date": "Incident Date",
    "source": "Source System",
    "plant": "Plant",
    "customer": "Customer",
    "defect_category": "Defect Category",
    "credit_requested_usd": "Credit Requested (USD)",
    "qty_affected": "Quantity Affected",
}
SCORECARD_HEADERS = {
    "risk_tier": "Risk Classification",
    "customer": "Customer",
    "incidents": "Incidents",
    "credit_usd": "Total Credit (USD)",
    "avg_credit_usd": "Avg Credit (USD)",
    "max_credit_usd": "Max Credit (USD)",
    "top_defect": "Primary Defect Type",
    "plants": "No. of Plants",
    "sources": "Source Systems",
}
ALERT_COLUMNS = (
    "incident_date",
    "source",
    "customer",
    "plant",
    "credit_requested_usd",
    "defect_category",
    "status",
)


# First rows of the plant table (plant, region, country, system, currency).
PLANTS = (
    ("Rochester", "Northeast", "US", "Fusion", "USD"),
    ("OAK CREEK PLANT", "Midwest", "US", "Vision", "USD"),
    ("MASON PLANT", "Midwest", "US", "Vision", "USD"),
    ("MCC Louisville", "Midwest", "US", "Radius", "USD"),
    ("MCC Elkton", "South", "US", "Radius", "USD"),
    ("MCC Napa", "West", "US", "Radius", "USD"),
    ("MCC Clarksville", "South", "US", "Radius", "USD"),
    ("MCC Scottsburg", "Midwest", "US", "Radius", "USD"),
    ("MCC Algoma", "Midwest", "US", "Radius", "USD"),
    ("MCC Batavia", "Northeast", "US", "Radius", "USD"),
    ("MCC Knoxville", "South", "US", "Radius", "USD"),
    ("MCC Lafayette Hill", "Northeast", "US", "Radius", "USD"),
    ("MCC Winona", "Midwest", "US", "Radius", "USD"),
    ("MCC York", "Northeast", "US", "Radius", "USD"),
    ("MCC Fullerton", "West", "US", "Radius", "USD"),
    ("MCC Neenah", "Midwest", "US", "Radius", "USD"),
    ("MCC Chesapeake", "South", "US", "Radius", "USD"),
    ("MCC Humacao PR", "Caribbean", "US", "Radius", "USD"),
    ("MCC San Luis Obispo", "West", "US", "Radius", "USD"),
    ("MCC Asheville", "South", "US", "Radius", "USD"),
    ("MCC Monterrey", "North", "MX", "Radius", "MXN"),
    ("MCC Guadalajara", "West", "MX", "Radius", "MXN"),
    ("MCC Montreal", "Quebec", "CA", "Radius", "CAD"),
    ("Bowling Green Plant", "South", "US", "OBI", "USD"),
    ("Fountain Inn Plant", "South", "US", "OBI", "USD"),
    ("Fort Worth Plant", "South", "US", "OBI", "USD"),
    ("Niles Plant", "Midwest", "US", "OBI", "USD"),
    ("Tyrone Plant", "Northeast", "US", "OBI", "USD"),
    ("Provo Plant", "West", "US", "OBI", "USD"),
    ("Waukesha Plant", "Midwest", "US", "OBI", "USD"),
)
