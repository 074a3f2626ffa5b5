"""Schemas, column roles and the fixed business constants.

Column names inside the engine are English, ASCII and snake_case; the
``ALIASES`` map turns the source system's names into them (P22).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the source system's business rules).
# ---------------------------------------------------------------------------
# Deletion types: 0 = active; 1, 2, 5 = withdrawal; 3, 4, 6, 7 = termination.
WITHDRAWAL_TYPES = (1, 2, 5)
TERMINATION_TYPES = (3, 4, 6, 7)
TERMINATION_TYPES_PREMIUM = (3, 4, 6)
# Products.
PRODUCT_MAIN = 3402
PRODUCT_SECOND = 3783
# Campaign whose cells are split by premium amount.
SPLIT_CAMPAIGN = "FO-SCL"
# Call-center new-business fee per contract: 59.9 after the threshold month, else 49.9.
CPO_FEE_AFTER = 59.9
CPO_FEE_BEFORE = 49.9
# UFC tariff per premium amount.
UFC_TARIFF = {9.9: 107.9949, 14.9: 162.5167, 19.9: 217.0588, 24.9: 271.6009, 29.9: 326.1226}
UFC_CLAWBACK_MONTHS = 24
# Premium commission: 27.90 + 0.53 * (3 yearly premiums); linear claw-back over 36 months.
PREMIUM_BASE = 27.90
PREMIUM_RATE = 0.53
PREMIUM_YEARS = 3
PREMIUM_CLAWBACK_MONTHS = 36
# Threshold month of the fee switch (source system value; the test view uses 199806).
DEFAULT_THRESHOLD = 202206
# Leakage name patterns (lower case); ``event`` is always kept.
LEAKAGE_COLUMNS = ("deletion_allowed_at", "promised_deletion_date", "last_due_date",
                   "days_until_deletion_allowed", "deletion_type", "del_month")
LEAKAGE_PATTERNS = ("deletion", "kündig", "cancel")
# Fixed histogram edges for cancellation times (days).
CANCEL_TIME_EDGES = (0, 30, 60, 90, 180, 365, 1000)
DURATION_BIN_EDGES = (0, 30, 90, 180, 365, 730, 1200)
# Survival horizons (days).
KM_HORIZONS = (30, 90, 180, 365)
KM_CHECK_TIMES = (90, 180, 365, 730)
KM_DURATION_CAP = 1200

# Reference-system column names -> engine names.
ALIASES = {
    "ID": "id",
    "VP Vertragsnummer": "contract_no",
    "Campaign No_": "campaign_no",
    "Call Center": "call_center",
    "Kampagne": "campaign",
    "Customer Name": "campaign",
    "Customer_Name": "campaign",
    "Product Code": "product_code",
    "Country_Region Code": "region_code",
    "Amount": "amount",
    "Deletion Type": "deletion_type",
    "Start Insurance": "start_insurance",
    "Start_Insurance": "start_insurance",
    "End Insurance": "end_insurance",
    "FirstDueDate": "first_due_date",
    "Last Due Date": "last_due_date",
    "Deletion allowed at": "deletion_allowed_at",
    "Promised Deletion Date": "promised_deletion_date",
    "Meldedatum": "report_date",
    "RKMDAT": "acq_month",
    "DELLAT": "del_month",
    "Birthday": "birthday",
}

CONTRACTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("campaign", T.StringType()),
    T.StructField("call_center", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("deletion_type", T.IntegerType()),
    T.StructField("product_code", T.IntegerType()),
    T.StructField("region_code", T.StringType()),
    T.StructField("start_insurance", T.DateType()),
    T.StructField("end_insurance", T.DateType()),
    T.StructField("first_due_date", T.DateType()),
    T.StructField("last_due_date", T.DateType()),
    T.StructField("deletion_allowed_at", T.DateType()),
    T.StructField("report_date", T.DateType()),
    T.StructField("acq_month", T.IntegerType()),
    T.StructField("del_month", T.IntegerType()),
])

# Columns each job family needs.
SETTLEMENT_REQUIRED = ("product_code", "campaign", "acq_month", "del_month", "deletion_type", "amount")


@dataclass(frozen=True)
class SettlementParams:
    """Parameters of a settlement run; defaults are the business values."""

    threshold: int = DEFAULT_THRESHOLD
    split_campaign: str = SPLIT_CAMPAIGN
    fee_after: float = CPO_FEE_AFTER
    fee_before: float = CPO_FEE_BEFORE
    ufc_tariff: dict = field(default_factory=lambda: dict(UFC_TARIFF))
    clawback_months: int = UFC_CLAWBACK_MONTHS
    withdrawal_sign: int = -1
