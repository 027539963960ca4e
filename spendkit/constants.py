"""Fixed values of the domain: word lists, thresholds, column lists and texts."""

# --- Fixed values: category rules, applied in this order to the lower-cased MCC description ---
CATEGORY_KEYWORDS = (
    ("Dining", ("restaurant", "fast food", "drinking places", "eating places")),
    ("Groceries", ("grocery", "supermarkets", "miscellaneous food stores")),
    ("Utilities", ("utilities", "electric", "gas", "water", "sanitary")),
    ("Transportation", ("service stations", "tolls", "taxicabs", "limousines", "parking")),
    ("Entertainment", ("amusement", "motion picture", "theaters", "video")),
    ("Shopping", ("department stores", "discount stores", "book stores", "home furnishing", "lumber")),
    ("Transfers", ("money transfer", "transfer")),
    ("Subscriptions", ("subscription",)),
    ("Fees & Interest", ("fee", "interest")),
)

# --- Fixed values: category by MCC code prefix, used when no keyword matches ---
CATEGORY_PREFIXES = (
    ("Groceries", ("54",)),
    ("Dining", ("58",)),
    ("Utilities", ("49",)),
    ("Transportation", ("41", "47")),
    ("Shopping", ("53", "59", "52", "57")),
)

OTHER_CATEGORY = "Other/Uncategorized"
UNKNOWN_MCC = "UNKNOWN_MCC"

# --- Fixed values: categories that count against the monthly discretionary limit ---
DISCRETIONARY_CATEGORIES = ("Dining", "Entertainment", "Shopping", "Travel", "Subscriptions")

# --- Fixed values: categories a label may carry ---
TAXONOMY = (
    "Dining",
    "Groceries",
    "Utilities",
    "Transportation",
    "Entertainment",
    "Shopping",
    "Travel",
    "Housing",
    "Healthcare",
    "Education",
    "Income",
    "Transfers",
    "Subscriptions",
    "Fees & Interest",
    "Cash Withdrawal",
    "Other/Uncategorized",
)

# --- Fixed values: words in an MCC description that mark a subscription ---
SUBSCRIPTION_WORDS = (
    "subscription",
    "stream",
    "netflix",
    "spotify",
    "hulu",
    "prime",
    "membership",
    "recurring",
)

# --- Fixed values: yes/no words ---
YES_WORDS = ("yes", "y", "true", "1")
NO_WORDS = ("no", "n", "false", "0")

# --- Fixed values: CSV cells that mean "missing" ---
NULL_TOKENS = (
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

# --- Fixed values: columns that must never reach an output ---
PII_COLUMNS = ("address", "card_number", "cvv")

# --- Fixed values: identity of a merchant profile ---
PROFILE_FIELDS = (
    "mcc_code",
    "mcc_description",
    "merchant_id",
    "merchant_city",
    "merchant_state",
    "is_online",
)

# --- Fixed values: labelling knobs ---
LABEL_BATCH_SIZE = 40
LABEL_MIN_CONFIDENCE = 0.6

# --- Fixed values: label sources ---
SOURCE_LABEL = "llm"
SOURCE_LOW_CONFIDENCE = "low_confidence_fallback"
SOURCE_RULE = "mcc_fallback"
SOURCE_BASELINE = "mcc"
SOURCE_UNKNOWN_LABEL = "llm_artifact"

# --- Fixed values: recurring-merchant and cutback thresholds ---
RECURRING_LOOKBACK_DAYS = 180
RECURRING_MIN_MONTHS = 3
RECURRING_MIN_MONTHLY_USD = 10.0
RECURRING_MAX_CV = 0.75
CUTBACK_LOOKBACK_DAYS = 90
CUTBACK_SHARE = 0.15
CUTBACK_TRIES = 5
MAX_RECOMMENDATIONS = 2

# --- Fixed values: budget alerts ---
ALERT_THRESHOLDS = (0.70, 0.85, 0.95)
ALERT_CHANNELS = ("app", "email")
SHORT_RUNWAY_DAYS = 7

# --- Fixed values: features of the month-end model, in order ---
FEATURES = (
    "year",
    "month",
    "day_of_month",
    "days_in_month",
    "days_remaining_in_month",
    "mtd_discretionary_spend_usd",
    "avg_daily_discretionary_spend_7d",
    "avg_daily_discretionary_spend_30d",
    "monthly_discretionary_limit_usd",
    "mtd_utilization_pct",
    "avg7d_utilization_pct",
)
TARGET = "month_total_discretionary_spend_usd"
RIDGE_ALPHA = 1.0
TRAIN_QUANTILE = 0.8
MIN_SPLIT_ROWS = 10

# --- Fixed values: chat sessions ---
SESSION_STORED_TURNS = 40
SESSION_HISTORY_TURNS = 10
SESSION_ROLES = ("user", "assistant")

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
