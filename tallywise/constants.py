"""Names, word lists, patterns and thresholds.

Everything in this module is data that results depend on. The order of each
list is its priority order.
"""

# --- fixed values: transaction sources -------------------------------------
HOUSEHOLD = "household"
CREDIT_CARD = "credit_card"
SOURCES = [HOUSEHOLD, CREDIT_CARD]

# source, display name, min samples per category, confidence threshold,
# description type, analyzer, smallest n-gram, largest n-gram
SOURCE_SETTINGS = [
    (HOUSEHOLD, "Household Expenses", 5, 0.6, "item_level", "word", 1, 2),
    (CREDIT_CARD, "Credit Card Transactions", 3, 0.7, "merchant_name", "char_wb", 1, 3),
]

# --- fixed values: column aliases -------------------------------------------
CANONICAL_ALIASES = {
    "Date": ["Date", "DATE", "date"],
    "Description": ["Description", "DESCRIPTION", "description"],
    "Amount (Negated)": ["Amount (Negated)", "DEBIT", "debit", "Out"],
    "Amount": ["Amount", "CREDIT", "credit", "In"],
}
STAGE_RENAMES = {
    "DATE": "Date",
    "DESCRIPTION": "Description",
    "DEBIT": "Amount (Negated)",
    "CREDIT": "Amount",
}

# source, field, patterns in priority order
FIELD_PATTERNS = [
    (HOUSEHOLD, "date", ["date", "transaction_date", "trans_date", "timestamp"]),
    (HOUSEHOLD, "description", ["description", "item", "expense", "details", "memo"]),
    (HOUSEHOLD, "amount", ["amount", "cost", "price", "value", "expense_amount",
                           "out", "in", "debit", "credit"]),
    (HOUSEHOLD, "category", ["category", "type", "classification", "expense_type"]),
    (CREDIT_CARD, "date", ["date", "transaction_date", "trans_date",
                           "posting_date", "purchase_date"]),
    (CREDIT_CARD, "description", ["description", "merchant", "vendor", "payee", "details"]),
    (CREDIT_CARD, "amount", ["amount", "transaction_amount", "charge", "debit", "credit"]),
    (CREDIT_CARD, "category", ["category", "type", "classification", "merchant_category"]),
]
# field, exact names in priority order, for a spreadsheet of unknown layout
GRID_PATTERNS = {
    "date": ["date", "transaction_date", "trans_date", "posting_date"],
    "description": ["description", "merchant", "vendor", "payee", "details", "item"],
    "amount": ["amount", "transaction_amount", "charge", "debit", "credit", "value"],
}

# --- fixed values: source detection -----------------------------------------
HOUSEHOLD_NAME_WORDS = ["house", "kitty", "household", "cash", "expenses", "grocery",
                        "utilities", "rent", "mortgage", "home"]
CARD_NAME_WORDS = ["visa", "mastercard", "amex", "discover", "card", "credit",
                   "bank", "statement", "purchase", "merchant"]
HOUSEHOLD_COLUMN_HINTS = ["item", "expense", "grocery"]
CARD_COLUMN_HINTS = ["merchant", "vendor", "payee"]
CARD_WEAK_COLUMN_HINTS = ["card", "credit"]
HOUSEHOLD_TEXT_HINTS = ["grocery", "supermarket", "gas", "utilities", "rent", "insurance"]
CARD_TEXT_HINTS = ["visa", "mastercard", "payment", "purchase", "pos"]
CONTENT_SAMPLE_ROWS = 100
DATE_SAMPLE_ROWS = 10
MIN_FILE_ROWS = 10

# --- fixed values: statement layout -----------------------------------------
STATEMENT_MARKERS = ["ACCOUNT NAME", "CARD NUMBER", "STATEMENT BALANCE",
                     "PAYMENT DUE DATE", "TOTAL AMOUNT DUE"]
STATEMENT_MIN_MARKERS = 3
STATEMENT_PREAMBLE_ROWS = 13
# header row and the first 15 data rows
STATEMENT_SAMPLE_ROWS = 16

# --- fixed values: file names -----------------------------------------------
STAGES = ["input", "predictions", "corrected", "accounting", "training"]
SOURCE_NAME_MAP = [
    ("unionbank", "unionbank_visa"),
    ("union bank", "unionbank_visa"),
    ("unionbank visa", "unionbank_visa"),
    ("bpi", "bpi_mastercard"),
    ("bpi mastercard", "bpi_mastercard"),
    ("metrobank", "metrobank_visa"),
    ("house", "household_cash"),
    ("household", "household_cash"),
    ("kitty", "household_cash"),
    ("cash", "household_cash"),
]
UPLOAD_EXTENSIONS = [".csv", ".xlsx", ".xls"]
UPLOAD_MAX_BYTES = 10 * 1024 * 1024

# --- fixed values: money text -----------------------------------------------
CURRENCY_MARKS = ["$", "€", "£", "¥", "₱", "PHP", "USD", "EUR"]
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# --- fixed values: thresholds -----------------------------------------------
LOW_CONFIDENCE = 0.5
REVIEW_CONFIDENCE = 0.7
ALERT_LOW_RATE = 0.2
ALERT_MEAN = 0.6
MIN_CATEGORY_SAMPLES = 5
RARE_SHARE = 0.01
TRAINING_MIN_ROWS = 50
TEST_FRACTION = 0.2
SPLIT_SEED = 42

# --- fixed values: training-set defaults ------------------------------------
DEFAULT_ACCOUNT = {
    HOUSEHOLD: "Assets:Current Assets:Cash Local:Cash for Groceries",
    CREDIT_CARD: "Liabilities:Credit Card",
}

# --- fixed values: text features --------------------------------------------
MAX_FEATURES = 5000
MIN_DF = 2
MAX_DF = 0.95
# word characters are letters, digits and underscore of any script; the plain
# ranges come first because they are tested fastest
TOKEN_PATTERN = r"[a-z0-9_\p{L}\p{N}]{2,}+"

# --- fixed values: category families ----------------------------------------
STAFF_BASE = "Expenses:Household Staff"
LOAN_ASSET_BASE = "Assets:Loans to"
LOAN_LIABILITY_BASE = "Liabilities:Other"
BANK_LOCAL_BASE = "Assets:Current Assets:Banks Local"
BANK_FOREIGN_BASE = "Assets:Current Assets:Banks Foreign"
INVESTMENT_BASE = "Assets:Investments"

# --- fixed values: model components -----------------------------------------
REQUIRED_COMPONENT = "tfidf_vectorizer"
OPTIONAL_COMPONENT = "label_encoder"
