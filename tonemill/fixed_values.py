"""Fixed values that results depend on, kept in one place."""

# Sentiment class names by label.
CLASS_NAMES = ["Negative", "Neutral", "Positive"]
UNKNOWN_CLASS = "Unknown"

# Ids of the special tokens; corpus tokens follow from FIRST_TOKEN_ID.
PAD_ID = 0
UNK_ID = 1
CLS_ID = 2
SEP_ID = 3
FIRST_TOKEN_ID = 4

# Text patterns. Java's \s, \S and \w are ASCII only unless (?U) is set, and even
# then leave out the four separators U+001C..U+001F, which count as blanks here.
BLANKS = r"\s\x1c-\x1f"
URL_PATTERN = rf"(?U)http[^{BLANKS}]+"
JUNK_PATTERN = rf"(?U)[^a-z0-9{BLANKS}]"
BLANK_RUN_PATTERN = rf"(?U)[{BLANKS}]+"
WORD_PATTERN = r"(?U)\w+"

# Text preview and pooling.
PREVIEW_CHARS = 100
MASKED_VALUE = -1e9

# CSV cells. Blank text must stay apart from a missing value.
CSV_NULL = r"\N"

# Defaults of the training and evaluation runs.
DEFAULT_SEED = 42
DEFAULT_PATIENCE = 5
DEFAULT_DELTA = 0.001
HISTOGRAM_BINS = 20
TOP_CONFUSIONS = 5
SPOT_CHECK_ROWS = 10
