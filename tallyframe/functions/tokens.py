"""The token sets the results depend on."""

# Text that counts as missing, compared trimmed and lower-cased.
MISSING_TOKENS = ("", "nan", "none", "null", "na", "n/a", "missing", "undefined")

# Boolean spellings used for profiling.
TRUE_TOKENS = ("true", "yes", "1")
FALSE_TOKENS = ("false", "no", "0")

# The wider boolean spellings accepted as model input.
MODEL_TRUE_TOKENS = ("true", "yes", "1", "y", "t")
MODEL_FALSE_TOKENS = ("false", "no", "0", "n", "f")

# Cell texts a CSV reader turns into null (the pandas defaults).
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Whitespace removed around cell texts (Spark's trim removes spaces only).
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
