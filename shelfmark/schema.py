"""Product schema and the fixed values that results depend on."""

from __future__ import annotations

# Columns of the raw product table, with their types.
RAW_FIELDS = [
    ("Pid", "string"),
    ("Description", "string"),
    ("Name", "string"),
    ("Category", "string"),
    ("Price", "double"),
    ("PriceCurrency", "string"),
    ("FinalPrice", "double"),
    ("Discount", "double"),
    ("isOnSale", "boolean"),
    ("IsInStock", "boolean"),
    ("Brand", "string"),
    ("Manufacturer", "string"),
    ("Color", "string"),
    ("Gender", "string"),
    ("Size", "string"),
    ("Condition", "string"),
]
RAW_COLUMNS = [name for name, _ in RAW_FIELDS]
NUMERIC_COLUMNS = [name for name, kind in RAW_FIELDS if kind == "double"]
BOOLEAN_COLUMNS = [name for name, kind in RAW_FIELDS if kind == "boolean"]

CLEAN_COLUMNS = [c for c in RAW_COLUMNS if c not in ("Brand", "Manufacturer")] + ["MergedBrand"]

# Columns a product file must have.
REQUIRED_COLUMNS = ["Pid", "Name", "Description", "Category", "Price", "PriceCurrency"]

# Columns that make up the searchable text, in order.
DOCUMENT_COLUMNS = ["Name", "Category", "MergedBrand", "Color", "Gender", "Size", "Condition"]

# Currencies kept by the cleaning step.
CURRENCIES = ["USD", "CAD", "GBP"]

# Words read as true and as false.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]

# The texts that pandas.read_csv takes as missing by default.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Component weights (text, image vector, fusion vector) per query modality.
MODALITY_WEIGHTS = {
    "text": (0.5, 0.0, 0.5),
    "image": (0.0, 1.0, 0.0),
    "multimodal": (0.5, 0.0, 0.5),
}
COMPONENT_ORDER = ("text", "image_vector", "fusion_vector")

# Fixed value: the reasoning of a reply that gives none.
NO_REASONING = "No reasoning provided"
# The reasoning where no model is asked.
NO_MODEL = "No API key available, no LLM reordering performed"
IMAGE_ONLY = "Image search only, no LLM reordering performed"
#: Share of the results asked for that is shown to the model.
RERANK_SHARE = 0.3

RERANK_WINDOW = 30
RERANK_FIELDS = ["Name", "Brand", "Category", "Color", "Gender", "Size", "Price"]
PAGE_SIZE = 20
CHUNK_ROWS = 500_000

# Scores are compared at this precision, then by id, so that ties do not hang on summation order.
SCORE_DECIMALS = 6
