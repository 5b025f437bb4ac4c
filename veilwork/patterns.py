"""Fixed values that results depend on, stated once.

The two pattern tables are in Python ``re`` syntax, which defines what a match is.
``functions/regex.py`` states the same matches in Java syntax for Spark.
"""

# --- fixed values -----------------------------------------------------------------------------

# Applied in this order, each on the output of the one before.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(\+\d{1,2}\s?)?1?\-?\.?\s?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[\s\-]?[A-Z\d]{4}[\s\-]?[A-Z\d]{4}[\s\-]?[A-Z\d]{4}[\s\-]?[A-Z\d]{1,4}\b",
}

# Searched without regard to case.
TABLE_INDICATORS = {
    "p1": r"\|\s*[\w\s]+\s*\|",
    "p2": r"\+[-]+\+",
    "p3": r"[\w\s]+\s+\|\s+[\w\s]+",
    "p4": r"\b(table|tab\.?|tbl)\b",
    "p5": r"\s{4,}[\w\s]+\s{4,}[\w\s]+",
    "p6": r"\t+[\w\s]+\t+[\w\s]+",
}

PII_MARKER = "[PII_REMOVED]"
NER_LABELS = ("PERSON", "ORG", "GPE")
ACCEPTED_TYPES = (".txt", ".docx", ".pdf")
PDF_ENGINES = ("pymupdf_single_pass", "pymupdf_text_only")
OCR_ENGINE = "paddle"
LOGO_TEXTS = ("stc", "sic")

HEADER_RATIO = 0.08
MAX_FILES = 10
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_BATCH_BYTES = 100 * 1024 * 1024
THUMBNAIL_LIMIT_BYTES = 10000
REPORT_IMAGE_WIDTH = 400
REPORT_IMAGE_HEIGHT = 300
VOTES_NEEDED = 3

OCR_REASONS = {
    "throughput": "[OCR disabled in throughput mode]",
    "disabled": "[OCR disabled]",
    "missing": "[OCR not available]",
    "cap": "[OCR skipped: max images reached]",
    "no_data": "[OCR skipped: no image data]",
    "unlikely": "[OCR skipped: low-text likelihood]",
    "no_text": "[No text detected in image]",
}

# --- end of fixed values ----------------------------------------------------------------------
