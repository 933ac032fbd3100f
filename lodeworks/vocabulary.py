"""Closed vocabularies and bounds of the data model (fixed values)."""

STATUSES = ("PENDING", "PROCESSING", "COMPLETED", "SKIPPED", "FAILED")
JOB_STATES = ("READY", "RUNNING", "WAITING_SOURCE", "COMPLETED", "FAILED")
STAGES = ("emails", "pdfs", "images", "docx", "embed")
ADDRESS_KINDS = ("from", "to", "cc", "bcc", "reply_to")
RELATIONS = ("parent", "attachment", "sibling")

# Reasons by class; a reason in none of them needs an operator's decision.
DECLINE_REASONS = (
    "UNSUPPORTED_FORMAT", "RECURSION_LIMIT", "IMAGE_NOT_VIABLE", "OCR_UNAVAILABLE", "NUL_BYTES", "PDF_ENCRYPTED",
    "PDF_DAMAGED", "IMAGE_UNREADABLE", "ARCHIVE_ENCRYPTED", "ARCHIVE_TOO_LARGE", "ARCHIVE_DAMAGED", "DOCUMENT_PRUNED",
)
RETRYABLE_REASONS = ("EXTRACTION_FAILED", "EMPTY_EXTRACTION", "OCR_FAILED", "PDF_OPEN_FAILED", "EMAIL_PARSE_FAILED", "EMBEDDING_UNAVAILABLE")
TERMINAL_REASONS = ("UNKNOWN_ENCODING", "MISSING_TRACE_CONTEXT", "MALFORMED_COMMAND", "HANDLER_PANIC", "STORE_REJECTED")
UNDECIDED_REASON = "UNCLASSIFIED"

MAX_ATTEMPTS, LEASE_S, HANDLER_S, BUSY_S = 3, 300, 3600, 30
BACKOFF_S, BACKOFF_MAX_S = 60, 300
DENSE_K, LEXICAL_K, FUSED_K, RRF_K, TOP_K = 50, 50, 24, 60, 15
POOL_PER_QUERY, POOL_DENSE_ONLY = 4, 6
BUDGET_BYTES, SNIPPET_BYTES, CONTEXT_CHARS = 120_000, 240, 240
PAGE_DEFAULT, PAGE_MAX = 25, 200
MAX_DEPTH, MAX_ROUTES = 8, 128
CHUNK_CHARS, OVERLAP_CHARS, BOUNDARY_PART = 2048, 256, 0.4
BATCH_CHUNKS, BATCH_TOKENS = 64, 16_000
BM25_K1, BM25_B = 1.2, 0.75
#: Least values of recall, reciprocal rank, gain, empty-case passes and recall of the approximate index.
THRESHOLDS = {"recall": 0.70, "mrr": 0.50, "ndcg": 0.50, "empty": 1.0, "ann": 0.85}
