"""Patterns, word lists, bands and limits whose exact content decides results.

They are plain text in natural order. Lists that describe one customer's vocabulary are not
here; such lists are parameters of the operators.
"""

# A Unicode word character: letters, digits, underscore. Java and RE2 both read this class the
# same way, unlike their \w, which is ASCII only.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Whole lines that are a table-of-contents footer (matched on the stripped line, any case).
TOC_FOOTER_LINES = [
    r"table of contents\s*",
    r"table\s+of\s+contents\s*",
    r"toc\s*",
    r"contents\s*",
    r"\s*\.\.\.\s*table\s+of\s+contents\s*\.\.\.\s*",
    r"\s*-+\s*table\s+of\s+contents\s*-+\s*",
    r"\s*table\s+of\s+contents\s+page\s+\d+\s*",
]
# Lines that may open a real table of contents.
TOC_HEADER_LINES = [r"table\s+of\s+contents\s*", r"contents\s*"]
# What the next lines of a real table of contents show.
TOC_STRUCTURE = r"\.\.\.\.\d+|chapter\s+\d+|\d+\.\d+"
# Whole lines that are noise (matched on the stripped line, any case).
NOISE_LINES = [
    r"\s*page\s+\d+\s*",
    r"\s*\d+\s*",
    r"\s*\.\s*",
    r"\s*-+\s*",
    r"\s*=+\s*",
    r"\s*_+\s*",
    r"\s*\*+\s*",
]

# Chunk size and overlap limits.
MIN_CHUNK_SIZE, MAX_CHUNK_SIZE, CAPPED_CHUNK_SIZE = 200, 2000, 1500
MIN_OVERLAP, RAISED_OVERLAP = 100, 150
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]
BASIC_SEPARATORS = ["\n\n", "\n", " ", ""]

# Capitalised words that are no key terms.
COMMON_CAPITALISED = ["The", "A", "An", "And", "Or", "But", "If", "Then", "So", "As", "In", "On", "At"]

# Phrases that mark a context without an answer.
FAILURE_PHRASES = [
    "no relevant information found",
    "answer not found",
    "please contact a manager",
    "error:",
    "failed to",
]
NO_CONTEXT = "No relevant information found."

# Answers that deflect the question.
GENERIC_ANSWERS = [
    "I'm sorry, but I can't provide assistance with that",
    "Please reach out to a manager",
    "I cannot help with that",
    "I'm unable to assist",
    "That's not something I can help with",
]

# Confidence above this percentage has this description.
CONFIDENCE_BANDS = [
    (90, "Answer is directly stated in the context with high certainty"),
    (80, "Answer is well-supported by the context"),
    (70, "Answer is supported by the context with some inference"),
    (60, "Answer requires moderate inference from context"),
    (50, "Answer is partially supported with significant uncertainty"),
    (30, "Answer involves substantial inference and uncertainty"),
]
CONFIDENCE_FLOOR = "Answer has very limited support from the context"

# Wordings that set two terms apart (general part of the list).
TERM_DISTINCTIONS = [
    r"(?:different|distinct) (?:types?|categories|classifications) of [\p{L}\p{N}_\s]+",
    r"(?:not to be confused with|distinguished from|different from) [\p{L}\p{N}_\s]+",
    r"[\p{L}\p{N}_]+ (?:refers to|means|is defined as) [^,.]+, while [\p{L}\p{N}_]+ (?:refers to|means|is defined as) [^,.]+",
    r"[\p{L}\p{N}_]+ and [\p{L}\p{N}_]+ are (?:different|distinct) [\p{L}\p{N}_\s]+",
    r"[\p{L}\p{N}_]+ (?:is classified as|is categorized as|falls under) [\p{L}\p{N}_\s]+",
]
# Pairs of words that contradict each other in one answer (general part of the list).
CONFUSED_TERMS = [
    (r"\bfree\b.*?\b(?:charge|cost|fee|price)\b", "free items carry no charge"),
    (r"\bbillable\b.*?\b(?:free|no charge|no cost)\b", "billable items are not free"),
]

# Marks of a specific answer.
SPECIFIC_MARKS = ["$", "phone", "number", "address", "time", "date", "percent", "%"]

# Words behind the answer indicator flags.
STEP_WORDS = ["step", "first", "then", "next", "finally"]
ACTION_WORDS = ["click", "go to", "navigate", "select", "enter"]
CONTACT_WORDS = ["phone", "number", "contact", "call"]
PROCEDURE_WORDS = ["procedure", "process", "method", "way to"]
TOOL_VERBS = ["use", "open", "access", "login"]
OUTCOME_WORDS = ["result", "outcome", "complete", "finish"]
UNSURE_WORDS = ["i don't know", "not sure", "maybe"]

# Words of procedural chunks, process words and concern words.
PROCEDURAL_WORDS = ["step", "how to", "process", "procedure", "follow"]
LIST_MARKS = ["-", "•", "1.", "2."]
CONCERN_WORDS = ["concern", "customer concern", "complaint"]
PROCESS_WORDS = ["create", "develop", "submit", "process", "step", "how to"]
FOLLOW_WORDS = ["step", "follow", "how to"]

# BM25 constants.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# Facts: telephone numbers, numbers, money.
PHONE = r"\d{3}[-.]?\d{3}[-.]?\d{4}"
NUMBER = r"\d+"
MONEY = r"\$\d+(?:\.\d{2})?"

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://[\w.-]+(?::\d+)?(?:/[\w/.]*(?:\?[\w&=%.]*)?(?:#\w*)?)?$"

# Retrieval plans of the evaluation grid.
PLAN_NAMES = ["vector_only", "reranker_only", "splade_only", "reranker_then_splade", "splade_then_reranker"]
# Older names and the plan each stands for.
PLAN_ALIASES = {"vector": "vector_only", "rerank": "reranker_only", "reranking": "reranker_only",
                "sparse": "splade_only", "splade": "splade_only", "keyword": "hybrid"}

# Evaluation grid axes and the wider axes of the random part.
GRID_MODELS = ["intfloat/e5-base-v2", "BAAI/bge-base-en-v1.5", "intfloat/e5-large-v2"]
GRID_CHUNK_SIZES = [256, 512, 1024]
GRID_RERANK_DEPTHS = [20, 40, 60]
SAMPLE_CHUNK_SIZES = [256, 384, 512, 768, 1024]
SAMPLE_EXPANSION = [75, 100, 125, 150, 175, 200, 250]
SAMPLE_SPARSE_LENGTHS = [128, 256, 384, 512, 768, 1024]
SAMPLE_TOP_K = [10, 15, 20, 25, 30]
SAMPLE_RERANK_DEPTHS = [15, 20, 30, 40, 50, 60]
