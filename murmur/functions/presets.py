"""Fixed values that must equal the original pipeline's for identical results.

Everything below is data, not logic: keyword presets, stop-word lists, theme
patterns, the closed label set, the annotation codebook's signal phrases and
the annotator prompt layout. They are stated plainly and in their original
order. Operators take them as parameters, so a job may pass other lists.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword eligibility preset used for corpus selection (90).
# ---------------------------------------------------------------------------
SELECTION_KEYWORDS = (
    "cyber security act", "cyber crimes act", "cyber crime bill",
    "cyber security act no. 3", "cybercrime", "cybercrimes",
    "cyber security", "cyber crime", "cyber law", "cyber bill",
    "cyber legislation", "cyber amendment",
    "section 3", "section 4", "section 5", "section 6", "section 10",
    "section 19", "section 21", "section 22", "section 24",
    "section 29", "section 31", "section 34", "section 36", "section 37",
    "section 39", "section 40",
    "critical information", "misleading information", "false information",
    "domestic terrorism", "ethnic division", "ethnic divisions",
    "indecent", "vulgar", "humiliate",
    "law association of zambia", "laz", "zctu",
    "zambia congress of trade unions", "high court", "us embassy",
    "constitutional", "unconstitutional", "civil liberties",
    "freedom of expression", "free speech", "human rights",
    "surveillance", "surveillance state", "interception",
    "data protection", "digital rights", "chilling effect",
    "criminalise", "criminalize", "criminalised", "criminalized",
    "dictator", "dictatorship", "authoritarian", "tyranny", "tyrant",
    "police state", "oppression", "oppress", "gag", "totalitarian", "regime",
    "imprisonment", "years imprisonment", "life imprisonment", "jail",
    "arrested",
    "assent", "enacted", "act of parliament", "gazette",
    "draconian", "repressive", "vague", "overreach",
    "privacy", "monitor", "monitored", "spy", "spying", "silence",
    "silenced",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword preset of the annotation stage (35).
# ---------------------------------------------------------------------------
ANNOTATION_KEYWORDS = (
    "cyber security act", "cyber crimes act", "cybercrime", "cybercrimes",
    "cyber security", "cyber crime", "cyber law", "digital rights",
    "section 22", "section 42", "section 11", "section 8", "section 15",
    "section 3", "part iii", "part ii", "surveillance", "interception",
    "false information", "offensive communication", "chilling effect",
    "zambia cyber", "cyber bill", "cyber amendment", "cyber legislation",
    "data protection", "freedom of expression", "free speech",
    "unconstitutional", "vague", "draconian", "repressive",
    "zctu", "zambia congress", "trade union cyber",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — text normalisation.
# ---------------------------------------------------------------------------
# Negation words are kept by the stop filter (22).
NEGATORS = (
    "no", "not", "nor", "none", "never", "cannot", "cant", "wont", "dont",
    "doesnt", "didnt", "isnt", "arent", "wasnt", "werent", "shouldnt",
    "wouldnt", "couldnt", "against", "without", "nothing", "neither",
)
# Fallback English stop list used when no external list is available (39).
BASIC_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from",
    "has", "have", "he", "her", "his", "i", "in", "is", "it", "its", "of",
    "on", "or", "our", "she", "that", "the", "their", "them", "they", "this",
    "to", "was", "we", "were", "with", "you", "your",
)
# Extra stop words of the topic model (44); applied before and after lemmas.
TOPIC_STOPWORDS = (
    "law", "cyber", "act", "zambia", "zambian", "people", "government",
    "get", "go", "one", "said", "say", "like", "even", "also", "us",
    "will", "new", "bill",
    "not", "good", "think", "need", "much", "time", "thing", "something",
    "would", "want", "wanted", "see", "let", "well", "please", "come",
    "know", "understand", "read", "back", "work", "start", "comment",
    "medium", "country",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — closed sentiment label set; its order is part of every output.
# ---------------------------------------------------------------------------
LABELS = ("NEGATIVE", "NEUTRAL", "POSITIVE")
AI_LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL", "UNCERTAIN", "ERROR")
REVIEW_LABELS = ("UNCERTAIN", "ERROR")
CONFIRMED_CONFIDENCE = ("HIGH", "MEDIUM")

# ---------------------------------------------------------------------------
# FIXED VALUES — dashboard theme patterns (case-insensitive, Unicode \w / \b).
# ---------------------------------------------------------------------------
THEMES = {
    "Cyber legislation": r"\bcyber(?:\s+security|\s+crime|crime|crimes|\s+law|\s+bill)",
    "Surveillance and privacy": r"\b(?:surveillance|privacy|spy|spying|interception|monitor|monitored)\b",
    "Freedom of expression": r"\b(?:freedom of expression|free speech|human rights|digital rights|gag|silenc\w*|censor\w*)\b",
    "Authoritarianism": r"\b(?:dictator\w*|authoritarian\w*|tyranny|tyrant|police state|oppress\w*|totalitarian|regime)\b",
    "Penalties and enforcement": r"\b(?:imprisonment|jail|arrested|penalty|prison|enforcement)\b",
    "Legal process": r"\b(?:constitutional|unconstitutional|assent|enacted|gazette|high court|section\s+\d+)\b",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — personal columns removed at ingest.
# ---------------------------------------------------------------------------
PII_FIELDS = ("profileUrl", "profilePicture", "profileId", "profileName", "id", "feedbackId")

# ---------------------------------------------------------------------------
# FIXED VALUES — annotation codebook: domain terms with fixed orientation and
# the example signal words of each class, as listed in the codebook.
# ---------------------------------------------------------------------------
CODEBOOK_NEGATIVE = (
    "chilling effect", "surveillance state", "surveillance tool",
    "criminalise online speech", "unconstitutional", "violates rights",
    "political tool", "weaponise", "vague", "poorly drafted", "lacks clarity",
    "dangerous", "repressive", "silence", "surveillance", "criminalise",
    "threat", "overreach", "concerned", "worried", "wrong", "reject", "oppose",
    "draconian", "abuse", "blind",
)
CODEBOOK_POSITIVE = (
    "long overdue", "much needed", "good move", "good job", "well done",
    "welcome", "protect", "finally", "progress", "commend", "support",
    "applaud", "safe", "secure", "accountability", "justice",
)
CODEBOOK_NEUTRAL = (
    "signed into law", "provides that", "states", "what does the act say",
    "an amendment is", "defines", "according to",
)
# Terms with fixed orientation (rule 6).
CODEBOOK_FIXED = (
    "chilling effect", "surveillance state", "surveillance tool",
    "criminalise online speech", "long overdue", "much needed",
    "unconstitutional", "violates rights", "political tool", "weaponise",
    "vague", "poorly drafted", "lacks clarity", "good move", "good job",
    "well done",
)
# Words that negate the signal after them (rule 3), as they stand once
# punctuation is a space, and words that may stand between.
CODEBOOK_NEGATORS = (
    "not", "no", "never", "cannot", "isn t", "aren t", "wasn t", "weren t",
    "don t", "doesn t", "didn t", "won t", "can t",
)
CODEBOOK_BETWEEN = ("a", "an", "the", "at all", "very", "really", "so", "too", "even")
# Fewer meaningful words than this and no signal -> UNCERTAIN (rule 8).
SHORT_COMMENT_WORDS = 5

# ---------------------------------------------------------------------------
# FIXED VALUES — annotator input layout; the parent title is cut to 300 chars.
# ---------------------------------------------------------------------------
PROMPT_TITLE_CHARS = 300
PROMPT_HEAD = "Classify the following Facebook comment."
PROMPT_TITLE_HEADER = "PARENT POST TITLE (context only — do not label this):"
PROMPT_COMMENT_HEADER = "COMMENT TEXT:"
ERROR_MESSAGE_CHARS = 100
CONNECTION_FAILURE_RULE = "Connection error"
OTHER_FAILURE_RULE = "API error"
PARSE_FAILURE = ("UNCERTAIN", "LOW", "JSON parse error — model output malformed.", "Parse failure")

# ---------------------------------------------------------------------------
# FIXED VALUES — model settings of the original runs.
# ---------------------------------------------------------------------------
SEED = 42
PREVIEW_CHARS = 140
TOP_WORDS = 12
REPRESENTATIVE_DOCS = 5
MAX_SEQUENCE_LEN = 60
NUM_WORDS = 20000
COHERENCE_WINDOW = 110

# ---------------------------------------------------------------------------
# FIXED VALUES — model settings of the reference's training jobs.
# ---------------------------------------------------------------------------
W2V_DIM = 300
W2V_EPOCHS = 30
LDA_PASSES = 15
LDA_SEARCH_PASSES = 8
LDA_K_RANGE = (3, 10)
DICTIONARY_TERMS = 100_000
FOLDS = 10
TEXT_GRID = {"n_max": (1, 2), "max_features": (10_000, 20_000, None), "c": (0.1, 1.0, 10.0)}
DENSE_GRID = (("linear", None), ("rbf", "scale"), ("rbf", 0.01))
DENSE_C = (1.0, 10.0, 100.0)
