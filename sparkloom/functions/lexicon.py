"""Fixed values that results depend on: word lists, weights, motifs, patterns and prices."""

# ---- fixed values: word classes of the rule-based tagger, tested in this order ----
DETERMINERS = [
    "the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "its", "our", "their",
    "some", "any", "no", "every", "each", "all", "both", "few", "many", "much", "several",
]
PREPOSITIONS = [
    "in", "on", "at", "to", "for", "with", "by", "from", "of", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "over", "up", "down", "out", "off", "against",
]
CONJUNCTIONS = [
    "and", "but", "or", "nor", "for", "yet", "so", "because", "although", "while", "if", "when", "unless",
    "until", "since", "whereas",
]
PRONOUNS = [
    "i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they", "them", "myself", "yourself",
    "himself", "herself", "itself", "who", "whom", "which", "what", "whoever", "whatever",
]
AUXILIARIES = [
    "is", "am", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "shall", "should", "may", "might", "can", "could", "must",
]
ADVERBS = [
    "not", "very", "also", "often", "never", "always", "sometimes", "usually", "here", "there", "now", "then",
    "already", "still", "just", "only", "really", "quite", "almost", "enough", "too", "well", "however",
    "therefore", "moreover", "furthermore",
]
TAG_WORDS = [
    ("DET", DETERMINERS), ("ADP", PREPOSITIONS), ("CONJ", CONJUNCTIONS),
    ("PRON", PRONOUNS), ("AUX", AUXILIARIES), ("ADV", ADVERBS),
]
VERB_SUFFIXES = ["ing", "ed", "en", "ize", "ise", "ate", "ify"]
NOUN_SUFFIXES = ["tion", "sion", "ment", "ness", "ity", "ence", "ance", "ism"]
ADJECTIVE_SUFFIXES = ["ous", "ive", "ful", "less", "able", "ible", "al", "ial"]

# ---- fixed values: named-entity rules ----
PERSON_TITLES = [
    "mr", "mrs", "ms", "dr", "prof", "professor", "president", "sir", "lord", "lady", "king", "queen", "prince",
]
ORG_SUFFIXES = [
    "inc", "corp", "ltd", "llc", "co", "company", "corporation", "university", "institute", "foundation",
    "association", "committee", "commission", "department", "agency",
]
KNOWN_ENTITIES = [
    ("alan turing", "PERSON"), ("joseph weizenbaum", "PERSON"), ("noam chomsky", "PERSON"),
    ("vaswani", "PERSON"), ("chomsky", "PERSON"), ("turing", "PERSON"),
    ("google", "ORG"), ("microsoft", "ORG"), ("facebook", "ORG"), ("openai", "ORG"),
    ("georgetown", "ORG"), ("alpac", "ORG"),
    ("bert", "TECH"), ("gpt", "TECH"), ("eliza", "TECH"), ("shrdlu", "TECH"), ("transformer", "TECH"),
    ("english", "LANG"), ("russian", "LANG"), ("french", "LANG"),
]
NOT_ACRONYMS = ["the", "and", "for"]

# ---- fixed values: collocation rules ----
PHRASE_PREPOSITIONS = ["in", "on", "at", "to", "for", "with", "by", "from", "of", "about"]
PAIR_VERB_SUFFIXES = ["ing", "ed", "en", "ize", "ise", "ate"]
PAIR_NOUN_SUFFIXES = ["tion", "sion", "ment", "ness", "ity", "ence", "ance"]
CONTENT_TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PROPN"]
KEYWORD_TAGS = ["NOUN", "VERB", "ADJ", "PROPN"]
TAG_WEIGHTS = {
    "NOUN": 1.5, "VERB": 1.8, "ADJ": 2.0, "ADV": 2.2, "PROPN": 2.5, "DET": 0.5, "ADP": 0.5,
    "CONJ": 0.3, "PRON": 0.4, "AUX": 0.3, "NUM": 1.0,
}

# ---- fixed values: sentiment words ----
POSITIVE = [
    "good", "great", "excellent", "amazing", "wonderful", "fantastic", "brilliant", "outstanding", "superb",
    "remarkable", "impressive", "beautiful", "perfect", "love", "best", "happy", "success", "successful",
    "powerful", "innovative", "revolutionary", "achieved", "progress", "improved", "efficient", "effective",
    "popular", "advanced", "capable", "enabled", "significant", "important", "notable", "breakthrough",
]
NEGATIVE = [
    "bad", "terrible", "awful", "horrible", "poor", "worst", "failure", "failed", "hate", "ugly", "boring",
    "disappointing", "difficult", "problem", "problems", "complex", "complicated", "slow", "slower", "limited",
    "restricted", "reduced", "lack", "lacking", "declined",
]
INTENSIFIERS = [
    "very", "extremely", "highly", "incredibly", "remarkably", "particularly", "especially", "most", "quite",
]
NEGATORS = ["not", "no", "never", "neither", "nor", "hardly", "barely", "scarcely"]
SENTIMENT = {
    "positive": POSITIVE, "negative": NEGATIVE, "intensifier": INTENSIFIERS, "negator": NEGATORS,
}

# ---- fixed values: topic keywords ----
TOPICS = {
    "technology": [
        "computer", "software", "algorithm", "machine", "learning", "processing", "system", "model", "data",
        "neural", "network", "artificial", "intelligence", "computational", "digital",
    ],
    "science": [
        "research", "experiment", "theory", "hypothesis", "analysis", "study", "scientific", "observation",
        "evidence", "method",
    ],
    "language": [
        "language", "linguistic", "word", "sentence", "grammar", "translation", "speech", "text",
        "vocabulary", "syntax",
    ],
    "history": [
        "history", "historical", "century", "year", "period", "era", "ancient", "modern", "tradition",
        "development", "evolution",
    ],
    "mathematics": [
        "number", "equation", "formula", "statistical", "probability", "function", "variable", "matrix",
        "vector", "calculation",
    ],
}

# ---- fixed values: genre floors (formality, type-token ratio, word complexity) ----
GENRE_FLOORS = {
    "academic": (0.6, 0.5, 0.4),
    "technical": (0.5, 0.4, 0.35),
    "journalistic": (0.4, 0.35, 0.3),
    "conversational": (0.2, 0.25, 0.2),
}

# ---- fixed values: audience per reading level (audience, needs simplification) ----
AUDIENCES = {
    "elementary": ("general_public", False),
    "middle_school": ("general_public", False),
    "high_school": ("informed_reader", False),
    "undergraduate": ("educated_reader", True),
    "graduate": ("specialist", True),
}

# ---- fixed values: sequence motifs and the base walk ----
MOTIFS = {
    "TATA": "TATA_box", "CAAT": "CAAT_box", "AATAAA": "poly_A_signal", "GCCGCC": "Kozak_like",
    "CACGTG": "E_box", "CCAAT": "CCAAT_box", "TGAC": "AP1_site", "GATA": "GATA_motif",
}
BASE_STEPS = {"A": (1.0, 1.0), "T": (1.0, -1.0), "G": (1.0, 0.5), "C": (1.0, -0.5)}
# The standard genetic code, amino acids listed for codons in the order TTT, TTC, TTA, TTG, TCT, … GGG.
GENETIC_CODE_ORDER = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
PROTEIN_BINS = [0, 30, 50, 75, 100, 150, 200, 500]

# ---- fixed values: 3x3 raster kernels (row-major weights, scale, offset) ----
KERNELS = {
    "contour": ([-1, -1, -1, -1, 8, -1, -1, -1, -1], 1, 255),
    "find_edges": ([-1, -1, -1, -1, 8, -1, -1, -1, -1], 1, 0),
    "emboss": ([-1, 0, 0, 0, 1, 0, 0, 0, 0], 1, 128),
    "sharpen": ([-2, -2, -2, -2, 32, -2, -2, -2, -2], 16, 0),
    "detail": ([0, -1, 0, -1, 10, -1, 0, -1, 0], 6, 0),
    "edge_enhance": ([-1, -1, -1, -1, 10, -1, -1, -1, -1], 2, 0),
    "laplacian": ([0, -1, 0, -1, 4, -1, 0, -1, 0], 1, 128),
    "sobel_x": ([-1, 0, 1, -2, 0, 2, -1, 0, 1], 1, 128),
    "sobel_y": ([-1, -2, -1, 0, 0, 0, 1, 2, 1], 1, 128),
}

# ---- fixed values: unit prices in USD (compute per GB-second, per request, table and object I/O) ----
PRICES = {
    "gb_second": 0.0000166667,
    "request": 0.0000002,
    "table_write": 0.00000125,
    "table_read": 0.00000025,
    "object_put": 0.000005,
    "object_get": 0.0000004,
    "transition": 0.000025,
}

# ---- fixed values: text patterns ----
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\(\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
MENTION_PATTERN = r"@([a-zA-Z0-9]+)"
SHORT_HOST = "http://sh.ort"
DASHBOARD_SOURCES = ["sales", "inventory", "marketing", "external_market", "weather", "competitor_pricing"]
