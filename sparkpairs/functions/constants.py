"""Fixed values that must equal the behaviour being reproduced.

Everything in this module is data, stated as text in its natural order.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: homophone dictionary (word -> alternatives), in natural order.
# Keys containing an apostrophe can never match an alphabetic token; they only
# occur as replacements.
# ---------------------------------------------------------------------------
HOMOPHONES = {
    "there": ["their", "they're"],
    "their": ["there", "they're"],
    "they're": ["there", "their"],
    "lose": ["loose"],
    "loose": ["lose"],
    "then": ["than"],
    "than": ["then"],
    "affect": ["effect"],
    "effect": ["affect"],
    "here": ["hear"],
    "hear": ["here"],
    "are": ["our"],
    "our": ["are"],
    "by": ["bye", "buy"],
    "bye": ["by", "buy"],
    "buy": ["by", "bye"],
    "weather": ["whether"],
    "whether": ["weather"],
    "to": ["too", "two"],
    "too": ["to", "two"],
    "two": ["to", "too"],
    "you're": ["your"],
    "your": ["you're"],
    "bear": ["bare"],
    "bare": ["bear"],
    "bearing": ["baring", "barring"],
    "baring": ["bearing", "barring"],
    "barring": ["bearing", "baring"],
    "scaring": ["scarring"],
    "scarring": ["scaring"],
    "sparing": ["sparring"],
    "sparring": ["sparing"],
    "one": ["won"],
    "won": ["one"],
    "break": ["brake"],
    "brake": ["break"],
    "complement": ["compliment"],
    "compliment": ["complement"],
    "allowed": ["aloud"],
    "aloud": ["allowed"],
    "lie": ["lay"],
    "lay": ["lie"],
    "its": ["it's"],
    "it's": ["its"],
    "principle": ["principal"],
    "principal": ["principle"],
    "lightning": ["lightening"],
    "lightening": ["lightning"],
    "peak": ["peek", "pique"],
    "peek": ["peak", "pique"],
    "pique": ["peak", "peek"],
    "feat": ["feet"],
    "feet": ["feat"],
    "ensure": ["insure"],
    "insure": ["ensure"],
    "were": ["where"],
    "where": ["were"],
    "past": ["passed"],
    "passed": ["past"],
    "stationary": ["stationery"],
    "stationery": ["stationary"],
    "council": ["counsel"],
    "counsel": ["council"],
    "altar": ["alter"],
    "alter": ["altar"],
    "queue": ["cue"],
    "cue": ["queue", "que"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: QWERTY same-row letter neighbours (letters only), natural order.
# ---------------------------------------------------------------------------
KEYBOARD_NEIGHBORS = {
    "q": ["w"], "w": ["q", "e"], "e": ["w", "r"], "r": ["e", "t"], "t": ["r", "y"],
    "y": ["t", "u"], "u": ["y", "i"], "i": ["u", "o"], "o": ["i", "p"], "p": ["o"],
    "a": ["s"], "s": ["a", "d"], "d": ["s", "f"], "f": ["d", "g"], "g": ["f", "h"],
    "h": ["g", "j"], "j": ["h", "k"], "k": ["j", "l"], "l": ["k"],
    "z": ["x"], "x": ["z", "c"], "c": ["x", "v"], "v": ["c", "b"], "b": ["v", "n"],
    "n": ["b", "m"], "m": ["n"],
}

# ---------------------------------------------------------------------------
# FIXED VALUES: default error-insertion configuration.
# ---------------------------------------------------------------------------
DEFAULT_ERROR_CONFIG = {
    "error_rates": {
        "punctuation": {
            "quote_spaces": 0.05,
            "missing_quotes": 0.03,
            "punctuation_outside_quotes": 0.04,
        },
        "typography": {
            "dropped_letters": 0.08,
            "swapped_letters": 0.06,
            "dropped_words": 0.02,
            "swapped_words": 0.01,
        },
        "spacing": {
            "spaces_around_punctuation": 0.06,
            "missing_spaces": 0.04,
        },
        "homophones": {
            "substitution_rate": 0.10,
        },
        "contractions": {
            "dropped_nt": 0.03,
        },
        "keyboard_neighbors": {
            "substitution_rate": 0.07,
        },
    },
    "preserve_ratio": 0.3,
    "max_errors_per_chunk": 3,
    "min_chunk_length": 50,
}

# FIXED VALUES: the shipped production configuration file's settings.
PRODUCTION_ERROR_CONFIG = {
    "error_rates": {
        "punctuation": {
            "quote_spaces": 0.15,
            "missing_quotes": 0.15,
            "punctuation_outside_quotes": 0.10,
        },
        "typography": {
            "dropped_letters": 0.2,
            "swapped_letters": 0.2,
            "dropped_words": 0.1,
            "swapped_words": 0.1,
        },
        "spacing": {
            "spaces_around_punctuation": 0.1,
            "missing_spaces": 0.1,
        },
        "homophones": {
            "substitution_rate": 0.33,
        },
        "contractions": {
            "dropped_nt": 0.1,
        },
        "keyboard_neighbors": {
            "substitution_rate": 0.25,
        },
    },
    "preserve_ratio": 0.1,
    "max_errors_per_chunk": 5,
    "min_chunk_length": 50,
}

# FIXED VALUES: family order and the operators of each family, in the order applied.
ERROR_FAMILIES = [
    ("punctuation", ["quote_spaces", "missing_quotes", "punctuation_outside_quotes"]),
    ("typography", ["dropped_letters", "swapped_letters", "dropped_words", "swapped_words"]),
    ("spacing", ["spaces_around_punctuation", "missing_spaces"]),
    ("homophones", ["homophones"]),
    ("contractions", ["dropped_nt"]),
    ("keyboard_neighbors", ["keyboard_neighbors"]),
]

# FIXED VALUES: content markers and chat template tokens.
CONTENT_BEGIN = "[BEGINNING OF CONTENT]"
CONTENT_END = "[END OF CONTENT]"
BOS = "<bos>"
TURN_START = "<start_of_turn>"
TURN_END = "<end_of_turn>"
INSTRUCTION_PART = "<start_of_turn>user\n"
RESPONSE_PART = "<start_of_turn>model\n"

# FIXED VALUES: fallback system prompts (chat export; evaluation).
EXPORT_FALLBACK_PROMPT = (
    "You are a helpful assistant that corrects grammar and spelling mistakes in the provided text."
)
EVAL_FALLBACK_PROMPT = (
    "You are a professional copy editor. Correct the following text for grammar, spelling, "
    "and punctuation while preserving the author's style."
)

# FIXED VALUES: length profile defaults.
DEFAULT_MAX_LENGTH = 768
GRID_START, GRID_STEP, GRID_CAP = 512, 256, 8192
PACKING_WORTHWHILE = 1.2

# FIXED VALUES: corpus build defaults.
DEFAULT_NPARA = 5
DEFAULT_MAX_WORDS = 500
DEFAULT_TEST_SIZE = 0.1
DEFAULT_SEED = 42

# Characters Python's str.strip() removes (str.isspace), in code point order.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex character-class body, readable by Java and RE2.
WS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
