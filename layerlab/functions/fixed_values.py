"""Label names, emoticon tables, survey codes and ranges.

Everything in this module is data that has to be exactly as stated for results
to be comparable; there is no logic here.
"""

from __future__ import annotations

# The 28 label names; the position in the list is the label id.
EMOTIONS = [
    "admiration", "amusement", "anger", "annoyance", "approval", "caring",
    "confusion", "curiosity", "desire", "disappointment", "disapproval",
    "disgust", "embarrassment", "excitement", "fear", "gratitude", "grief",
    "joy", "love", "nervousness", "optimism", "pride", "realization",
    "relief", "remorse", "sadness", "surprise", "neutral",
]

# The three groups of label names.
POSITIVE = [
    "admiration", "amusement", "approval", "caring", "desire", "excitement",
    "gratitude", "joy", "love", "optimism", "pride", "relief",
]
NEGATIVE = [
    "anger", "annoyance", "disappointment", "disapproval", "disgust",
    "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness",
]
AMBIGUOUS = ["confusion", "curiosity", "surprise", "realization", "neutral"]

# Emoticon replacements, applied in this order.
EMOTICONS = {
    ":)": "happy", ":))": "happy", ":-)": "happy", ":-))": "happy",
    ":(": "sad", ":((": "sad", ":-((": "sad",
    ":/": "confusion", "://": "confusion", ":-/": "confusion",
    ":-'": "confusion", ":-//": "confusion", ":\\": "confusion",
    ":-\\": "confusion", ":|": "neutral", ":-|": "neutral",
    "XD": "laugh", ":D": "laugh", ":-D": "laugh",
    ">": "more than", "<": "less than", "<=": "less than or equal",
    ">=": "more than or equal", "=": "equal", "==": "is equivalent to",
}

# The shorter table, without `:-'` and the comparison signs.
EMOTICONS_SHORT = {
    ":)": "happy", ":))": "happy", ":-)": "happy", ":-))": "happy",
    ":(": "sad", ":((": "sad", ":-((": "sad",
    ":/": "confusion", "://": "confusion", ":-/": "confusion",
    ":-//": "confusion", ":\\": "confusion", ":-\\": "confusion",
    ":|": "neutral", ":-|": "neutral",
    "XD": "laugh", ":D": "laugh", ":-D": "laugh",
}

# The survey's columns in file order.
SURVEY_FIELDS = [
    "ID", "CITY", "COUN", "SUBJ", "SEX",
    "AGE", "RELI", "PRAC", "FOCC", "MOCC",
    "FIEL", "EMOT", "WHEN", "LONG", "INTS",
    "ERGO", "TROPHO", "TEMPER", "EXPRES",
    "MOVE", "EXP1", "EXP2", "EXP10", "PARAL",
    "CON", "EXPC", "PLEA", "PLAN", "FAIR",
    "CAUS", "COPING", "MORL", "SELF", "RELA",
    "VERBAL", "NEUTRO", "Field1", "Field3",
    "Field2", "MYKEY", "SIT", "STATE",
]

# Survey code domains, code -> label.
CODE_DOMAINS = {
    "country": {
        1: "SWEDEN", 2: "NORWAY", 3: "F.R.G.", 4: "FINLAND", 5: "GREECE",
        6: "HONG KONG", 7: "LEBANON", 8: "AUSTRIA", 9: "AUSTRALIA",
        10: "BRAZIL", 11: "BOTSWANA", 12: "BULGARIA", 13: "FRANCE",
        14: "ITALY", 15: "JAPAN", 16: "NEW ZEALAND", 17: "NETHERLANDS",
        18: "PORTUGAL", 19: "SPAIN", 20: "ZAMBIA", 21: "ZIMBABWE", 22: "USA",
        23: "POLAND", 24: "NIGERIA", 25: "ISRAEL", 26: "INDIA", 27: "MALAWI",
        28: "SWITZERLAND", 29: "CHILE", 30: "CHINA MAINLAND",
        31: "YUGOSLAVIA", 32: "COSTA RICA", 33: "HONDURAS", 34: "MEXICO",
        35: "GUATEMALA", 36: "VENEZUELA", 37: "EL SALVADOR",
    },
    "sex": {1: "MALE", 2: "FEMALE"},
    "religion": {
        1: "PROTESTANT", 2: "CATHOLIC", 3: "JEWISH", 4: "HINDU",
        5: "BUDDHIST", 6: "NATIVE", 7: "OTHERS", 8: "ARELIGIOUS",
    },
    "practice": {1: "TRUE", 2: "FALSE"},
    "occupation": {
        1: "HOUSEWIFE", 2: "UNEMPLOYED", 3: "STUDENT",
        4: "BLUE COLLAR UNTRAINED", 5: "BLUE COLLAR TRAINED",
        6: "WHITE COLLAR NONACADEMIC", 7: "WHITE COLLAR ACADEMIC",
        8: "SELF-EMPLOYED NONACADEMIC", 9: "SELF-EMPLOYED ACADEMIC",
    },
    "field": {
        1: "PSYCHOLOGY", 2: "SOCIAL SCIENCES", 3: "LANGUAGES", 4: "FINE ARTS",
        5: "LAW", 6: "NATURAL SCIENCE", 7: "ENGINEERING", 8: "MEDICAL",
        9: "OTHER",
    },
    "emotion": {
        1: "JOY", 2: "FEAR", 3: "ANGER", 4: "SADNESS", 5: "DISGUST",
        6: "SHAME", 7: "GUILT",
    },
    "when": {1: "DAYS AGO", 2: "WEEKS AGO", 3: "MONTHS AGO", 4: "YEARS AGO"},
    "duration": {1: "MINUTES", 2: "HOUR", 3: "HOURS", 4: "DAY OR MORE"},
    "control": {0: "NA", 1: "NONE", 2: "A LITTLE", 3: "VERY MUCH"},
    "relationship": {0: "NA", 1: "NEGATIVE", 2: "NONE", 3: "POSITIVE"},
    "plan": {0: "NA", 1: "HELPED", 2: "NO MATTER", 3: "HINDERED"},
    "cause": {0: "NA", 1: "SELF", 2: "CLOSE", 3: "OTHER", 4: "IMPERSONAL"},
    "coping": {
        1: "NO ACTION NECESSARY", 2: "MANAGEABLE", 3: "ESCAPABLE SITUATION",
        4: "DENIAL", 5: "DOMINATED",
    },
}

# Which survey column is coded in which domain.
SURVEY_DOMAINS = {
    "COUN": "country", "SEX": "sex", "RELI": "religion", "PRAC": "practice",
    "FOCC": "occupation", "MOCC": "occupation", "FIEL": "field",
    "EMOT": "emotion", "WHEN": "when", "LONG": "duration", "CON": "control",
    "EXPC": "control", "PLEA": "control", "FAIR": "control",
    "MORL": "control", "SELF": "control", "RELA": "relationship",
    "PLAN": "plan", "CAUS": "cause", "COPING": "coping",
}

# Permitted ranges of survey scales and the 0/1 fields.
SURVEY_RANGES = {
    "INTS": (1, 4), "ERGO": (0, 4), "TROPHO": (0, 3), "TEMPER": (-1, 2),
    "MOVE": (-1, 1), "EXPRES": (0, 6), "PARAL": (0, 3),
}
SURVEY_BINARY = ["EXP1", "EXP2", "EXP10"]

# Probe depths (hidden layer widths) by number of hidden layers.
PROBE_DEPTHS = [[], [256], [512, 256], [512, 256, 128], [1024, 512, 256, 128]]

# The tuning grid; losses depend on the task.
TUNING_GRID = {
    "learning_rate": [1e-3, 3e-4, 1e-4],
    "dropout_rate": [0.3, 0.5, 0.7],
    "batch_size": [64, 128, 256],
    "weight_decay": [0.0, 1e-4, 1e-3],
    "epochs": [50, 100, 150],
    "hidden_layers": [[], [512], [512, 256], [512, 256, 128]],
}
TUNING_LOSSES = {
    "multilabel": ["bce", "focal", "hinge"],
    "singlelabel": ["ce", "focal", "hinge"],
}

# Padded vector width by model family.
VECTOR_WIDTHS = {"bert": 768, "other": 1280}

# White space as the cleaners understand it (all Unicode blanks).
BLANKS = (
    r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


# Word pattern of the term counters, and the sentiment constant.
WORD_PATTERN = r"([\p{L}\p{N}_]{2,})"
SENTIMENT_ALPHA = 15.0
