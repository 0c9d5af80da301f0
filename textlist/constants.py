"""Word lists, patterns and weights that define the results."""

from __future__ import annotations

#: Output fields and their weights. Fixed values.
FIELD_WEIGHTS = {
    "producer": 1.0, "cuvee": 1.0, "type": 0.8, "vintage": 0.8, "price": 0.9, "bottle_size": 0.7, "grape_variety": 0.6,
    "country": 0.7, "region": 0.6, "subregion": 0.5, "designation": 0.5, "classification": 0.5, "sub_type": 0.5,
}
#: What a value's origin multiplies its confidence by. Fixed values.
ORIGIN_FACTORS = {"restaurant_rule": 1.0, "global_rule": 0.9, "lwin_match": 0.95, "lwin_enrichment": 0.85, "context": 0.7, "context_propagation": 0.6, "missing": 0.2}
OTHER_ORIGIN = 0.5
REVIEW_BELOW = 0.75

PRICE = r"\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\s*[€$£]?"
VINTAGE = r"19\d{2}|20\d{2}|NV"
NAME = r"[A-Z][a-zA-Z\s'-]+"
#: Patterns for a whole entry: (pattern, confidence, field of each group). Fixed values.
_GRAPES = rf"({NAME}(?:\s*/\s*{NAME})*)\s+(?:'([^']+)'|\"([^\"]+)\"|({NAME}))\s*,\s*({NAME}(?:\s+{NAME})*(?:\s*&\s*{NAME})*)\s*,\s*({NAME}(?:\s+{NAME})*)"
_ESTATE = rf"(Château|Domaine|Estate)\s+({NAME})\s+({NAME}(?:\s+{NAME})*)"
ENTRY_RULES = [
    (rf"{_GRAPES}\s+({VINTAGE})\s+({PRICE})", 0.95, ["grape_variety", "cuvee", "cuvee", "cuvee", "producer", "region", "vintage", "price"]),
    (rf"{_ESTATE}\s+({VINTAGE})\s+({PRICE})", 0.95, ["producer", "cuvee", "region", "vintage", "price"]),
    (rf"{_GRAPES}\s+({PRICE})", 0.85, ["grape_variety", "cuvee", "cuvee", "cuvee", "producer", "region", "price"]),
    (rf"{_ESTATE}\s+({PRICE})", 0.85, ["producer", "cuvee", "region", "price"]),
]
_GRAPE = "Pinot Noir|Chardonnay|Pinot Meunier|Cabernet Sauvignon|Merlot|Syrah|Grenache"
_NEXT = rf"\s*,\s*{NAME}"
#: Patterns for one field: (field, pattern, confidence); the value is the first group. Fixed values.
FIELD_RULES = [
    ("vintage", rf"({VINTAGE}|N\.V\.|Non-Vintage)", 0.8),
    ("price", rf"({PRICE}|POA)", 0.8),
    ("bottle_size", r"(\b(?:750ml|magnum|jeroboam|half|1\.5L|3L|375ml|cl)\b)", 0.7),
    ("designation", "(Grand Cru|Premier Cru|1er Cru|Riserva|Reserva|Gran Reserva)", 0.7),
    ("classification", "(AOC|DOCG|DOC|IGT|VDP|VDQS|AVA|VQA|GI)", 0.7),
    ("sub_type", "(Brut|Sec|Demi-Sec|Extra Brut|Rosé|Blanc de Blancs)", 0.7),
    ("grape_variety", rf"({_GRAPE})(?:\s*/\s*(?:{_GRAPE}))*", 0.8),
    ("producer", rf"({NAME}(?:\s+{NAME})*(?:\s*&\s*{NAME})*)(?={_NEXT})", 0.8),
    ("cuvee", rf"(?:'([^']+)'|\"[^\"]+\"|{NAME})(?={_NEXT})", 0.8),
]

#: Replacements that normalise a text, in order: dashes, words broken by a hyphen, ampersands, apostrophes, then the space before a currency sign and runs of white space. Fixed values.
DASHES = r"[‐-―⁃−⎯⏤]"
JOINS = [
    (r"(\w+)-\s*\n\s*(\w+)", "$1$2"),
    (r"(\w+)-\s*(\w+)", "$1$2"),
    (r"(\w+)(?:&|and)\s*(\w+)", "$1 & $2"),
    (r"(\w+)'\s*(\w+)", "$1'$2"),
]
CURRENCIES = ["€", "$", "£"]

#: Patterns that exclude a line, by group. Fixed values.
EXCLUSIONS = {
    "by_the_glass": [r"by\s+the\s+glass", r"glass\s+pour", r"glass\s+only", r"available\s+by\s+glass"],
    "wine_pairing": [r"wine\s+pairing", r"pairing\s+menu", r"tasting\s+menu", "flight"],
    "non_wine": ["beer", "cocktail", "spirit", "liquor", "whiskey", "vodka", "gin", "rum", "tequila"],
}
#: Bottle sizes in order of trial, with millilitres. Fixed values; the L forms never match lower-case text.
BOTTLES = [
    ("standard", r"\b(750ml|75cl|standard)\b", 750), ("half", r"\b(375ml|37\.5cl|half\s*bottle)\b", 375), ("magnum", r"\b(1\.5L|150cl|magnum)\b", 1500),
    ("double_magnum", r"\b(3L|300cl|double\s*magnum)\b", 3000), ("jeroboam", r"\b(3L|300cl|jeroboam)\b", 3000), ("imperial", r"\b(6L|600cl|imperial)\b", 6000),
    ("salmanazar", r"\b(9L|900cl|salmanazar)\b", 9000), ("balthazar", r"\b(12L|1200cl|balthazar)\b", 12000), ("nebuchadnezzar", r"\b(15L|1500cl|nebuchadnezzar)\b", 15000),
]
#: Variant tags in order. Fixed values.
VARIANTS = [("vintage", r"\b(19|20)\d{2}\b"), *((w, rf"\b{w}\b") for w in ("reserve", "special", "limited", "single", "grand", "premier", "cru"))]
#: Words that speak for an item, and regions; three are in both. Fixed values.
TERMS = ["wine", "chateau", "domaine", "estate", "vineyard", "cellar", "pinot", "chardonnay", "cabernet", "merlot", "syrah", "grenache", "sauvignon", "blanc", "noir", "rouge", "rose", "sparkling", "champagne", "burgundy", "bordeaux", "italy", "spain", "france", "germany", "australia", "usa", "new zealand", "chile", "argentina"]
REGIONS = ["burgundy", "bordeaux", "champagne", "alsace", "loire", "rhone", "tuscany", "piedmont", "veneto", "rioja", "ribera", "priorat", "napa", "sonoma", "oregon", "washington", "barossa", "mclaren", "margaret river", "marlborough", "central otago"]
HOUSE_TERMS = TERMS[:6]

#: Headings, three levels: patterns for the whole line and words anywhere in it. Fixed values.
TITLE_CASE = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*$"
HEADER_PATTERNS = {
    1: [r"^[A-Z][A-Z\s]{2,30}$", TITLE_CASE, r"^(?:Red|White|Sparkling|Rosé|Dessert|Sweet|Fortified)\s+Wines?$", r"^(?:Champagne|Sparkling|Still|Fortified)\s+Wines?$"],
    2: [TITLE_CASE, "^(?:Champagne|Burgundy|Bordeaux|Italy|Spain|USA|Australia|Germany|New Zealand)$", r"^(?:Pinot Noir|Chardonnay|Cabernet|Merlot|Syrah|Grenache)\s+Wines?$"],
    3: [TITLE_CASE, "^(?:Pinot Noir|Chardonnay|Cabernet|Merlot|Syrah|Grenache)$", "^(?:Grand Cru|Premier Cru|1er Cru|Riserva|Reserva|Gran Reserva)$"],
}
HEADER_WORDS = {
    1: ["champagne", "rosé", "magnums", "white", "red", "sparkling", "dessert", "sweet", "fortified"],
    2: ["burgundy", "bordeaux", "italy", "spain", "usa", "australia", "germany", "new zealand", "champagne"],
    3: ["pinot noir", "chardonnay", "cabernet", "merlot", "syrah", "grenache", "grand cru", "premier cru", "1er cru"],
}
#: Words that make a contents page, and a page without items. Fixed values.
CONTENTS_WORDS = ["contents", "index", "table of contents", "wine list", "sommelier's selection"]
OFF_PAGE_WORDS = ["table of contents", "notes", "about", "introduction", "summary", "terms and conditions", "disclaimer", "copyright", "all rights reserved", "page", "of", "wine list", "menu", "sommelier's selection"]

#: Fields that identify an item, with weights, and the catalogue column of each. Fixed values.
KEY_WEIGHTS = {"producer": 1.0, "cuvee": 1.0, "vintage": 0.8, "region": 0.7, "country": 0.7, "grape_variety": 0.6}
KEYS = list(KEY_WEIGHTS)
KEY_COLUMNS = {"producer": "producer_name", "cuvee": "wine", "vintage": "vintage_config", "region": "region", "country": "country"}
#: Added to a field's ratio where it is over 80. Fixed values.
NEAR_BOOST = {"producer": 10, "cuvee": 5}
DIRECT, FUZZY, PARTIAL = 100, 85, 70

#: What values of checked fields look like, and words of ranks that no producer's name holds. Fixed values.
VINTAGE_VALUE = r"^(19|20)\d{2}$|^NV$|^N\.V\.$"
PRICE_VALUE = r"^\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\s*[€$£]?$|^POA$"
SIZE_VALUE = r"^\d+(?:\.\d+)?(?:ml|cl|L)$|^magnum$|^jeroboam$|^half$"
RANK_WORDS = ["cru", "grand", "premier", "1er"]
