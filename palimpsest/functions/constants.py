"""Fixed values that results depend on."""

# Phrases that mark a formulaic line, matched without regard to case.
FORMULAIC = [
    "fils de", "née? [àa]", "arrondissement d", "département d", "condamné[e]? le", "profession de", "domicilié[e]? [àa]", "ayant exercé",
    "Le nommé", "Taille d'un mètre", "Cheveux", "Sourcils", "Front", "Yeux", "Nez", "Bouche", "Menton", "Barbe", "Visage", "Teint",
    "Signes particuliers", "moyens d'existence",
]

# Entity patterns.
MONTHS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
ENTITIES = {
    "numbers": r"\b\d+\b",
    "dates": rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\b",
    "proper_nouns": r"\b[A-ZÀ-Ü][a-zà-ü]{2,}\b",
}

# USD for a million input and output tokens.
PRICING = {
    "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.00, 30.00), "gpt-5": (1.25, 10.00), "gpt-5.4": (2.5, 15.00),
    "gpt-5-mini": (0.25, 2.00), "gpt-5.2": (1.75, 14.00), "gemini-2.0-flash": (0.10, 0.40), "gemini-2.0-pro": (1.25, 5.00),
    "gemini-2.5-pro": (1.25, 10.00), "gemini-2.5-flash": (0.30, 2.50), "gemini-3.1-pro-preview": (2.00, 12.00), "gemini-3-pro-preview": (2.00, 12.00),
    "gemini-3-flash-preview": (0.50, 3.00), "mistral-large-latest": (0.50, 1.50), "pixtral-large-latest": (2.00, 6.00),
    "ministral-3b-2512": (0.10, 0.10), "ministral-8b-2512": (0.15, 0.15), "ministral-14b-2512": (0.20, 0.20),
}

# Price of a self-hosted machine for an hour, and of a euro.
HOURLY_EUR, EUR_TO_USD = 2.8, 1.08
# Models billed by the hour; a deployment adds its own.
SELF_HOSTED = ["gemma-4-26B-A4B-it", "Qwen3.6-35B-A3B"]

# The model tried next when one gives nothing.
FALLBACK = {
    "gemini-3-pro-preview": "gemini-3-flash-preview", "gemini-3-flash-preview": "gemini-2.5-pro", "gemini-2.5-pro": "gemini-2.0-flash",
    "gpt-5.4": "gpt-5.4", "gpt-5": "gpt-4o", "mistral-large-latest": "pixtral-large-latest",
}

# Region classes by id.
REGIONS = ["Title", "En-tête", "Marge", "Nom", "Plein Texte", "Signature", "Table", "Section"]

# Shares of the splits, word buckets, the ratio of an outlier, sizes of nested subsets.
SPLIT_WEIGHTS = {"train": 0.7, "test": 0.2, "dev": 0.1}
BUCKETS = [("1-3", 3), ("4-10", 10), ("11-25", 25), ("26-50", 50)]
OUTLIER_RATIO = 10.0
SUBSET_SIZES = [60, 120, 240, 480, 972]
