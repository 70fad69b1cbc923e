"""Controlled vocabularies of the knowledge graph. All of these are fixed values of the data model."""

from __future__ import annotations

ENTITY_TYPES = ("Character", "Person", "Location", "Event")

PREDICATES = (
    "INTERACTS_WITH",
    "LOCATED_IN",
    "TRAVELS_TO",
    "LOVES",
    "HATES",
    "KILLS",
    "DESCENDS_FROM",
    "OWNS",
    "PARTICIPATES_IN",
    "HAS_PARTICIPANT",
    "HAS_DESTINATION",
    "SAME_AS",
    "CANDIDATE_SAME_AS",
    "BASED_ON",
)
LLM_PREDICATES = ("INTERACTS_WITH", "LOCATED_IN", "LOVES", "HATES", "KILLS", "TRAVELS_TO", "DESCENDS_FROM", "OWNS")
SYMMETRIC_PREDICATES = ("INTERACTS_WITH", "LOVES", "HATES")
EVENT_PREDICATES = ("TRAVELS_TO", "INTERACTS_WITH", "KILLS", "LOVES", "HATES")

#: Label of a gold span -> entity type; other labels are persons.
GOLD_LABELS = {
    "PER": "Person",
    "PERSON": "Person",
    "LOC": "Location",
    "LOCATION": "Location",
    "GPE": "Location",
    "ORG": "Person",
    "DATE": "Event",
    "TIME": "Event",
}
#: Label of a model's span -> entity type.
MODEL_LABELS = {
    "PER": "Character",
    "PERSON": "Character",
    "LOC": "Location",
    "LOCATION": "Location",
    "GPE": "Location",
    "ORG": "Character",
    "MISC": "Character",
}

#: Words that are no names, compared in lower case.
STOPWORDS = (
    "într-o", "într-un", "de", "la", "pe", "cu", "din", "în", "pentru",
    "și", "sau", "dar", "dacă", "când", "unde", "cum", "ce", "care",
    "mai", "mult", "puțin", "toate", "toți", "acestea", "aceștia",
    "acolo", "aici", "atunci", "acum", "seara", "dimineața", "dimineata",
    "era", "este", "fost", "sunt", "fi", "avea", "face", "fiind",
)
#: The shorter list of the second extractor.
STOPWORDS_SHORT = (
    "într-o", "într-un", "de", "la", "pe", "cu", "din", "în", "pentru",
    "și", "sau", "dar", "dacă", "când", "unde", "cum", "ce", "care",
)
#: Words that are no names, compared as written.
STOPWORDS_TITLE = ("Erau", "Nu", "Cât", "Apoi", "Ș-apoi", "Într-una", "Draga", "Povești")
#: Names that are junk entities.
JUNK_NAMES = ("nu", "erau", "cât", "apoi", "și-apoi", "ș-apoi", "într-una", "draga", "povești", "mai")

#: Predicate, keywords, confidence, symmetric.
SEMANTIC_PATTERNS = (
    ("LOVES", ("iubește", "iubire", "dragoste", "dragostea", "îndrăgostit"), 0.85, True),
    ("HATES", ("urăște", "ură", "dușmănie", "vrăjmaș", "inamic"), 0.85, True),
    ("KILLS", ("ucide", "omoară", "asasinează", "crimă", "mort"), 0.9, False),
    ("TRAVELS_TO", ("călătorește", "pleacă", "merge", "ajunge", "sosește"), 0.7, False),
    ("DESCENDS_FROM", ("fiu", "fiică", "nepoat", "descendent", "moștenit"), 0.85, False),
    ("OWNS", ("deține", "proprietar", "posed", "aparține", "moșie"), 0.75, False),
)
#: Temporal relation and its indicators, in order of precedence.
TEMPORAL_INDICATORS = (
    ("BEFORE", ("înainte", "mai devreme", "anterior", "pregătind")),
    ("AFTER", ("după", "mai târziu", "ulterior", "următor")),
    ("DURING", ("în timpul", "pe când", "în timp ce", "concomitent")),
    ("OVERLAPS", ("simultan", "în același timp", "totodată")),
)

#: Marks that take no blank before, or after, when tokens are joined.
NO_SPACE_BEFORE = (".", ",", ";", ":", "!", "?", ")", "]", "}", "»", "”")
NO_SPACE_AFTER = ("(", "[", "{", "«", "„", "“")
