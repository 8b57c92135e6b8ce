"""Fixed values that published results depend on."""

from __future__ import annotations

# Serving contract.
SERVING_SCHEMA_VERSION = 3
PIPELINE_VERSION = "3"
PARSER_VERSION = "1"
DAILY_QUOTES_PER_THINKER = 3

# Enumerations.
CATEGORIES = ["verificada", "obra", "atribuida"]
CURATION_STATUSES = ["accepted", "review", "rejected"]
REVIEW_STATUSES = ["pending", "approved", "rejected"]
REVIEW_REASONS = ["complete_and_distinct", "long_for_daily", "source_text_needs_revision"]
SOURCE_KINDS = ["wikiquote", "supplemental"]

# Page parsing.
PAGE_SOURCE_NAME = "Wikiquote"
PAGE_LICENSE = "CC BY-SA 4.0"
PAGE_URL_PREFIX = "https://pt.wikiquote.org/wiki/"
PAGE_ROOT_CLASS = "mw-parser-output"
HEADING_TAGS = ("h2", "h3", "h4")
TOP_SECTION = "(topo)"
DENIED_SECTIONS = [
    "sobre",
    "ligações externas",
    "ver também",
    "referências",
    "notas",
    "bibliografia",
    "fontes",
]
VERIFIED_SECTIONS = ["verificadas", "topo", ""]
ATTRIBUTED_SECTIONS = ["atribuídas", "atribuidas"]
MIN_QUOTE_LENGTH = 8

# Quality rules.
SHORT_TEXT_BELOW = 40
LONG_TEXT_ABOVE = 500

# Entity properties.
BIRTH_DATE = "P569"
DEATH_DATE = "P570"
BIRTH_PLACE = "P19"
CITIZENSHIP = "P27"
OCCUPATION = "P106"
MOVEMENT = "P135"
EDUCATION = "P69"
NOTABLE_WORKS = "P800"
INFLUENCED_BY = "P737"
LABELLED_PROPERTIES = [BIRTH_PLACE, CITIZENSHIP, OCCUPATION, MOVEMENT, EDUCATION, NOTABLE_WORKS]
ENTITY_URL_PREFIX = "https://www.wikidata.org/wiki/"
ENTITY_SOURCE_NAME = "Wikidata"
ENTITY_LICENSE = "CC0 1.0"
LABEL_LANGUAGES = ["pt", "en"]
PARTIAL_PROFILE_NOTE = "Frases indisponíveis no momento; perfil parcial (biografia apenas)."

# Supplemental CSV header.
SUPPLEMENTAL_FIELDS = [
    "thinker_qid",
    "thinker_name",
    "text",
    "original_text",
    "original_language",
    "category",
    "work",
    "source_url",
    "source_name",
    "source_license",
    "source_revision",
    "translator_name",
    "translation_license",
    "translation_url",
    "reviewed_at",
]
SUPPLEMENTAL_REQUIRED = [
    "thinker_qid",
    "thinker_name",
    "text",
    "category",
    "source_url",
    "source_name",
    "source_license",
    "source_revision",
    "reviewed_at",
]

# Default editorial catalogue (slug, title, description, members).
COLLECTIONS = [
    (
        "existencia-e-absurdo",
        "Existência e absurdo",
        "Liberdade, sentido e a experiência de existir.",
        ["Albert Camus", "Friedrich Nietzsche", "Jean-Paul Sartre", "Simone de Beauvoir"],
    ),
    (
        "ciencia-e-curiosidade",
        "Ciência e curiosidade",
        "Investigação, descoberta e os limites do conhecimento.",
        ["Carl Sagan", "Marie Curie", "Albert Einstein", "Richard Feynman"],
    ),
    (
        "liberdade-e-responsabilidade",
        "Liberdade e responsabilidade",
        "Escolhas individuais, ação política e responsabilidade pelo mundo.",
        ["Hannah Arendt", "Simone de Beauvoir", "John Stuart Mill", "Nelson Mandela"],
    ),
    (
        "sociedade-e-poder",
        "Sociedade e poder",
        "Estruturas sociais, autoridade, conflito e transformação.",
        ["Hannah Arendt", "Michel Foucault", "Karl Marx", "Max Weber"],
    ),
    (
        "conhecimento-e-duvida",
        "Conhecimento e dúvida",
        "Razão, método, incerteza e pensamento crítico.",
        ["Sócrates", "René Descartes", "Bertrand Russell", "Karl Popper"],
    ),
    (
        "trabalho-e-vocacao",
        "Trabalho e vocação",
        "Trabalho, ação e os sentidos da vida pública.",
        ["Karl Marx", "Max Weber", "Hannah Arendt", "Simone de Beauvoir"],
    ),
    (
        "revolta-e-resistencia",
        "Revolta e resistência",
        "Recusa, coragem e transformação do mundo comum.",
        ["Albert Camus", "Nelson Mandela", "Hannah Arendt", "Simone de Beauvoir"],
    ),
    (
        "metodo-e-descoberta",
        "Método e descoberta",
        "Dúvida, experimento e construção do conhecimento.",
        ["René Descartes", "Karl Popper", "Marie Curie", "Richard Feynman"],
    ),
    (
        "universo-e-humanidade",
        "Universo e humanidade",
        "Cosmos, ciência e o lugar humano no desconhecido.",
        ["Carl Sagan", "Albert Einstein", "Richard Feynman", "Bertrand Russell"],
    ),
    (
        "individuo-e-liberdade",
        "Indivíduo e liberdade",
        "Autonomia, escolha e convivência com o outro.",
        ["John Stuart Mill", "Friedrich Nietzsche", "Jean-Paul Sartre", "Nelson Mandela"],
    ),
]

# Columns of the serving tables, of the build metadata and of a selected quote.
SERVING_THINKERS = ["thinker_qid", "thinker_name", "wikiquote_title", "source_url", "source_revision", "fetched_at"]
SERVING_QUOTES = [
    "occurrence_id",
    "quote_id",
    "thinker_qid",
    "quote_text",
    "original_text",
    "original_language",
    "category",
    "work",
    "source_url",
    "source_name",
    "source_license",
    "source_revision",
    "translator_name",
    "translation_license",
    "translation_url",
    "character_count",
    "curation_status",
    "quality_reason",
    "quality_reasons",
    "is_daily_eligible",
]
METADATA_TEXTS = [
    "dataset_version",
    "source_fetched_at",
    "pipeline_version",
    "parser_version",
    "run_id",
    "manifest_sha256",
    "source_commit",
]
SERVING_NULLABLE = {
    "original_text",
    "original_language",
    "work",
    "translator_name",
    "translation_license",
    "translation_url",
}
SELECTION_FIELDS = [
    "occurrence_id",
    "quote_text",
    "original_text",
    "original_language",
    "thinker_name",
    "category",
    "work",
    "source_name",
    "source_license",
    "source_url",
    "translator_name",
    "translation_license",
    "translation_url",
]

# Fixed value: the thinker without queue entries.
QUEUE_EXEMPT = ("Q7186",)
