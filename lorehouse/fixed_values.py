"""Word lists, constants, patterns and formats the results depend on."""

# --- chunking ---------------------------------------------------------------
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 200
DECISIONS_LABEL = "Решения"
ACTION_ITEMS_LABEL = "Поручения"
MEETING_DATE_PREFIX = "Дата: "
PARTICIPANTS_PREFIX = "Участники: "

# --- document types, statuses, vocabularies ---------------------------------
GENERIC_TYPE = "generic"
EXTRACTION_STATUSES = ("pending", "done", "failed", "skipped")
TERMINAL_STATUSES = ("done", "failed", "skipped")
REGULATION_STATUSES = ("active", "draft", "deprecated")
SOURCE_KINDS = ("file", "url")
MESSAGE_ROLES = ("user", "assistant")
CONFIDENCE_MIN = 0.6

# --- retrieval ---------------------------------------------------------------
RRF_K = 60
SEARCH_LIMIT = 4
CANDIDATES_PER_LIST = 20
QUERY_PREFIX = "Represent the query for retrieving supporting documents: "
EMBED_DIM = 1024
DOCUMENT_LIMIT = 15
MAX_DEPTH = 3
MAX_NODES = 40
COVER_WEIGHT = 0.1

# --- facts and topics --------------------------------------------------------
TOPIC_SIMILARITY = 0.75
TOPIC_WORDS = 4
TOPIC_WORD_MIN = 3
DEFAULT_TOPIC = "fakt"
TOPIC_STOPWORDS = (
    "и", "в", "во", "на", "с", "со", "по", "о", "об", "из", "к", "у", "за", "от", "до", "для",
    "что", "как", "это", "наш", "наша", "наши", "мы", "нас",
    "the", "a", "an", "of", "to", "and", "or", "for",
)
FACTS_HEADER = "АКТУАЛЬНЫЕ ФАКТЫ:"
FACTS_BLOCK_LIMIT = 4000

# --- text limits -------------------------------------------------------------
HEAD_TAIL_MAX = 15_000
HEAD_CHARS = 12_000
TAIL_CHARS = 3_000
HEAD_TAIL_MARK = "\n…\n"
BODY_MAX = 8_000
BODY_MARK = "\n…[усечено]"
MESSAGE_LIMIT = 4_000
CHARS_PER_TOKEN = 4
CACHE_MIN_TOKENS = 4_096
BUFFER_JOIN = "\n\n"

# --- sources -----------------------------------------------------------------
TEXT_EXTENSIONS = (".txt", ".md", ".markdown")
HTML_EXTENSIONS = (".html", ".htm")
OFFICE_EXTENSIONS = (".pdf", ".docx", ".pptx")
MAX_FILE_BYTES = 20 * 1024 * 1024

# --- sessions, conversations, cost --------------------------------------------
IDLE_MINUTES = 60
HISTORY_LIMIT = 8
MONTHLY_LIMIT = 20.0

# --- evaluation ---------------------------------------------------------------
REFUSAL_PHRASE = "в базе знаний этого нет"
CLARIFY_MARKERS = ("уточн", "переформулир", "слишком общ", "больше информации", "не совсем понял")
SOURCE_MARKER = "источник"
VERDICTS = (
    "correct", "partial", "incorrect", "hallucinated",
    "false_refusal", "unnecessary_clarification", "correct_refusal",
)
THRESHOLDS = (
    ("type_accuracy", 0.90),
    ("recall_at_4", 0.85),
    ("attribute_completeness", 0.80),
    ("graph_accuracy", 0.75),
    ("refusals", 1.00),
)

# --- addresses that are never fetched (IANA special-purpose registries) ---------
BLOCKED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
ALLOWED_IPV4 = ("192.0.0.9/32", "192.0.0.10/32")

# The Russian Snowball stemmer's vowels and endings (longest first within a
# search; those "after a" must follow а or я), and its stop words.
RUSSIAN_VOWELS = "аеиоуыэюя"
RUSSIAN_GERUNDS_AFTER_A = "в вши вшись"
RUSSIAN_GERUNDS = "ив ивши ившись ыв ывши ывшись"
RUSSIAN_REFLEXIVES = "ся сь"
RUSSIAN_ADJECTIVES = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
RUSSIAN_PARTICIPLES_AFTER_A = "ем нн вш ющ щ"
RUSSIAN_PARTICIPLES = "ивш ывш ующ"
RUSSIAN_VERBS_AFTER_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно"
RUSSIAN_VERBS = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю"
RUSSIAN_NOUNS = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"
RUSSIAN_STOP_WORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня еще нет о из "
    "ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может "
    "они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому "
    "этого какой совсем ним здесь этом один почти мой тем чтобы нее сейчас были куда зачем всех никогда можно при наконец два об "
    "другой хоть после над больше тот через эти нас про всего них какая много разве три эту моя впрочем хорошо свою этой перед "
    "иногда лучше чуть том нельзя такой им более всегда конечно всю между"
)
