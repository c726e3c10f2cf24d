"""Default rule tables.

Every job takes its rules as arguments: an ordered list of (name, keywords). The defaults below are
written for the four languages of the sample tables; a deployment passes its own vocabulary.
"""

# Chunk category: first rule hit wins, in this order.
CATEGORY_RULES = [
    ("policy", ["license", "copyright", "rights reserved"]),
    ("contact", ["@mail", "+1 ("]),
    ("price", ["token = ", "%%%"]),
    ("schedule", ["lichkeit", "tionwh", "ourle"]),
    ("booking", ["ciónes", "eauxle"]),
    ("offer", ["ungein", "reonth", "ellepa"]),
    ("service", ["keitver", "thering", "mentla"]),
    ("experience", ["thand", "éoi", "ñjo"]),
]
DEFAULT_CATEGORY = "overview"

# Days a chunk of a category stays valid; other categories never expire.
TTL_DAYS = {"offer": 7, "price": 7, "booking": 7, "membership": 7, "schedule": 14}
VOLATILE = ["offer", "price", "booking", "membership"]

# Query side: categories a question asks for.
SEARCH_RULES = [
    ("policy", ["license", "keit"]),
    ("contact", ["with", "mit "]),
    ("price", ["from", "que "]),
    ("schedule", ["this", "nicht"]),
    ("booking", ["para", "avec"]),
    ("offer", ["ering", "pour"]),
    ("experience", ["that", "eaux"]),
]

# Place tags in a fixed order.
PLACE_RULES = [("north", ["north", "nord"]), ("south", ["south", "sud"]), ("harbour", ["hafen", "port"])]

# URL rules: category by substring, first hit wins; crawled first to last in the same order.
URL_CATEGORY_RULES = [
    ("experience", ["blog."]),
    ("price", ["/price/"]),
    ("service", [".html"]),
    ("offer", ["//m."]),
    ("booking", ["/es/"]),
]
URL_CATEGORY_RANK = {name: place for place, (name, _) in enumerate(URL_CATEGORY_RULES)}
AUTH_SEGMENTS = ["login", "register"]
TRANSACTION_SEGMENTS = ["/cart", "/checkout", "/account", "/wp-admin"]

# Headings whose blocks are navigation, and lines after which a page holds only related content.
RELATED_HEADINGS = ["related posts", "recommended articles", "you may also like"]
FOOTER_PREFIXES = ["see also", "further reading", "© "]
NOISE_LINES = ["skip to content", "de", "en", "es", "fr"]
NOISE_FRAGMENTS = ["#skip", "?ref="]
BAD_LABEL_FRAGMENTS = ["skip to", "?utm_", "://"]
WIDGET_HEADINGS = ["booking", "book tickets"]

# Dialogue rules.
GREETINGS = ["hello", "hi", "thanks", "thank you", "the", "que", "in"]
OUT_OF_SCOPE = ["weather", "football", "stock", "bitcoin", "ñjos", "öungen"]
ANCHORS = ["thering", "keitung", "eauxla"]
TIME_SENSITIVE = ["voucher", "price", "today", "ciónla", "eauxde", "erthe", "ungder"]
CLASSIFIER_HINTS = ["budget", "cost", "thatth", "leré"]
INTENT_RULES = [
    ("ticket_price", ["ciónla", "eauxde"]),
    ("show_schedule", ["tiontion", "schein"]),
    ("animal_info", ["elleau"]),
    ("opening_hours", ["onwh", "keitein"]),
    ("time_sensitive", ["erthe", "ungder"]),
]
ENTITY_KEYWORDS = ["voucher", "tiontion", "keitein", "eauel", "thand", "lichen", "ciónpa"]
FOLLOW_UP_MARKERS = ["what about", "and then", "ndthe", "schen", "éoi", "ñj"]
RETRY_PHRASES = {
    "opening_hours": "when the doors are open",
    "animal_info": "which animals live here",
    "show_schedule": "what is on stage and when",
    "ticket_price": "what admission costs",
}
RETRY_DEFAULT = "what there is to see"
BRAND_PHRASE = "knowledge base guide"
CONNECTOR = ". Follow-up question: "
ACTIONS = {
    "stale_or_missing_time_sensitive_data": "contact_hotline_or_booking",
    "low_confidence": "check_official_site",
    "ungrounded_answer": "contact_hotline_or_booking",
}
STOPWORDS = ["https", "www", "com", "the", "and", "with", "from", "where", "for", "des", "les", "der", "die",
             "und", "que", "los"]
