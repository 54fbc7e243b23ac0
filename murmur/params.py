"""Job parameters. They must equal the published defaults."""

# Post sources in arrival order. The order is semantic: de-duplication is
# staged source by source and always keeps the earlier one.
SOURCES = ("reddit", "stocktwit", "twitter")

# Hours to look back for trending and for other stocks.
LOOKBACK_TRENDING = 6
LOOKBACK_OTHER = 168

# Minimum short float in percent, and the levels a screen may ask for.
SHORT_LEVEL = 30
SHORT_LEVELS = (0, 5, 10, 15, 20, 25, 30)

# Minimum market capitalisation in dollars.
MIN_CAP = 500e6

# Entry and hold thresholds: comments, then mean sentiment in percent.
MIN_COMMENTS = 60
ENTRY_SENTIMENT = 20
HOLD_SENTIMENT = 15

# Most posts taken from one fetch, and trending stocks taken from one list.
COMMENT_LIMIT = 100_000
TRENDING_LIMIT = 10

# Tokens of a post that the sentiment model gets.
MODEL_TOKENS = 50

# Fewest headlines that make a session count.
MIN_HEADLINES = 15

# Sessions run from 09:30 to 09:30.
SESSION_OPEN_HOUR = 9
SESSION_OPEN_MINUTE = 30

# Words taken out of a company name, in this order, case-sensitive.
NAME_WORDS = (
    "limited",
    "Limited",
    "Inc.",
    "INC",
    "Corporation",
    "Corp.",
    "Corp",
    "Co.",
    "Ltd",
    "ltd",
    ",",
)

# Languages kept by the lenient filter. Cashtags make language models answer
# "pl" for English posts, hence the second one.
LENIENT_LANGS = ("en", "pl")
STRICT_LANG = "en"

# Body of a post that its author or a moderator took down.
REMOVED_BODY = "[removed]"

# Logit positions of the three-label sentiment model.
NEGATIVE, NEUTRAL, POSITIVE = 0, 1, 2

# Columns of one news record, in load order.
NEWS_COLUMNS = (
    "category",
    "datetime",
    "headline",
    "id",
    "image",
    "related",
    "source",
    "summary",
    "url",
)

# Label spines: labels for the hour-based list, days for the date-based list.
AGE_LABELS = 59
DATE_LABELS = 40

# Bins of the sentiment histogram.
HISTOGRAM_BINS = 50
