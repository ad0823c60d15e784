"""Fixed values.

Every list below must equal the behaviour being reproduced, so the values are
stated plainly, in their natural order.  Operators take them as *default
parameters*: callers pass their own vocabularies, lexicons and weights.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: default vocabularies
# ---------------------------------------------------------------------------

CRYPTO_SYMBOLS = [
    "BTC", "ETH", "BNB", "XRP", "ADA", "DOGE", "SOL", "TRX", "LTC", "AVAX",
    "DOT", "MATIC", "SHIB", "UNI", "LINK", "ATOM", "XLM", "ALGO", "VET", "ICP",
    "FIL", "MANA", "SAND", "AXS", "THETA", "AAVE", "MKR", "COMP", "SNX", "YFI",
]

CRYPTO_KEYWORDS = [
    "bitcoin", "ethereum", "crypto", "blockchain", "defi", "nft", "web3",
    "hodl", "moon", "lambo", "diamond hands", "paper hands", "bull", "bear",
    "pump", "dump", "whale", "ape", "fud", "fomo", "rugpull", "altcoin",
    "staking", "yield farming", "liquidity mining", "metaverse", "dao",
]

# Per-platform extra relevance patterns (applied to lower-cased text).
# Written with the portable word boundary WB (see functions/patterns.py),
# i.e. "\bword\b" becomes WB-word-WB.
REDDIT_PATTERN_WORDS = [
    "crypto", "blockchain", "hodl", "tothemoon", "whale", "pump", "dump",
    "fud", "fomo", "altcoin", "defi", "nft", "web3",
]
# news: "digital asset" has no right boundary; "all time high" allows "alltime"
NEWS_PATTERNS = [
    ("cryptocurrency", True), ("digital{s}+asset", False), ("digital{s}+currency", True),
    ("market{s}+cap", True), ("trading{s}+volume", True), ("all{s}*time{s}+high", True),
    ("bull{s}+run", True), ("bear{s}+market", True), ("whale{s}+alert", True),
]
TELEGRAM_EMOJI = ["\U0001F680", "\U0001F4C8", "\U0001F4C9", "\U0001F48E", "\U0001F319"]
TELEGRAM_PATTERNS = [
    "to{s}+the{s}+moon", "hodl", "dip", "pumping", "dumping", "whales?",
    "signal", "buy", "sell", "target",
]
DISCORD_PATTERNS = [
    "to{s}+the{s}+moon", "hodl", "diamond{s}+hands", "paper{s}+hands",
    "whale{s}+alert", "rug{s}*pull", "gm", "gn", "lfg", "wagmi", "ngmi",
    "airdrop", "mint", "floor",
]

# Discord monitored-channel name terms (substring test on lower-cased name).
DISCORD_CHANNEL_TERMS = [
    "crypto", "bitcoin", "btc", "ethereum", "eth", "trading", "signals",
    "market", "analysis", "price", "discussion", "general", "defi",
    "nft", "altcoin", "binance", "coinbase",
]

# News: relevance-score domain bonus and source classification.
RELEVANCE_DOMAINS = ["cointelegraph", "coindesk", "cryptonews", "bitcoinist", "cryptopotato"]
SOURCE_CLASSES = [
    ("crypto_specialized", ["cointelegraph", "coindesk", "cryptonews", "bitcoinist"]),
    ("business_mainstream", ["bloomberg", "reuters", "cnbc", "marketwatch"]),
    ("tech_focused", ["techcrunch", "wired", "ars", "theverge"]),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: validation
# ---------------------------------------------------------------------------

ALLOWED_SOURCES = ["twitter", "reddit", "telegram", "discord", "news",
                   "web", "blog", "forum", "chat", "social"]
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
MAX_TEXT_CHARS = 10000

# ---------------------------------------------------------------------------
# FIXED VALUES: lexicon model
# ---------------------------------------------------------------------------

# Domain overlay on the general lexicon (underscore keys only match
# underscore tokens).
CRYPTO_LEXICON_OVERLAY = {
    "moon": 2.0, "lambo": 2.0, "hodl": 1.5, "diamond_hands": 2.0,
    "to_the_moon": 2.5, "bullish": 2.0, "bearish": -2.0, "fud": -2.0,
    "fomo": 1.0, "pump": 1.5, "dump": -2.0, "rug_pull": -3.0,
    "whale": 0.5, "dip": -0.5, "ath": 2.0, "rekt": -2.5,
}

# Published VADER constants (Hutto & Gilbert, ICWSM 2014; MIT-licensed
# reference implementation): negation scalar, normalisation alpha, caps and
# punctuation increments.
NEGATION_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
CAPS_INCREMENT = 0.733
EXCLAIM_INCREMENT = 0.292
QUESTION_INCREMENT_SMALL = 0.18
QUESTION_INCREMENT_LARGE = 0.96
BUT_BEFORE = 0.5
BUT_AFTER = 1.5

# FIXED VALUES: published VADER degree words; an intensifier adds BOOST, a
# dampener takes it away, scaled by BOOST_DAMP at one, two and three words' distance.
BOOST = 0.293
BOOST_DAMP = (1.0, 0.95, 0.9)
INTENSIFIERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous "
    "enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin "
    "frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly "
    "hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably "
    "so substantially thoroughly total totally tremendous tremendously uber unbelievable unbelievably unusually "
    "utter utterly very").split()
DAMPENERS = (
    "almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly "
    "scarce scarcely slight slightly somewhat sorta sortof sort-of").split()
BOOSTERS = {**{w: BOOST for w in INTENSIFIERS}, **{w: -BOOST for w in DAMPENERS}}

# Published VADER negation words.
NEGATORS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

# ---------------------------------------------------------------------------
# FIXED VALUES: ensembles
# ---------------------------------------------------------------------------

SOCIAL_SOURCES = ["twitter", "reddit", "telegram", "discord"]
NEWS_SOURCES = ["news", "bloomberg", "reuters"]

# top-level ensemble weights per source group
ENSEMBLE_WEIGHTS = {
    "social": {"finbert": 0.3, "vader": 0.4, "textblob": 0.1, "crypto_specific": 0.2},
    "news": {"finbert": 0.5, "vader": 0.2, "textblob": 0.1, "crypto_specific": 0.2},
    "default": {"finbert": 0.4, "vader": 0.2, "textblob": 0.2, "crypto_specific": 0.2},
}
# transformer-level ensemble weights per source group
TRANSFORMER_WEIGHTS = {
    "social": {"finbert": 0.3, "twitter_roberta": 0.7},
    "news": {"finbert": 0.8, "twitter_roberta": 0.2},
    "default": {"finbert": 0.6, "twitter_roberta": 0.4},
}
# model name -> key in the weight table (weighted ensemble)
MODEL_NAME_MAP = {"transformer": "finbert", "vader": "vader"}
DEFAULT_MODEL_WEIGHT = 0.5
MIN_CONFIDENCE = 0.1
HISTORY_SIZE = 100
SEARCH_HOURS = 168

CLASSIFIER_LABELS = ["negative", "neutral", "positive"]
LABEL_VALUES = {"negative": -1.0, "neutral": 0.0, "positive": 1.0}

# sentiment label thresholds (strict on both sides)
POSITIVE_ABOVE = 0.1
NEGATIVE_BELOW = -0.1

# engagement formulas
TWEET_ENGAGEMENT = {"likes": 1.0, "retweets": 2.0, "replies": 1.5, "quotes": 2.0}
TELEGRAM_ENGAGEMENT = {"views": 0.1, "forwards": 2.0, "replies": 1.5}
DISCORD_ENGAGEMENT = {"reactions": 2.0, "mentions": 0.5}

# ---------------------------------------------------------------------------
# FIXED VALUES: symbol-mention pair patterns per platform dialect
# (template, needs_right_word_boundary); "{S}" is the symbol.  Every dialect
# also matches the bare symbol as a whole word (which subsumes "$S" and "#S").
# ---------------------------------------------------------------------------

MENTION_PAIRS = {
    "twitter": [],
    "reddit": [("{S}/USD", False), ("{S}USD", False)],
    "news": [("{S}/USD", False), ("{S}USD", False), ("{S}-USD", False)],
    "telegram": [("{S}/USDT", True), ("{S}USDT", True), ("{S}/BTC", True), ("{S}BTC", True)],
    "discord": [("{S}/USDT", True), ("{S}USDT", True), ("{S}/BTC", True)],
}

# per-symbol search terms (tweet search uses four, the stream track list three)
SEARCH_TERMS = ["${S}", "#{S}", "{S} crypto", "{S} bitcoin"]
TRACK_TERMS = ["${S}", "#{S}", "{S} crypto"]

# FIXED VALUES: news feed catalogue by source type
NEWS_FEEDS = {
    "crypto_specialized": [
        "https://cointelegraph.com/rss",
        "https://coindesk.com/arc/outboundfeeds/rss/",
        "https://cryptonews.com/feed/",
        "https://bitcoinist.com/feed/",
        "https://cryptopotato.com/feed/",
        "https://ambcrypto.com/feed/",
        "https://cryptoslate.com/feed/",
        "https://decrypt.co/feed",
        "https://www.theblock.co/rss.xml",
        "https://blockworks.co/feed/",
    ],
    "business_mainstream": [
        "https://feeds.bloomberg.com/markets/news.rss",
        "https://feeds.reuters.com/reuters/businessNews",
        "https://www.ft.com/technology?format=rss",
        "https://www.cnbc.com/id/10000664/device/rss/rss.html",
        "https://www.marketwatch.com/rss/topstories",
    ],
    "tech_focused": [
        "https://techcrunch.com/feed/",
        "https://www.wired.com/feed/rss",
        "https://arstechnica.com/feeds/rss/",
        "https://www.theverge.com/rss/index.xml",
    ],
}
ALL_FEEDS = [u for group in NEWS_FEEDS.values() for u in group]
