"""Fixed values that the semantics depend on: word lists, markers, phrases and
limits, in their natural order."""

from __future__ import annotations

# Words that never act as the subject of a query.
STOPWORDS = """
the a an is are was were be been being of in on at to for with by from about into through during before after above below
how what when where who which why this that these those it its they them do does did have has had can could would should will
many much few more most and or but not year years number numbers day days month months definition meaning name names current best latest
""".split()

# Words that frame a question.
FRAMING = """
how what when where who which why is are was were do does did the a an of in on at to for from by with about and or that this
these those it its there their his her be been being has have had
""".split()

# Markers of challenge, block and error pages.
CHALLENGE_MARKERS = [
    "your request has been blocked", "request has been blocked", "appears to be from an automated process", "automated process",
    "if this is incorrect, please click this link", "turn on cookies in your browser", "enable cookies in your browser",
    "please verify you are a human", "verify you are human", "captcha", "recaptcha", "cloudflare", "attention required",
    "access denied", "access to this page has been denied", "403 forbidden", "404 not found", "500 internal server error",
    "service unavailable", "sign in to continue", "log in to continue", "javascript is required", "please enable javascript",
]

# URL parts of dictionary and disambiguation stubs, and the
# titles and URL parts of the two encyclopedia stubs.
HEAD_STUBS = [
    "/wiki/year", "/wiki/number", "/wiki/month", "/wiki/day", "/wiki/calendar_year", "dictionary.reverso.net",
    "merriam-webster.com/dictionary/year", "merriam-webster.com/dictionary/number", "thefreedictionary.com/year",
    "thefreedictionary.com/number", "todaysdatenow.com", "en.wiktionary.org/wiki/year", "en.wiktionary.org/wiki/number",
]
STUB_TITLES = ["year - wikipedia", "number - wikipedia", "year", "number"]
STUB_WIKI_URLS = ["wikipedia.org/wiki/year", "wikipedia.org/wiki/number"]

# Mentions of a community and the domains that satisfy them.
INTENT_DOMAINS = {
    "reddit": ["reddit.com"], "github": ["github.com"], "stackoverflow": ["stackoverflow.com"], "stack exchange": ["stackexchange.com"],
    "arxiv": ["arxiv.org"], "wikipedia": ["wikipedia.org"], "docs.rs": ["docs.rs"], "crates.io": ["crates.io", "lib.rs"],
    "mdn": ["developer.mozilla.org"], "hacker news": ["news.ycombinator.com"],
}
DISCUSSION_WORDS = ["discussion", "reddit", "forum", "thread"]

# Words of measurement, which weigh less than subjects.
METRIC_WORDS = """
sum total average mean median range level degrees meters kilometers miles feet inches seconds minutes hours rate elevation distance
temperature pressure frequency value speed size weight height depth width volume area length price cost score count amount ratio percentage
""".split()

# URL markers of pages in other scripts.
OTHER_SCRIPT_MARKERS = [
    "hl=ru", "hl=uk", "hl=be", "hl=zh", "hl=ja", "hl=ko", "hl=ar", "hl=he", "hl=hi", "hl=th", "hl=el", "hl=bg", "hl=sr", "hl=fa", "hl=ur",
    "lr=lang_ru", "lr=lang_zh", "lr=lang_ja", "lr=lang_ko", "lr=lang_ar",
]

# Query parameters that only track, besides utm_*.
TRACKING_PARAMS = ["ref", "fbclid", "gclid", "dclid", "msclkid", "msockid", "mc_cid", "mc_eid", "igshid", "ref_src", "_ga", "_gl"]

# Second-level labels under two-letter domains.
SECOND_LEVEL = ["co", "com", "org", "gov", "edu", "ac", "net"]

# Cues of numeric questions and of questions for a year.
NUMERIC_CUES = [
    "how many", "how much", "how long", "how far", "how fast", "how old", "how tall", "how deep", "how wide", "how heavy", "population",
    "temperature", "speed", "distance", "weight", "height", "length", "area", "volume", "capacity", "salary", "cost", "price", "percentage",
    "ratio", "average", "total", "count", "size", "radius", "diameter", "frequency", "wavelength", "voltage", "current", "power", "pressure",
    "altitude", "latitude", "longitude", "duration", "age", "throughput", " number of ",
]
YEAR_CUES = ["what year", "which year", "in what year", "when did", "when was", "what date"]

# Phrases that let a vertical provider take part in a query.
GATES = {
    "arxiv": ["paper", "papers", "arxiv", "study", "studies", "research", "survey", "benchmark", "benchmarks", "dataset", "preprint", "doi", "sota"],
    "news_rss": ["breaking", "today", "yesterday", "this week", "election", "elections", "headlines", "latest news"],
    "stackexchange": ["how", "why", "error", "exception", "failed", "cannot", "undefined", "fix", "debug", "traceback", "panic", "bug", "?"],
    "mdn": [
        "html", "css", "javascript", "typescript", "dom", "fetch", "cors", "flexbox", "grid", "http", "cookie", "localstorage", "webpack", "vite",
        "react", "vue", "svelte", "node", "npm", "wasm", "webassembly", "browser",
    ],
    "github": [
        "error", "exception", "failed", "bug", "crash", "panic", "cannot", "undefined", "library", "crate", "framework", "plugin", "sdk", "cli",
        "tool", "extension", "vs code",
    ],
    "hackernews": ["release", "announce", "announced", "launch", "launched", "startup", "funding", "ycombinator", "ipo", "breaking", "today"],
}
GATES["scholar"] = GATES["arxiv"]
ISSUE_WORDS = ["error", "exception", "failed", "bug", "crash", "panic", "cannot", "undefined"]

# Words that shorten the life of a cached result.
NEWS_WORDS = ["today", "latest", "breaking", "news"]
DOCS_WORDS = ["documentation", "docs", "api", "rust", "python", "guide"]
NEWS_TTL, DOCS_TTL, OTHER_TTL = 900, 14_400, 3_600

# Providers, and the index that each one draws on.
PROVIDERS = """
duckduckgo bing yahoo mojeek google_wml brave searxng arxiv scholar stackexchange mdn github hackernews news_rss wikipedia
""".split()
DEFAULT_PROVIDERS = ["duckduckgo", "bing", "yahoo", "brave", "wikipedia"]
VERTICALS = ["arxiv", "scholar", "stackexchange", "mdn", "github", "hackernews", "news_rss"]
INDEX_FAMILY = {"duckduckgo": "bing", "bing": "bing", "yahoo": "bing", "google_wml": "google", "news_rss": "news"}

# Entities, decoded one after the other in this order.
ENTITIES = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"),
]

# Elements whose content is no text of a page.
DROPPED_TAGS = ["head", "script", "style", "template", "svg", "nav", "header", "footer", "aside", "form", "iframe", "noscript"]

# Networks that a fetch must not reach.
DENIED_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]
DENIED_V6 = [
    "::1/128", "::/128", "ff00::/8", "fc00::/7", "fe80::/10", "fec0::/10", "100::/64", "2001:db8::/32", "64:ff9b::/96", "64:ff9b:1::/48",
    "2001::/32", "2001:2::/48", "2001:20::/28", "2002::/16",
]
