"""Word lists, reasons and constants that decide results.

Fixed values. They are plain data and must stay exactly as they are for results
to be right; pass your own ``RuleBook`` to change them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Title keywords that mark a low-value post, with the reason to record.
# The first entry contained in the title wins, so the order matters.
SKIP_PATTERNS: list[tuple[str, str]] = [
    ("fullz", "identity document vendor post"),
    ("full info", "fullz vendor post"),
    ("real docs", "document vendor post"),
    ("price from $", "vendor pricing post"),
    ("price from €", "vendor pricing post"),
    (" for sale ", "item for sale listing"),
    ("buy now", "vendor listing"),
    ("dm me", "vendor contact post"),
    ("contact me", "vendor contact post"),
    ("telegram @", "vendor contact post"),
    ("whatsapp:", "vendor contact post"),
    ("whatsapp +", "vendor contact post"),
    ("buy fake", "document vendor post"),
    ("buy real and fake", "document vendor post"),
    ("buy diplomatic", "document vendor post"),
    ("buy passport", "document vendor post"),
    ("sell clone card", "carding vendor post"),
    ("sell cc ", "carding vendor post"),
    ("netflix account", "cracked streaming account"),
    ("spotify account", "cracked streaming account"),
    ("disney account", "cracked streaming account"),
    ("hbo account", "cracked streaming account"),
    ("gaming account", "cracked gaming accounts"),
    ("cracked account", "cracked account selling"),
    ("verified account", "cracked account selling"),
    (" variant ", "malware analysis article"),
    ("android trojan", "malware analysis article"),
    ("vulnerability discovered", "vulnerability news"),
    ("patch tuesday", "patch news"),
    ("zero-day in", "vulnerability news"),
    ("researchers found", "research article"),
    ("researchers discover", "research article"),
    ("hello everyone", "introduction post"),
    ("hi everyone", "introduction post"),
    ("introduction post", "introduction post"),
    ("new member", "introduction post"),
    ("i am here", "introduction post"),
    ("combo list", "email combo aggregation"),
    ("combolist", "email combo aggregation"),
    ("combos ", "email combo aggregation"),
    ("combo mixed", "email combo aggregation"),
    ("combo { ", "country combo list"),
    ("k++ ] combo", "country combo list"),
    ("k++ combo", "country combo list"),
    ("mixed combo", "combo aggregation"),
    ("email:pass", "email:pass combo dump"),
    ("mail:pass", "email:pass combo dump"),
    ("user:pass", "credential combo dump"),
    ("login:pass", "credential combo dump"),
    ("id:pass", "credential combo dump"),
    ("fresh combo", "fresh combo list"),
    ("free combo", "free combo list"),
    ("hq combo", "high-quality combo list"),
    ("private combo", "combo list"),
    ("combo pack", "combo pack aggregation"),
    ("collection #", "aggregate collection"),
    ("anti-public", "anti-public combo"),
    ("breach compilation", "compiled breach aggregation"),
    ("data compilation", "compiled data aggregation"),
    ("mega leak", "generic mega-leak aggregation"),
    ("openbullet", "cracking tool config"),
    ("silverbullet", "cracking tool config"),
    ("sentry mba", "cracking tool config"),
    ("hq config", "cracking tool config"),
    ("checker config", "cracking tool config"),
    ("config file", "cracking config"),
    ("cracking tool", "cracking tool"),
    ("brute forcer", "brute force tool"),
    (" checker ", "credential checker tool"),
    ("checker v", "credential checker tool"),
    ("wordlist", "wordlist/dictionary file"),
    ("word list", "wordlist/dictionary file"),
    ("rainbow table", "hash rainbow table"),
    ("dehash", "hash cracking service"),
    ("hash crack", "hash cracking"),
    ("ntlm hash", "hash dump without named org"),
    ("md5 hash", "hash dump without named org"),
    ("stealer log", "infostealer logs aggregation"),
    ("infostealer log", "infostealer logs aggregation"),
    ("redline log", "redline stealer logs"),
    ("vidar log", "vidar stealer logs"),
    ("raccoon log", "raccoon stealer logs"),
    ("fresh log", "stealer logs aggregation"),
    ("logs fresh", "stealer logs aggregation"),
    ("private logs", "stealer logs aggregation"),
    ("email list", "generic email list"),
    ("mail list", "generic email list"),
    ("email database", "generic email database"),
    ("email leads", "email marketing leads"),
    ("spam list", "spam email list"),
    ("rat release", "RAT malware release"),
    ("keylogger", "keylogger tool"),
    ("botnet", "botnet tool/panel"),
    ("ddos tool", "DDoS tool"),
    ("stresser", "stresser/booter tool"),
    ("crypter fud", "malware crypter"),
    ("socks5 list", "proxy list"),
    ("proxy list", "proxy list"),
    ("fresh proxy", "proxy list"),
    ("vpn account", "VPN account selling"),
]

# Title substrings that always send a post to scoring.
NAMED_TARGETS: list[str] = [
    "lockbit", "alphav", "cl0p", "clop", "blackcat", "ransomhub", "akira",
    "play ransomware", "black basta", "medusa", "8base", "rhysida", "hunters",
    "killsec", "monti", "incransom", "cicada3301", "fog ransomware",
    "bank", "banking", "fintech", "credit union", "insurance", "payment",
    "broker", "mortgage", "investment", "financial", "trading platform",
    "visa", "mastercard", "american express", "paypal", "stripe",
    "hospital", "clinic", "medical", "health", "pharmacy", "patient data",
    "healthcare", "nhs", "medicare", "medicaid", "dental", "laboratory",
    "government", "ministry of", "department of", "federal",
    "national id", "national database", "citizen", "municipality", "police",
    "military", "intelligence", "agency", "senate", "parliament",
    "electoral", "tax authority", "immigration", "border",
    "power grid", "electricity", "utility", "water treatment", "pipeline",
    "airport", "railway", "metro", "telecom", "isp", "carrier",
    "university", "college", "school district", "research institute",
    "employee data", "customer database", "user database", "internal data",
    "source code", "proprietary", "confidential",
]

# Text substrings of vendor adverts; the first one contained ends scoring.
VENDOR_PATTERNS: list[str] = [
    "whatsapp:", "whatsapp +", "telegram @", "telegram:", "@telegram",
    "buy fake", "buy real and fake", "buy diplomatic", "buy passport",
    "buy driver", "buy id card", "sell clone card", "sell cc ", "sell cvv",
    "combo mixed email", "combo mixed mail", "k++ combo", "k++ ] combo",
    "combo { ", "[ combo", "fresh combo", "free combo", "hq combo",
    "private combo", "combo pack", "mixed combo",
]

# Site name substrings per class.
TIER1_SITES: list[str] = ["breachforum", "leakbase", "thejavasea", "exploit-in", "xss-is"]
TIER2_SITES: list[str] = [
    "probiv", "darkforum", "altenens", "nulled", "leakforum",
    "mipped", "hard-tm", "dublikat", "leetforum", "ipbmafia",
]
RANSOM_SITES: list[str] = ["ransomware", "ransom", "lockbit", "alphv", "blackcat"]

# Bare substrings that speak for or against freshness.
FRESH_POSITIVE: list[str] = [
    "fresh", "new", "latest", "2024", "2025", "2026", "today", "just", "hot", "0day",
]
FRESH_NEGATIVE: list[str] = [
    "old", "2020", "2019", "2018", "2017", "2016", "2015", "leaked in 20", "from 20",
]

# Data type names and the substrings that show them.
DATA_TYPES: dict[str, list[str]] = {
    "email": ["email", "e-mail", "@gmail", "@yahoo", "@hotmail", "@outlook"],
    "password": ["password", "passwd", "pwd", "hash", "md5", "sha1", "bcrypt", "ntlm", "plaintext", "cracked"],
    "phone": ["phone number", "mobile number", "telephone", "gsm", "sms code"],
    "address": ["home address", "physical address", "location data", "zip code", "postal code"],
    "credit_card": ["credit card", "cc dump", "cvv", "cvc", "fullz", "card number", "debit card"],
    "ssn": ["ssn", "social security", "national id number", "tax id"],
    "dob": ["date of birth", "birthday", "birthdate", "dob:"],
    "ip": ["ip address", "ip log", "ipv4", "ipv6"],
    "cookie": ["cookie", "session token", "auth token", "session cookie"],
    "source_code": ["source code", "gitlab", "repository leak", "git dump"],
    "financial": ["bank account", "iban", "swift code", "routing number", "account balance", "wire transfer"],
    "medical": ["medical record", "health record", "patient data", "diagnosis", "prescription", "hipaa"],
    "government": ["government database", ".gov", "military data", "dod ", "nsa ", "fbi ", "cia "],
    "combo": ["combolist", "combo list", "mail:pass", "email:pass", "user:pass", "login:pass"],
}

# Word groups of the category decision list.
COMBO_WORDS: list[str] = ["combolist", "combo list"]
DATABASE_WORDS: list[str] = ["database", "db dump", "sql dump", "backup", "table dump"]
ACCESS_WORDS: list[str] = ["access", "rdp", "shell", "vpn access", "ssh", "admin panel"]
DISCUSSION_WORDS: list[str] = ["tutorial", "guide", "how to", "discussion", "question", "help", "ask"]

# Lowest record count of each base score; zero or fewer scores 2.
RECORD_SCORE_STEPS: list[tuple[int, int]] = [
    (100_000_000, 9), (10_000_000, 8), (1_000_000, 7), (100_000, 6), (10_000, 5), (1_000, 4), (1, 3),
]
UNKNOWN_RECORDS_SCORE = 2
MAX_RECORDS = 2_147_483_647
URGENT_MIN_SCORE = 8
URGENT_MIN_RECORDS = 100_000
COMBO_MAX_SCORE = 4
MAX_TYPE_BOOST = 3

# Number units that follow a count, and the plain unit nouns.
BILLION_UNITS: list[str] = ["billion", "bln", "b"]
MILLION_UNITS: list[str] = ["million", "mln", "m"]
THOUSAND_UNITS: list[str] = ["k", "thousand"]
RECORD_NOUNS: list[str] = [
    "records?", "rows?", "accounts?", "users?", "emails?", "lines?", "entries",
    "creds?", "credentials?", "passwords?", "combos?",
]

# Words reported as sensitive fields, in this order.
SENSITIVE_FIELDS: list[str] = [
    "ssn", "social security", "credit card", "passport", "medical", "health",
    "dob", "date of birth", "salary", "bank account", "iban", "swift",
]

# Badge class and the site name substrings that give it, first hit wins.
SITE_BADGES: list[tuple[str, list[str]]] = [
    ("t1", ["breachforum", "leakbase", "thejavasea", "exploit-in", "xss-is"]),
    ("t2", ["probiv", "darkforum", "altenens", "nulled", "leakforum", "mipped", "hard-tm",
            "dublikat", "leetforum", "in4", "ipbmafia"]),
    ("t3", ["card", "carding", "mmgp", "ezcarder"]),
    ("t-ransom", ["ransom", "ransomware"]),
    ("t-intel", ["hibp", "haveibeen", "ddosecret", "ransomfeed", "ransomwatch"]),
]
DEFAULT_SITE_BADGE = "t4"
SCORE_BADGES: list[tuple[int, str]] = [(9, "🔴"), (7, "🟠"), (5, "🟡")]
DEFAULT_SCORE_BADGE = "🔵"

# Characters escaped in rich text, and in link targets.
RICH_TEXT_RESERVED = "_*[]()~`>#+-=|{}.!"

# Substrings of links that are never downloads.
LINK_EXCLUDES: list[str] = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".bmp", "/login/", "/register/"]

# Feed paths tried below a base address, in this order.
FEED_PATHS: list[str] = [
    "/forums/-/index.rss",
    "/syndication.php?limit=50",
    "/syndication.php?fid=127&limit=50",
    "/syndication.php?fid=4&limit=50",
    "/external.php?type=RSS2",
    "/rss/1-temy.xml/",
    "/feed/",
    "/rss.xml",
    "/index.rss",
]
FEED_MARKERS: list[str] = ["<rss", "<feed", "<channel>", "<?xml"]
INTERNAL_SCHEME = "internal://"

# Label substrings that make an outline entry relevant.
OUTLINE_KEYWORDS: list[str] = [
    "breach", "data leak", "data breach", "leaked", "data dump",
    "darkweb", "dark web", "underground forum", "cybercrime",
    "ransomware", "infostealer", "stealer logs", "combo list",
    "credential", "combolist", "combo", "fullz", "doxxing",
    "haveibeenpwned", "paste", "pastebin",
]

# Link templates of the victim feeds and the category they carry.
VICTIMS_LIVE_LINK = "https://www.ransomware.live"
VICTIMS_LOOK_PREFIX = "https://www.ransomlook.io/group/"
VICTIMS_WATCH_PREFIX = "https://ransomwatch.telemetry.ltd/#/"
VICTIM_CATEGORY = "ransomware"

# Defaults of thresholds, ages and page sizes.
DEFAULT_NOTIFY_MIN_SCORE = 5
DEFAULT_DAILY_TOP_N = 20
DEFAULT_TZ_OFFSET_HOURS = 8
PAGE_DEFAULT_LIMIT = 50
PAGE_MAX_LIMIT = 200
PAGE_PREVIEW_CHARS = 300
TABLE_PREVIEW_CHARS = 64
TABLE_PAGE_ROWS = 50
MIN_SHARE_PERCENT = 1.5

# Embed colours by message kind.
COLOR_STARTUP = 0x57F287
COLOR_REPORT = 0x9C27B0
COLOR_URGENT = 0xED4245


@dataclass(frozen=True)
class RuleBook:
    """The keyword lists that drive triage and scoring. Lists replace the defaults
    as a whole; ``with_types`` merges data types by name."""

    skip_patterns: list[tuple[str, str]] = field(default_factory=lambda: list(SKIP_PATTERNS))
    named_targets: list[str] = field(default_factory=lambda: list(NAMED_TARGETS))
    vendor_patterns: list[str] = field(default_factory=lambda: list(VENDOR_PATTERNS))
    tier1_sites: list[str] = field(default_factory=lambda: list(TIER1_SITES))
    tier2_sites: list[str] = field(default_factory=lambda: list(TIER2_SITES))
    ransom_sites: list[str] = field(default_factory=lambda: list(RANSOM_SITES))
    fresh_positive: list[str] = field(default_factory=lambda: list(FRESH_POSITIVE))
    fresh_negative: list[str] = field(default_factory=lambda: list(FRESH_NEGATIVE))
    data_types: dict[str, list[str]] = field(default_factory=lambda: dict(DATA_TYPES))

    def with_types(self, extra: dict[str, list[str]]) -> "RuleBook":
        from dataclasses import replace

        return replace(self, data_types={**self.data_types, **extra})


DEFAULT_RULES = RuleBook()

# Explanations recorded with a triage decision or a rule score.
REASON_NAMED_TARGET = "named target detected"
REASON_DEFAULT = "passed default"
REASONING_FALLBACK = "all providers exhausted"
RULES_PROVIDER = "rules-engine"
FALLBACK_PROVIDER = "fallback"
