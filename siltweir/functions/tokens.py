"""Word lists, look-alike sequences and sets that the lexical columns are defined by."""

SUSPICIOUS = ("login", "signin", "verify", "secure", "account", "update", "confirm", "banking", "webscr", "password", "billing", "suspend", "urgent", "click", "免费", "free", "bonus", "wallet", "reset")
SUSPICIOUS_EXTENDED = SUSPICIOUS + ("refund", "kyc", "otp", "reward", "cashback", "suspended", "deactivate", "reactivate", "penalty", "overdue", "prize", "lottery", "blocked", "expire", "expired", "unblock")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorte.st", "tiny.cc", "t.ly", "shorturl.at", "rb.gy", "s.id", "short.io", "v.gd", "tiny.one", "lnkd.in", "amzn.to", "youtu.be", "soo.gg", "qr.ae", "adf.ly", "shorturl.com")
BRANDS = ("paypal", "apple", "amazon", "microsoft", "google", "facebook", "netflix", "bankofamerica", "chase", "wellsfargo", "instagram", "outlook", "dropbox")
BRANDS_EXTENDED = BRANDS + (
    "oracle", "adobe", "salesforce", "docusign", "slack", "zoom", "atlassian", "github", "gitlab", "onedrive", "icloud", "wetransfer", "mediafire", "godaddy", "namecheap", "cloudflare", "wix", "squarespace", "bluehost", "hostgator",
    "linkedin", "tiktok", "snapchat", "pinterest", "whatsapp", "telegram", "discord", "reddit", "yahoo",
    "venmo", "zelle", "cashapp", "stripe", "coinbase", "binance", "kraken", "robinhood", "schwab", "fidelity", "vanguard", "westernunion", "moneygram",
    "hsbc", "barclays", "santander", "citibank", "capitalone", "americanexpress", "natwest", "lloyds", "revolut", "monzo", "chime",
    "fedex", "usps", "dhl", "verizon", "tmobile", "comcast", "xfinity", "vodafone",
    "ebay", "alibaba", "aliexpress", "walmart", "costco", "bestbuy", "homedepot", "lowes", "ikea", "wayfair",
    "spotify", "hulu", "disneyplus", "twitch", "steam", "roblox", "epicgames", "playstation", "nintendo",
    "expedia", "airbnb", "booking", "americanairlines", "britishairways", "ryanair", "easyjet", "irs", "hmrc", "aetna", "cigna", "unitedhealth", "bluecross",
    "reservebank", "rbi", "sbi", "hdfc", "hdfcbank", "icici", "icicibank", "axisbank", "kotak", "pnb", "bankofbaroda", "canarabank", "unionbank", "idbi", "yesbank", "indusind", "paytm", "phonepe", "incometax", "epfo", "irctc", "indiapost", "uidai", "aadhaar", "incometaxindia", "epfindia",
)
ACRONYMS = ("rbi", "sbi", "pnb")
COMMON_TLDS = ("com", "org", "net", "edu", "gov", "io", "co")
#: Applied in this order before single characters.
LOOKALIKE_SEQUENCES = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"))
LOOKALIKE_FROM = "0123456789аеорсхуο"
LOOKALIKE_TO = "olzeasgtbgaeopcxyo"
#: Letters and the look-alikes an attacker swaps in.
HOMOGLYPH_FROM, HOMOGLYPH_TO = "aeopcils", "аеорсі1ѕ"
EVASION_BRANDS = ("paypal", "apple", "amazon", "microsoft", "google", "netflix")
EVASION_SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "is.gd", "ow.ly")
EVASION_LABELS = ("secure", "login", "account", "my", "portal", "www", "auth", "session")
EVASION_TLDS = {"com": ("co", "cm", "com.co", "cm.com"), "org": ("0rg", "org.com"), "net": ("ne.t", "net.co")}
#: Letters of other scripts, and wide ones, that look like an ASCII one.
CONFUSABLE_FROM = "аеорсхуіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαορυνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧօսո" + "".join(chr(0xFF01 + i) for i in range(94))
CONFUSABLE_TO = "aeopcxyijshdqwABEKMHOPCTYXIJSaopuviktABEZHIKMNOPTYXoun" + "".join(chr(0x21 + i) for i in range(94))
#: Columns that come from lookups or rankings, not from the address.
LOOKED_UP = ("domain_age_days", "whois_registration_date", "whois_expiry_date", "whois_registrar_country", "dns_a_record_count", "dns_mx_record_present", "dns_ns_record_count", "ssl_certificate_present", "ssl_certificate_issuer", "ssl_certificate_age_days", "shortener_expanded_target", "hosting_asn", "hosting_country", "tranco_rank", "alexa_rank", "pagerank_score", "search_engine_indexed")
