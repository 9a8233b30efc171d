"""What the message-risk engine is set to: one frozen object, no global mode."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They must be as they are for right results.
# ---------------------------------------------------------------------------

#: Characters and what they are normalised to, position by position.
NORMAL_FROM, NORMAL_TO = "@013$45vfj", "aoiesasbpg"

PREFIXES = ("nakaka", "pinaka", "magpa", "nag", "mag", "pag", "na", "ma", "pa", "ka", "in", "i")
SUFFIXES = ("han", "hin", "in", "an")

BOOSTERS = (
    "urgent", "click", "verify", "blocked", "login", "confirm",
    "suspend", "limited", "action", "immediately", "warning", "alert",
    "i-verify", "i-click", "na-block", "kumpirmahin", "agad",
    "panganib", "mag-login", "ibigay", "ipadala", "ipasok",
)
NEUTRALIZERS = (
    "official", "help", "customer", "support", "hotline",
    "representative", "authorized", "service", "policy",
    "advisory", "reminder", "notice", "maintenance", "legitimate",
    "transaction", "ignore", "never",
    "opisyal", "tulong", "serbisyo", "awtorisado", "lehitimo",
    "paalala", "babala", "abiso", "huwag", "wag", "pansin",
    "ingat", "transaksyon",
)

URGENCY_TERMS = ("urgent", "asap", "immediately", "deadline", "last chance", "act now", "expire", "expiring")
ACTION_TERMS = ("click", "tap", "verify", "confirm", "login", "sign in", "reset")
SENSITIVE_TERMS = ("password", "pin", "otp", "security code", "wallet", "bank account", "payment details", "transfer funds", "credentials", "credit card", "gift card")
BENIGN_TERMS = ("official", "help", "customer", "support", "hotline", "representative", "authorized", "service", "policy", "newsletter", "receipt", "invoice", "schedule", "meeting")

SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "ow.ly", "t.co", "rb.gy", "cutt.ly", "shorturl.at", "is.gd", "buff.ly", "bitly.com")
TRACKERS = ("viglink.com",)
LEGITIMATE = (
    "gcash.com", "maya.ph", "paymaya.com", "seabank.com.ph", "gotyme.com.ph",
    "bdo.com.ph", "bpi.com.ph", "unionbankph.com", "landbank.com", "metrobank.com.ph",
    "shopee.ph", "lazada.com.ph", "grab.com", "viber.com", "telegram.org",
    "paypal.com", "amazon.com", "whatsapp.com", "paypal.me", "lazada.com",
)
#: Domains whose bare links a page scan skips.
TRUSTED_PAGES = (
    "bpi.com.ph", "gcash.com", "maya.ph", "paymaya.com", "seabank.com.ph", "gotyme.com.ph",
    "bdo.com.ph", "unionbankph.com", "landbank.com", "metrobank.com.ph", "securitybank.com",
    "rcbc.com", "pnb.com.ph", "chinabank.ph", "psbank.com.ph", "psbankonline.com.ph",
    "cimbbank.com.ph", "shopee.ph", "lazada.com.ph", "globe.com.ph", "smart.com.ph", "telegram.org",
)

MULTIPLIERS = {"shortener": 2.5, "subdomain": 2.0, "path": 1.5, "query": 1.5, "lookalike": 2.0, "sld": 1.0, "whitelisted": 1.0, "none": 1.0}
RISKY_SEGMENTS = ("shortener", "subdomain", "path", "query", "lookalike")

#: Category of a pattern -> evidence group; the second five are those of the test dictionary.
EVIDENCE_OF_CATEGORY = {
    "brand_terms": "brand_entity",
    "financial_terms": "credential_payment",
    "action_terms": "action_request",
    "security_and_status_terms": "urgency_threat",
    "social_engineering_terms": "urgency_threat",
    "brand": "brand_entity",
    "money": "credential_payment",
    "deed": "action_request",
    "state": "urgency_threat",
    "lure": "urgency_threat",
}
EVIDENCE_OF_SIGNAL = {
    "urgency language": "urgency_threat",
    "action request": "action_request",
    "credential or payment language": "credential_payment",
    "obfuscated spelling": "obfuscation",
}
REASONS = {
    "brand_entity": "Financial or brand mention",
    "credential_payment": "Account or credential prompt",
    "action_request": "Action requested",
    "urgency_threat": "Urgent or threatening language",
    "url_risk": "Suspicious link detected",
    "obfuscation": "Obfuscated / disguised keywords",
}

DEFAULT_DICTIONARY = {
    "brand_terms": [
        "gcash", "maya", "paymaya", "paypal", "bdo", "bpi", "unionbank", "landbank", "metrobank", "seabank", "gotyme", "shopee", "lazada",
        "amazon", "grab", "bank", "viber", "telegram", "whatsapp",
    ],
    "action_terms": [
        "verify", "click here", "click", "login", "sign in", "register", "link", "update", "update payment", "confirm", "confirm identity",
        "activate", "reactivate", "restore", "unlock", "claim", "claim prize", "tap", "download", "urgent action", "buksan", "pindutin",
        "i-click", "i-verify", "i-update", "mag-login", "kumpirmahin", "paki-verify", "mag-update",
    ],
    "security_and_status_terms": [
        "blocked", "suspended", "account suspended", "deactivated", "restricted", "limited", "locked", "warning", "alert", "urgent",
        "expired", "hold", "disabled", "panganib", "na-block", "na-suspend", "na-hold",
    ],
    "financial_terms": [
        "account", "bitcoin", "wallet", "password", "otp", "pin", "balance", "bank account", "transfer", "credit card", "fund", "refund",
        "payout", "cash", "pera", "salapi", "bayad", "pautang", "utang", "loan", "billing", "invoice", "payment", "fee",
    ],
    "social_engineering_terms": [
        "covid", "relief", "lottery", "winner", "congratulations", "prize", "raffle", "jackpot", "ayuda", "libre", "premyo", "panalo",
        "free load", "bonus", "commission", "reward", "task", "part-time", "hiring", "job offer", "wfh", "sim registration", "sim card",
    ],
}

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and lists of one engine; made anew to change one."""

    max_errors: int = 1
    exact_threshold: float = 1.2
    fuzzy_threshold: float = 1.2
    affix_threshold: float = 1.05
    anomaly_threshold: float = 0.45
    warning_threshold: float = 1.142
    min_evidence: int = 0
    cutoffs: tuple[float, float, float] = (1.142, 1.5, 2.5)
    window: int = 50
    flag_lookalikes: bool = True
    max_lookups: int = 3
    shorteners: tuple[str, ...] = SHORTENERS
    legitimate: tuple[str, ...] = LEGITIMATE
    brand_category: tuple[str, ...] = ("brand_terms", "brand")
    generic_brands: tuple[str, ...] = ("bank",)
    lookalike_chars: int = 5
    #: (category, pattern) in order; the place in it is the pattern's index.
    dictionary: tuple[tuple[str, str], ...] = field(default=tuple((c, p) for c, ps in DEFAULT_DICTIONARY.items() for p in ps))

    def norm(self, text: str) -> str:
        return text.lower().translate(str.maketrans(NORMAL_FROM, NORMAL_TO))

    @property
    def norms(self) -> list[str]:
        return [self.norm(p) for _, p in self.dictionary]

    @property
    def groups(self) -> list[str | None]:
        """Evidence group of each pattern; a pattern in two categories has that of the later."""
        last = {p: EVIDENCE_OF_CATEGORY[c] for c, p in self.dictionary if c in EVIDENCE_OF_CATEGORY}
        return [last.get(p) for _, p in self.dictionary]
