"""Word lists and patterns of the fraud and distress rules.

Everything in this module is a fixed value: results only agree with the published rules when
these terms are used as they are, in this order. Terms are plain lower-case substrings,
patterns are regular expressions.
"""

# --- fraud rules: substring terms -------------------------------------------------------

# "cash flip" is listed twice on purpose: it counts as two hits.
SCAM_KEYWORDS = (
    "giving away", "giveaway", "no cost", "won", "winner", "claim your", "congratulations you",
    "send me a dm", "dm me",
    "whatsapp", "telegram", "signal", "kik", "snapchat",
    "gift card", "wire transfer", "western union", "moneygram", "crypto", "bitcoin", "eth", "usdt",
    "cashapp", "cash app", "venmo", "zelle", "cash flip",
    "verify your account", "reset your password",
    "act fast", "limited time offer",
    "easy money", "forex", "guaranteed returns", "cash flip",
    "sugar daddy", "sugar baby", "orphanage",
)
BAIT_TERMS = ("giving away", "giveaway", "won", "winner", "claim your")
OFF_PLATFORM_TERMS = (
    "send me a dm", "dm me", "whatsapp", "telegram", "signal", "kik", "snapchat",
)
PREDATORY_TERMS = ("sugar daddy", "sugar baby", "orphanage")
PAYMENT_TERMS = (
    "gift card", "wire", "western union", "moneygram", "crypto", "bitcoin", "eth", "usdt",
    "cashapp", "cash app", "venmo", "zelle", "paypal", "apple pay", "google pay", "cash flip",
)
URGENCY_TERMS = (
    "act fast", "limited time", "urgent", "hurry", "time sensitive", "asap", "quickly",
    "don't miss out", "offer expires", "today only", "immediately", "now", "immediately asap",
    "right now",
)
INVESTMENT_TERMS = (
    "guaranteed returns", "easy money", "passive income", "guaranteed profit", "forex", "trading",
    "returns", "investment opportunity", "roi", "doubled", "triple",
)
JOB_TERMS = (
    "make money fast", "earn $", "quick cash", "guarantees", "pay upfront", "upfront deposit",
    "upfront payment to start", "online assessor for money", "remote work guaranteed income",
    "daily guaranteed pay",
)
SMISHING_TERMS = (
    "delivery fee", "delivery issue", "package on hold", "redelivery", "track your package",
    "reward points", "traffic violation", "toll violation", "tax refund", "hearing notice",
)
LOAN_TERMS = (
    "loan application", "loan request", "preapproved", "pre-approved", "claim the loan",
    "finish your application",
)
ENGAGEMENT_TERMS = (
    "reply yes now", "reply yes to claim", "confirm now to unlock", "click yes to win",
)
TASK_TERMS = (
    "optimization", "optimizing", "combo task", "combo tasks", "rate products", "simple clicks",
    "unlock earnings", "task platform",
)
IMPERSONATION_TERMS = (
    "urgent favor", "your boss", "safe account", "protect your money", "move your money",
    "buy gold", "gift card numbers", "pin on the back", "fraud department", "benefits team",
    "google certificates", "do not call",
)
PRIZE_FEE_TERMS = (
    "processing fee", "shipping fee", "pay the taxes", "claim your prize", "handling charges",
)
PII_TERMS = (
    "social security", "ssn", "bank account", "banking details", "routing number",
    "verification code", "login details",
)
DEBT_RELIEF_TERMS = (
    "debt relief", "erase your debt", "enrollment fee", "balances will disappear",
)
BENEFIT_TERMS = (
    "claim your tax refund now", "unclaimed benefits claim", "federal mortgage relief",
    "government va payment pending",
)
AWARENESS_TERMS = (
    "official app", "official site", "official website", "not random texts", "is this a scam",
    "scam alert", "do not click", "don't click", "beware", "warning",
)
LOTTERY_TERMS = (
    "congratulations", "you won", "claim your prize", "you've won", "congratulations you",
    "tap to claim", "tap here", "free prize", "prize winner", "lucky winner",
)
PHISHING_TERMS = (
    "verify account", "verify your account", "update payment", "confirm identity",
    "unusual activity detected", "suspicious activity", "click here immediately", "click link",
    "click this link", "unusual access",
)
SMS_SPAM_TERMS = (
    "message status", "package delivery", "delivery status", "activate now", "click link",
    "confirm delivery", "limited time", "offer expires", "exclusive offer", "tap link",
)
FINANCIAL_SPAM_TERMS = (
    "free money", "easy cash", "passive income", "guaranteed returns", "make money fast",
    "earn $", "click to earn", "money waiting",
)
SEND_TERMS = ("send", "transfer", "pay", "wire", "send me", "upfront")
PIN_TERMS = (" pin", "pins", "numbers on the back")

# --- fraud rules: patterns (matched without regard to case) ------------------------------

SHORTLINK = r"\b(bit\.ly|t\.co|tinyurl\.com|goo\.gl|ow\.ly|is\.gd|buff\.ly|rebrand\.ly)\b"
URL = r"\bhttps?://\S+\b"
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:(?:\+?1\s*[-.(]?)?\s*\d{3}\s*[-.)]?\s*\d{3}\s*[-.]?\s*\d{4})"
SMS_ACTION = r"\b(txt|text|reply|call|stop|optout|opt\s*out)\b"
SMS_PROMO = r"\b(win|won|winner|prize|claim|ringtone|tones|cash)\b"
SMS_FREE = r"\bfree\b"
SHORTCODE = r"(?<!\d)\d{5}(?!\d)"
SHORTCODE_ACTION = r"\b(txt|text|reply|call|stop|optout|opt\s*out|send)\b"
SHORTCODE_PROMO = (
    r"\b(win|won|winner|prize|claim|free|discount|voucher|tone|tones|video|chat|draw|cash)\b"
)
ACCOUNT_PHRASE = (
    r"\b(unauthorized access|failed login|verify your account|security notification"
    r"|internet banking|account (?:locked|suspended)|confirm identity)\b"
)
ACCOUNT_CONTEXT = r"\b(bank|account|login|password|security|member)\b"

# --- context gates ----------------------------------------------------------------------

PEER_SUPPORT = (
    r"\bi (?:can )?help with", r"\bi mentor", r"\bi assist", r"\bi offer guidance",
    r"i (?:volunteer|volunteer to help|provide support)", r"\bi have experience with",
    r"\bi (?:trained|specialize|focus) in",
)
PEER_BLOCKERS = ("gift card", "send me dm", "dm me", "whatsapp", "telegram")
BUSINESS_SIGNALS = (
    ("service offering",
     r"(i (?:offer|provide|sell|offer to)\s+(?:sell|provide|offer|make|create|design|build)\b)"),
    ("concrete description", r"((?:handmade|custom|vintage|professional|licensed|insured)\b)"),
    ("pricing transparency", r"(\$\d+|cost.*\d+|price.*\d+|fee.*\d+)"),
    ("contact methods", r"((?:email|phone|website|facebook|etsy|shopify)\b)"),
)
BUSINESS_BLOCKERS = ("send me dm", "dm me", "whatsapp", "telegram", "signal")
AWARENESS_TALK = (
    r"\b(?:is this a scam\?|warning|don't click|do not click|beware|scam alert|be careful"
    r"|watch out|this is a scam|fake)\b",
    r"\b(?:is it legit|how to spot|red flags|seems suspicious|sounds like scam)\b",
)
AWARENESS_BLOCKERS = ("gift card", "send me dm", "dm me", "upfront payment")

# --- distress rules: patterns on normalized text -----------------------------------------

RARE_HINTS = {
    "grief": (r"\bpassed away\b", r"\bfuneral\b", r"\bmourning\b", r"\bwidow(?:ed)?\b",
              r"\bloss of\b", r"\bgrieving\b"),
    "relief": (r"\bso relieved\b", r"\bwhat a relief\b", r"\bfinally approved\b",
               r"\bfinally resolved\b", r"\bthank god\b"),
    "pride": (r"\bproud of\b", r"\bgraduated\b", r"\bpromotion\b", r"\bachievement\b",
              r"\baccomplished\b"),
    "fear": (r"\bafraid\b", r"\bterrified\b", r"\bscared\b", r"\bunsafe\b", r"\bin danger\b"),
    "remorse": (r"\bi regret\b", r"\bshouldn't have\b", r"\bwish i had not\b", r"\bmy fault\b"),
    "nervousness": (r"\bnervous\b", r"\banxious\b", r"\bpanic\b", r"\bworried\b",
                    r"\bstressed\b"),
    "realization": (r"\bi realized\b", r"\bit dawned on me\b", r"\bnow i know\b",
                    r"\bturns out\b"),
}
CONFLICT = (
    r"\bneed help\b", r"\bstruggling\b", r"\bworried\b", r"\bstressed\b", r"\boverwhelmed\b",
    r"\bcan't afford\b", r"\bunsafe\b", r"\bissue\b", r"\bproblem\b", r"\bfrustrat",
    r"\bconfused\b", r"\blooking for advice\b", r"\bany recommendations\b",
    r"\bcan anyone help\b", r"\bi need\b", r"\bhelp me\b", r"\bnot sure\b", r"\bdifficult\b",
    r"\bhard time\b",
)
SUPPORT_NEED = (
    r"\bneed help\b", r"\bcan anyone help\b", r"\bcan you help\b", r"\bplease help\b",
    r"\blooking for advice\b", r"\bneed support\b", r"\bneed resources\b",
    r"\bnot sure what to do\b", r"\bnot sure where to turn\b", r"\bany suggestions\b",
    r"\bany recommendations\b", r"\brecommend\b", r"\bdoes anyone know\b",
    r"\bstruggling\b", r"\boverwhelmed\b", r"\bstruggle\b", r"\bdifficult\b", r"\bhard time\b",
    r"\bworried\b", r"\banxious\b", r"\bstressed\b", r"\bstress\b", r"\bdoing okay\b",
    r"\bhold up\b", r"\bkeep going\b", r"\bsurviv\b", r"\bfalling apart\b",
    r"\bunsafe\b", r"\bsafe\b", r"\bdanger\b", r"\bhomeless\b", r"\bdisabled\b",
    r"\bautistic\b", r"\bneurodiverse\b", r"\bifmp\b", r"\befmp\b", r"\bveteran benefit\b",
    r"\bcan't afford\b", r"\bcannot afford\b", r"\bbehind on bills\b", r"\bbroke\b",
    r"\bfinancial hardship\b", r"\bpay\b", r"\bloan\b", r"\bdeb\b",
    r"\bhousing\b", r"\brent\b", r"\beviction\b", r"\bfood insecurity\b", r"\bfood bank\b",
    r"\bchildcare\b", r"\bdaycare\b", r"\bafford child\b",
    r"\bjob\b", r"\bunemploy", r"\bwork\b", r"\bcareer\b", r"\bopportunity\b",
    r"\bmental health\b", r"\btherapy\b", r"\bdepressed\b", r"\bdepression\b",
    r"\bburned out\b", r"\bburnt out\b", r"\bpanic\b", r"\banxiety attack\b",
    r"\bgrieving\b", r"\bgrief\b", r"\bgone\b",
    r"\bpassed away\b", r"\bfuneral\b", r"\blost my\b", r"\bwidow(?:ed)?\b", r"\bloss\b",
    r"\bdeployment\b", r"\bpcs\b", r"\brelocation\b", r"\bfamily strain\b",
    r"\bmarital strain\b", r"\bseparation\b", r"\bdisconnected\b", r"\biso(?:late)?d\b",
    r"\bjob loss\b", r"\blayoff\b", r"\blaid off\b", r"\bbeen tough\b",
    r"\bit'?s been tough\b", r"\bcaregiver\b", r"\bcaretaker\b", r"\btough time\b",
    r"\bhard times\b", r"\bmaking ends meet\b", r"\bnot making ends\b", r"\bstretched thin\b",
)

# Matched on the lower-cased raw text, not on the normalized text.
HARDSHIP_PHRASES = (
    r"i'?m homeless", r"i'?m disabled", r"can you help me", r"can y'?all help", r"i need help",
    r"we'?re struggling", r"my child is autistic", r"is anyone there", r"anyone[,\s]+please",
    r"really need",
)
HARDSHIP_CONTEXT = (
    r"\bjob loss\b", r"\blaid off\b", r"\blayoff\b", r"\bcaregiver\b", r"\bcaretaker\b",
    r"\bbeen tough\b", r"\btough time\b", r"\bhard times\b", r"\bmaking ends meet\b",
    r"\bfood insecurity\b", r"\bhomeless\b", r"\bdisabled\b", r"\beviction\b",
    r"\bbehind on bills\b", r"\bfinancial hardship\b", r"\bwidow\b",
)
SHORT_TEXT_SIGNAL = (
    r"\b(help|need|lost|stressed|worried|scared|thanks|thank you|sorry|urgent)\b"
)

# --- identity ---------------------------------------------------------------------------

NULL_LIKE = ("nan", "none", "null", "nat")
STAFF_NAME_TOKENS = ("admin", "administrator", "moderator")

# --- sampling plan and external label maps -------------------------------------------------

SAMPLING_PLAN = (
    ("rare_focus", 0.30),
    ("uncertain", 0.25),
    ("false_positive_suspect", 0.20),
    ("neutral_baseline", 0.15),
    ("random_baseline", 0.10),
)
DIALOGUE_LABEL_MAP = {
    "afraid": {"fear": 1.0},
    "angry": {"anger": 1.0},
    "annoyed": {"annoyance": 1.0},
    "anticipating": {"optimism": 0.8, "curiosity": 0.4},
    "anxious": {"nervousness": 1.0},
    "apprehensive": {"nervousness": 0.9, "fear": 0.5},
    "ashamed": {"embarrassment": 0.8, "remorse": 0.6},
    "caring": {"caring": 1.0},
    "confident": {"optimism": 0.6, "pride": 0.6},
    "content": {"joy": 0.6, "relief": 0.4},
    "devastated": {"grief": 0.7, "sadness": 1.0},
    "disappointed": {"disappointment": 1.0},
    "disgusted": {"disgust": 1.0},
    "embarrassed": {"embarrassment": 1.0},
    "excited": {"excitement": 1.0},
    "faithful": {"love": 0.4, "approval": 0.4},
    "furious": {"anger": 1.0},
    "grateful": {"gratitude": 1.0},
    "guilty": {"remorse": 1.0},
    "hopeful": {"optimism": 1.0},
    "impressed": {"admiration": 0.8, "approval": 0.4},
    "jealous": {"disapproval": 0.4, "annoyance": 0.3},
    "joyful": {"joy": 1.0},
    "lonely": {"sadness": 0.8, "grief": 0.3},
    "nostalgic": {"realization": 0.4, "sadness": 0.3, "joy": 0.3},
    "prepared": {"optimism": 0.4},
    "proud": {"pride": 1.0},
    "sad": {"sadness": 1.0},
    "sentimental": {"love": 0.4, "sadness": 0.4, "grief": 0.2},
    "surprised": {"surprise": 1.0},
    "terrified": {"fear": 1.0},
    "trusting": {"approval": 0.5, "caring": 0.3},
}
REPORT_LABEL_MAP = {
    "joy": {"joy": 1.0},
    "fear": {"fear": 1.0},
    "anger": {"anger": 1.0},
    "sadness": {"sadness": 1.0},
    "disgust": {"disgust": 1.0},
    "shame": {"embarrassment": 0.8, "remorse": 0.4},
    "guilt": {"remorse": 1.0},
}
REPORT_LABEL_CODES = {
    1: "joy", 2: "fear", 3: "anger", 4: "sadness", 5: "disgust", 6: "shame", 7: "guilt",
}
SOURCE_WEIGHTS = {
    "go_emotions_rare": 0.55,
    "empathetic_dialogues_contexts": 0.70,
    "isear": 0.75,
    "counsel_chat_teacher": 0.55,
}
