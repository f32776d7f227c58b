"""Emotion labels, label groups and score thresholds."""

# The 28 labels, in score-vector order. The first twelve are the negative ones.
LABELS = (
    "sadness", "anger", "disgust", "fear", "annoyance", "disappointment", "disapproval", "grief",
    "embarrassment", "confusion", "nervousness", "remorse", "neutral", "joy", "love", "optimism",
    "admiration", "gratitude", "approval", "amusement", "excitement", "pride", "relief", "caring",
    "desire", "curiosity", "surprise", "realization",
)
NEGATIVE = LABELS[:12]
POSITIVE = LABELS[13:]

# Label groups, each in its own order (order breaks ties).
SERIOUS = (
    "sadness", "anger", "fear", "grief", "remorse", "nervousness", "embarrassment",
    "disappointment", "disapproval",
)
RARE = ("grief", "relief", "pride", "fear", "remorse", "nervousness", "realization")
UPBEAT = ("gratitude", "caring", "approval", "excitement", "admiration", "optimism")
SEVERE_SUM = (
    "sadness", "fear", "grief", "remorse", "nervousness", "embarrassment", "disappointment",
)
SUPPORT_CONTEXT = ("sadness", "fear", "nervousness", "disappointment", "confusion")
WATCHLIST = (
    "grief", "fear", "sadness", "remorse", "nervousness", "embarrassment", "disappointment",
    "relief",
)
RARE_SUPPLEMENT = (
    "grief", "remorse", "relief", "pride", "fear", "nervousness", "realization",
)

# Default decision threshold per label.
DEFAULT_THRESHOLDS = {
    "admiration": 0.25, "amusement": 0.45, "anger": 0.15, "annoyance": 0.10, "approval": 0.30,
    "caring": 0.40, "confusion": 0.55, "curiosity": 0.25, "desire": 0.25, "disappointment": 0.40,
    "disapproval": 0.30, "disgust": 0.20, "embarrassment": 0.10, "excitement": 0.35, "fear": 0.40,
    "gratitude": 0.45, "grief": 0.05, "joy": 0.40, "love": 0.25, "nervousness": 0.25,
    "optimism": 0.20, "pride": 0.10, "realization": 0.15, "relief": 0.05, "remorse": 0.10,
    "sadness": 0.40, "surprise": 0.15, "neutral": 0.25,
}

# Review-band thresholds and guardrails of the severe rules.
REVIEW_BANDS = {"grief": 0.05, "fear": 0.20, "remorse": 0.10, "nervousness": 0.15}
COMPONENT_FLOOR = 0.10
SEVERE_SUM_GUARDRAIL = 0.55
SEVERE_SPIKE_GUARDRAIL = 0.40

# The constant score vector used when no scorer is available.
BASELINE_SCORES = {"neutral": 0.85, "curiosity": 0.08, "approval": 0.05}
