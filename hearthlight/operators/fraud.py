"""Fraud cascade: phrase scoring, severity, context gates, verdict routing, review severity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight import rules as R
from hearthlight.functions import matching as M
from hearthlight.functions import text, verdicts
from hearthlight.operators.barrier import evaluate_once
from hearthlight.operators.texts import KEY

_SHORTLINK_HOSTS = (
    "bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly",
)
_ACCOUNT_STARTS = (
    "unauthorized access", "failed login", "verify your account", "security notification",
    "internet banking", "account locked", "account suspended", "confirm identity",
)
# A number's optional country code decides nothing about whether there is one.
_PHONE_CORE = R.PHONE.removeprefix(r"(?:(?:\+?1\s*[-.(]?)?\s*").removesuffix(")")
# What a text must contain for the patterns of a gate to match; they run only where it does.
_GATE_WORDS = {
    "peer": ("i help with", "i can help with", "i mentor", "i assist", "i offer guidance", "i volunteer",
             "i provide support", "i have experience with", "i trained", "i specialize", "i focus"),
    "service offering": ("i offer", "i provide", "i sell"),
    "concrete description": ("handmade", "custom", "vintage", "professional", "licensed", "insured"),
    "pricing transparency": ("$", "cost", "price", "fee"),
    "contact methods": ("email", "phone", "website", "facebook", "etsy", "shopify"),
    "awareness": tuple(word for talk in R.AWARENESS_TALK for word in M.alternatives(talk)),
}
_GATE_TERMS = tuple(dict.fromkeys([
    *R.PEER_BLOCKERS, *R.BUSINESS_BLOCKERS, *R.AWARENESS_BLOCKERS,
    *(word for words in _GATE_WORDS.values() for word in words),
]))
_GROUPS = {
    "urgency": R.URGENCY_TERMS, "investment": R.INVESTMENT_TERMS, "job": R.JOB_TERMS,
    "smishing": R.SMISHING_TERMS, "loan": R.LOAN_TERMS, "engagement": R.ENGAGEMENT_TERMS,
    "task": R.TASK_TERMS, "impersonation": R.IMPERSONATION_TERMS,
    "prize_fee": R.PRIZE_FEE_TERMS, "pii": R.PII_TERMS, "debt_relief": R.DEBT_RELIEF_TERMS,
    "benefit": R.BENEFIT_TERMS, "awareness": R.AWARENESS_TERMS, "prize": R.LOTTERY_TERMS,
    "phishing": R.PHISHING_TERMS, "sms_spam": R.SMS_SPAM_TERMS,
    "financial": R.FINANCIAL_SPAM_TERMS, "send": R.SEND_TERMS, "bait": R.BAIT_TERMS,
    "off": R.OFF_PLATFORM_TERMS, "predatory": R.PREDATORY_TERMS,
    "gift_card": ("gift card",), "gold": ("gold",), "withdraw": ("withdraw cash",),
    "lottery": ("lottery",),
}
SCAN_TERMS = tuple(dict.fromkeys([
    *R.SCAM_KEYWORDS, *R.PAYMENT_TERMS, *R.PIN_TERMS, *_SHORTLINK_HOSTS, *_ACCOUNT_STARTS,
    *(term for terms in _GROUPS.values() for term in terms),
]))


def payment_term(term: str, low: Column, hits: Column) -> Column:
    """Short alphabetic terms must stand alone; longer ones may be part of a word."""
    found = M.in_hits(hits, term)
    if term.isalpha() and len(term) <= 4:
        return found & low.rlike(f"(?={term})(?<![a-z0-9]){term}(?![a-z0-9])")
    return found


def _signals(raw: Column, low: Column, hits: Column, digits: Column) -> dict[str, Column]:
    """All text tests of the heuristic; pattern tests run only where a cheap test allows."""
    out = {name: M.any_in_hits(hits, terms) for name, terms in _GROUPS.items()}
    email = F.contains(raw, F.lit("@")) & raw.rlike(M.pattern(R.EMAIL, True))
    phone = digits & raw.rlike(M.pattern(_PHONE_CORE))
    url = F.contains(low, F.lit("://")) & raw.rlike(M.pattern(R.URL, True))
    shortlink = M.any_in_hits(hits, _SHORTLINK_HOSTS) & raw.rlike(M.pattern(R.SHORTLINK, True))
    promo = low.rlike(M.pattern(M.letters_first(R.SMS_PROMO))) | (
        low.rlike(M.pattern(M.start_first(R.SMS_FREE))) & (url | shortlink))
    out |= {
        "email": email, "phone": phone, "url": url, "shortlink": shortlink,
        "keyword_hits": M.count_in_hits(hits, R.SCAM_KEYWORDS),
        "payment_count": reduce(
            lambda a, b: a + b, [payment_term(t, low, hits).cast("int") for t in R.PAYMENT_TERMS]
        ),
        "pin": M.any_in_hits(hits, R.PIN_TERMS) | F.startswith(low, F.lit("pin")),
        "phone_promo": phone & low.rlike(M.pattern(M.letters_first(R.SMS_ACTION))) & promo,
        "shortcode_promo": digits & low.rlike(M.pattern(r"(?=\d)" + R.SHORTCODE))
        & low.rlike(M.pattern(M.letters_first(R.SHORTCODE_ACTION)))
        & low.rlike(M.pattern(M.letters_first(R.SHORTCODE_PROMO))),
        "account_phish": M.any_in_hits(hits, _ACCOUNT_STARTS)
        & low.rlike(M.pattern(M.letters_first(R.ACCOUNT_PHRASE)))
        & (F.regexp_count(low, F.lit(M.pattern(M.letters_first(R.ACCOUNT_CONTEXT)))) >= 2),
    }
    return out


def _points(points: int, condition: Column) -> Column:
    return F.when(condition, points).otherwise(0)


def _score(s) -> Column:
    """Score from the signals; ``s(name)`` gives a signal column."""
    pay, link = s("payment_count") >= 1, s("url") | s("shortlink")
    off, urgent = s("off"), s("urgency")
    terms = [
        _points(2, s("email")), _points(2, s("phone")), _points(4, s("shortlink")),
        _points(1, s("url")), F.least(F.lit(6), s("keyword_hits")),
        _points(4, s("bait") & off), _points(3, pay & off), _points(2, s("payment_count") >= 2),
        _points(4, s("predatory") & off), _points(4, s("predatory") & pay),
        _points(3, urgent & pay),
        F.when(s("investment") & (pay | off), 5).when(s("investment") & urgent, 2).otherwise(0),
        F.when(s("job") & pay & urgent, 5).when(s("job") & pay, 2).otherwise(0),
        _points(3, s("send") & pay),
        _points(4, s("smishing") & link), _points(2, s("smishing") & urgent),
        _points(4, s("loan") & pay), _points(4, s("loan") & (s("engagement") | s("pii"))),
        _points(5, s("task") & (pay | off)),
        F.when(s("job") & off & (s("engagement") | urgent), 3).when(s("job") & off, 2).otherwise(0),
        _points(5, s("impersonation") & s("gift_card")),
        _points(5, s("impersonation") & (pay | s("pii") | s("gold") | s("withdraw"))),
        _points(5, s("impersonation") & s("pin")),
        _points(5, s("prize_fee")), _points(5, s("debt_relief")),
        _points(5, s("benefit") & (s("pii") | s("send") | off)),
        _points(5, s("prize") & link), _points(3, s("prize") & urgent),
        _points(4, s("phishing") & link), _points(4, s("phishing") & s("pii")),
        _points(3, s("sms_spam") & link), _points(2, s("sms_spam") & urgent),
        _points(4, s("financial") & (link | pay)),
        _points(4, s("phone_promo")), _points(5, s("shortcode_promo")),
        _points(5, s("account_phish")), _points(3, s("lottery") & s("email")),
        _points(-3, s("awareness") & ~off & ~pay),
    ]
    return F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0))


def scan(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``heuristic_score`` INT and ``matched_terms`` ARRAY<STRING>.

    Rows that carry both are not scanned again, so one scan can serve several rules.
    """
    if {"heuristic_score", "matched_terms"} <= set(df.columns):
        return df
    return _scan(df, content).drop("_low", "_hits")


def _with_hits(df: DataFrame, content: str) -> DataFrame:
    """Adds the lower-cased text and the terms of scan and gates that occur in it: one pass finds both."""
    staged = evaluate_once(df, {"_low": F.lower(F.coalesce(F.col(content), F.lit("")))})
    return M.with_hit_list(staged, "_low", (*SCAN_TERMS, *_GATE_TERMS), "_hits")


def _scan(df: DataFrame, content: str) -> DataFrame:
    """``scan``, with the columns of ``_with_hits``."""
    raw = F.coalesce(F.col(content), F.lit(""))
    staged = _with_hits(df, content)
    staged = evaluate_once(staged, {"_digits": F.col("_low").rlike(M.pattern(r"\d{3}"))})
    signals = _signals(raw, F.col("_low"), F.col("_hits"), F.col("_digits"))
    staged = evaluate_once(staged, {"_s": F.struct(*[v.alias(k) for k, v in signals.items()])})

    def s(name: str) -> Column:
        return F.col("_s")[name]

    shown = [
        F.when(M.in_hits(F.col("_hits"), t), F.lit(t)) for t in dict.fromkeys(R.SCAM_KEYWORDS)
    ]
    shown += [
        F.when(s("email"), "email_address"), F.when(s("phone"), "phone_number"),
        F.when(s("url"), "url"), F.when(s("shortlink"), "shortlink"),
    ]
    scored = evaluate_once(
        staged, {"heuristic_score": _score(s), "matched_terms": M.compact(shown)}
    )
    return scored.drop("_digits", "_s")


def screen(df: DataFrame, content: str = "content") -> DataFrame:
    """All that the cascade reads from a text alone: ``scan``, the contact address and, where the text can
    escalate, what ``context_gates`` looks at. Rows that carry it need no text in the cascade."""
    known = {"heuristic_score", "matched_terms"} <= set(df.columns)
    scanned = _with_hits(df, content) if known else _scan(df, content)
    escalates = severity().isNotNull()
    return evaluate_once(scanned, {
        "detected_contact_email": text.contact_email(content),
        **{name: F.when(escalates, found) for name, found in _gate_signals().items()},
    }).drop("_low", "_hits")


def has_shortlink(matched: str = "matched_terms") -> Column:
    return F.array_contains(matched, "shortlink")


def benchmark_escalates(points: str = "heuristic_score") -> Column:
    """Rule of the labelled benchmark: 10 points, or a shortlink."""
    return (F.col(points) >= 10) | has_shortlink()


def severity(points: str = "heuristic_score") -> Column:
    """Production severity; null means no escalation."""
    value = F.col(points)
    return (
        F.when(has_shortlink() | (value >= 15), "HIGH")
        .when(value >= 8, "MEDIUM")
        .when(value >= 5, "LOW")
    )


@dataclass(frozen=True)
class StaffPolicy:
    """The organisation's own e-mail domains and name tokens."""

    domains: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ()

    def matches(self, name: str = "commenter_name", email: str = "commenter_email") -> Column:
        return text.is_staff(name, email, self.domains, self.tokens)


def drop_staff(df: DataFrame, staff: StaffPolicy = StaffPolicy(),
               include_trusted_users: bool = False) -> DataFrame:
    return df if include_trusted_users else df.filter(~staff.matches())


def candidates(df: DataFrame, staff: StaffPolicy = StaffPolicy(),
               include_trusted_users: bool = False) -> DataFrame:
    """Rows the heuristic escalates, with identity fields made displayable.

    Rows that were screened may come without ``content``; then ``comment`` is left out.
    """
    scanned = scan(drop_staff(df, staff, include_trusted_users))
    rows = scanned.withColumn("severity_level", severity()).filter("severity_level IS NOT NULL")
    week = (
        text.normalize_identity("scam_scan_week", "Selected week")
        if "scam_scan_week" in df.columns else F.lit("Selected week")
    )
    carried = [c for c in (KEY, *_GATE_SIGNALS) if c in rows.columns]
    return rows.select(
        "interaction_id", *carried,
        *([F.coalesce("content", F.lit("")).alias("comment")] if "content" in rows.columns else []),
        week.alias("scan_week"),
        text.normalize_identity("community_name").alias("community_name"),
        text.normalize_identity("commenter_name", "Unknown").alias("commenter_name"),
        text.normalize_identity("commenter_email").alias("commenter_email"),
        "detected_contact_email" if "detected_contact_email" in rows.columns
        else text.contact_email("content").alias("detected_contact_email"),
        "heuristic_score", "matched_terms", "severity_level",
    )


_GATE_SIGNALS = ("_peer", "_signals", "_routing", "_aware")


def _gate_signals() -> dict[str, Column]:
    """Of texts with the columns of ``_with_hits``. Nearly all patterns are ruled out by the terms that occur."""
    low, hits = F.col("_low"), F.col("_hits")

    def may(gate: str) -> Column:
        return M.any_in_hits(hits, _GATE_WORDS[gate])

    signals = [
        F.when(may(name) & low.rlike("(?Ud)" + expr), F.lit(name)) for name, expr in R.BUSINESS_SIGNALS
    ]
    return dict(zip(_GATE_SIGNALS, (
        may("peer") & ~M.any_in_hits(hits, R.PEER_BLOCKERS) & M.any_pattern(low, R.PEER_SUPPORT, "i "),
        M.compact(signals),
        M.any_in_hits(hits, R.BUSINESS_BLOCKERS),
        may("awareness") & ~M.any_in_hits(hits, R.AWARENESS_BLOCKERS)
        & M.any_pattern(low, [M.letters_first(talk) for talk in R.AWARENESS_TALK]),
    )))


def context_gates(df: DataFrame, comment: str = "comment") -> DataFrame:
    """Add ``tier3_verdict`` and ``tier3_reason``; the first gate that applies wins.

    ``account_days_old`` and ``user_post_count`` are used when present (see
    ``with_accounts``); unknown accounts count as old.
    """
    age = F.coalesce("account_days_old", F.lit(365)) if "account_days_old" in df.columns else F.lit(365)
    posts = F.coalesce("user_post_count", F.lit(1)) if "user_post_count" in df.columns else F.lit(1)
    staged = df if set(_GATE_SIGNALS) <= set(df.columns) else evaluate_once(
        _with_hits(df, comment), _gate_signals()).drop("_low", "_hits")
    business = (F.size("_signals") >= 3) & ~F.col("_routing")
    new_account = (age < 7) & (posts == 1)
    return staged.withColumns({
        "tier3_verdict": F.when(F.col("_peer"), "safe_peer_support")
        .when(business, "safe_business").when(F.col("_aware"), "safe_awareness")
        .when(new_account, "new_account_risk").otherwise("proceed"),
        "tier3_reason": F.when(F.col("_peer"), "peer support without predatory signals")
        .when(business, F.concat(F.lit("business signals: "), F.array_join("_signals", ", ")))
        .when(F.col("_aware"), "warning others about scams")
        .when(new_account, F.format_string("new account (%dd) with first post", age))
        .otherwise(""),
    }).drop(*_GATE_SIGNALS)


def with_accounts(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Candidates with account age and post count, where known."""
    known = accounts.select("interaction_id", "account_days_old", "user_post_count")
    return rows.join(known, "interaction_id", "left")


@dataclass(frozen=True)
class Policy:
    """Confidence thresholds; ``medium`` is pulled below ``block`` for routing."""

    block: float = 0.85
    medium: float = 0.60

    @property
    def routing_medium(self) -> float:
        if self.medium >= self.block:
            return max(0.50, round(self.block - 0.01, 2))
        return self.medium


def with_verdicts(rows: DataFrame, verdict_table: DataFrame, raw: str = "scam_raw",
                  also: tuple[str, ...] = ()) -> DataFrame:
    """Left join on the reviewer's answers; no answer counts as a timeout. ``also`` names further
    answers to bring along."""
    answers = verdict_table.select("interaction_id", F.col(raw).alias("_raw"), *also)
    return rows.join(answers, "interaction_id", "left").withColumn(
        raw, F.coalesce("_raw", F.lit("ERROR: Timeout"))
    ).drop("_raw")


def parse_verdicts(rows: DataFrame, raw: str = "scam_raw") -> DataFrame:
    """Status and fields of each answer, with the heuristic fallback on outages."""
    answer = F.col("_answer")
    status = (
        F.when(verdicts.is_error(raw), F.col(raw))
        .when(F.col("_fields").isNull(), "JSON_PARSE_ERROR").otherwise("OK")
    )
    ok, outage = F.col("llm_status") == "OK", verdicts.is_error("llm_status")
    strong = F.col("severity_level").isin("HIGH", "MEDIUM")
    high = F.col("severity_level") == "HIGH"
    none = F.array().cast("array<string>")
    staged = rows.withColumn("_body", verdicts.extract_json(raw)).withColumns({
        "_fields": verdicts.json_fields("_body"),
        "_answer": F.from_json("_body", verdicts.SCAM_ANSWER),
    }).withColumn("llm_status", status)
    return staged.withColumns({
        "is_scam": F.when(ok, answer["is_scam"]).when(outage & strong, True),
        "confidence": F.when(ok, answer["confidence"].try_cast("double"))
        .when(outage & high, 0.9).when(outage & strong, 0.75).when(outage, 0.2),
        "recommended_action": F.when(
            ok & (F.coalesce(answer["recommended_action"], F.lit("")) != ""),
            answer["recommended_action"],
        ).when(outage & high, "block").when(outage & ~strong, "audit")
        .otherwise("flag_for_review"),
        "reasons": F.when(ok, F.concat(
            F.array(F.coalesce(answer["reasoning"], F.lit(""))),
            F.coalesce(answer["reasons"], none),
        )).when(outage, F.array(F.lit("reviewer unavailable; heuristic fallback applied")))
        .otherwise(none),
        "indicators": F.when(ok, F.coalesce(answer["indicators"], none))
        .when(outage, F.col("matched_terms")).otherwise(none),
    }).drop("_body", "_fields", "_answer")


def needs_context_check(policy: Policy = Policy()) -> Column:
    confidence = F.coalesce("confidence", F.lit(0.0))
    return (
        (F.col("llm_status") == "OK") & F.coalesce("is_scam", F.lit(False))
        & (confidence >= policy.routing_medium) & (confidence < policy.block)
    )


def with_context(rows: DataFrame, verdict_table: DataFrame, policy: Policy = Policy(),
                 raw: str = "context_raw") -> DataFrame:
    """Context answers, used only where a mid-confidence scam needs them; joined unless the rows
    carry them already."""
    if raw in rows.columns:
        joined = rows.withColumn(
            "_context", F.when(needs_context_check(policy), F.col(raw))
        ).drop(raw)
    else:
        answers = verdict_table.select(
            F.col("interaction_id").alias("_id"), F.col(raw).alias("_context")
        )
        joined = rows.withColumn("_check", needs_context_check(policy)).join(
            answers, (F.col("interaction_id") == F.col("_id")) & F.col("_check"), "left"
        ).drop("_id", "_check")
    fields = F.from_json(verdicts.extract_json("_context"), verdicts.CONTEXT_ANSWER)
    return joined.withColumn(
        "_fields", F.when(~verdicts.is_error("_context"), fields)
    ).withColumns({
        "context_verdict": F.col("_fields")["context_verdict"],
        "context_pattern": F.when(
            F.col("_fields")["context_verdict"].isNotNull(),
            F.coalesce(F.col("_fields")["pattern"], F.lit("unknown")),
        ),
        "context_reason": F.col("_fields")["reasoning"],
    }).drop("_context", "_fields")


def route(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Final ``disposition`` (flag, audit, drop), ``audit_reason`` and action of each candidate."""
    ok = F.col("llm_status") == "OK"
    scam = F.coalesce("is_scam", F.lit(False))
    strong = F.col("severity_level").isin("HIGH", "MEDIUM")
    demoted = (
        ok & (F.col("recommended_action") == "block")
        & F.startswith("tier3_verdict", F.lit("safe_"))
    )
    action = F.when(demoted, "flag_for_review").otherwise(F.col("recommended_action"))
    noted = (
        ok & (F.col("recommended_action") == "flag_for_review")
        & (F.col("tier3_verdict") == "new_account_risk")
    )
    passed = F.coalesce(F.col("context_verdict") == "context_pass", F.lit(False))
    confident = scam & (F.coalesce("confidence", F.lit(0.0)) >= policy.block)
    urgent = confident | (F.col("_action") == "block")
    review = F.col("_action") == "flag_for_review"
    note = F.concat(F.lit("account note: "), "tier3_reason")
    extra = F.when(demoted | noted, F.array(F.concat(F.lit("context gate: "), "tier3_reason")))
    lead = F.when(passed, F.array(F.concat(
        F.lit("context check: "), F.coalesce("context_reason", F.lit("normal pattern")))))
    none = F.array().cast("array<string>")
    return rows.withColumn("_action", action).withColumns({
        "disposition": F.when(~ok, F.when(scam & strong, "flag").otherwise("audit"))
        .when(urgent, F.when(passed, "audit").otherwise("flag"))
        .when(review, "audit").otherwise("drop"),
        "audit_reason": F.when(
            ~ok, F.when(~(scam & strong), "reviewer unavailable: weak fallback")
        ).when(urgent & passed, F.concat(F.lit("context override: "), "context_pattern"))
        .when(urgent & noted, note)
        .when(~urgent & review, "unclear verdict"),
        "reasons": F.concat(F.coalesce(lead, none), "reasons", F.coalesce(extra, none)),
        "recommended_action": F.col("_action"),
    }).drop("_action")


def cascade(df: DataFrame, verdict_table: DataFrame, accounts: DataFrame | None = None,
            policy: Policy = Policy(), staff: StaffPolicy = StaffPolicy(),
            include_trusted_users: bool = False) -> DataFrame:
    """Scan, verdicts, gates, context check and routing in one plan."""
    # Both answers come with one read of the verdict table.
    rows = parse_verdicts(with_verdicts(
        candidates(df, staff, include_trusted_users), verdict_table, also=("context_raw",)))
    if accounts is not None:
        rows = with_accounts(rows, accounts)
    answered = F.col("llm_status") == "OK"
    gated = context_gates(rows).withColumns({  # gates judge answers; a failed one has none
        c: F.when(answered, F.col(c)) for c in ("tier3_verdict", "tier3_reason")
    })
    return route(with_context(gated, verdict_table, policy), policy)


def flags(routed: DataFrame) -> DataFrame:
    return routed.filter("disposition = 'flag'")


def audit_queue(routed: DataFrame) -> DataFrame:
    return routed.filter("disposition = 'audit'")


def review_severity(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Add review ``severity`` and ``review_priority`` 1 to 4."""
    def overlap(terms):
        return F.arrays_overlap("indicators", F.array(*map(F.lit, terms)))

    scam = F.coalesce("is_scam", F.lit(False))
    confidence = F.coalesce("confidence", F.lit(0.0))
    risky = overlap(R.PAYMENT_TERMS) | (overlap(R.OFF_PLATFORM_TERMS) & overlap(R.BAIT_TERMS))
    level = (
        F.when(scam & (confidence >= policy.block) & F.coalesce(risky, F.lit(False)), 1)
        .when(scam & (confidence >= max(policy.medium, 0.75)), 2)
        .when(scam & (confidence >= policy.medium), 3)
        .otherwise(4)
    )
    return rows.withColumn("review_priority", level).withColumn(
        "severity",
        F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))),
                     F.col("review_priority")),
    )


def review_queue(rows: DataFrame) -> DataFrame:
    """Most urgent first: priority, confidence, points, id."""
    return rows.orderBy(
        "review_priority", F.desc(F.coalesce("confidence", F.lit(0.0))),
        F.desc("heuristic_score"), "interaction_id",
    )
