"""Oracle SQL building blocks. They share the fixed word lists with the library, not its logic."""

from __future__ import annotations

from hearthlight import labels as L
from hearthlight import rules as R
from checks.views import STAFF_DOMAIN, oracle_views

EDGE_L, EDGE_R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def word(pattern: str) -> str:
    """Unicode word edges for an engine whose \\b is ASCII and that has no lookaround."""
    if pattern.startswith(r"\b"):
        pattern = EDGE_L + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + EDGE_R
    return pattern


def matches(value: str, pattern: str, flags: str = "") -> str:
    extra = f", {q(flags)}" if flags else ""
    return f"regexp_matches({value}, {q(word(pattern))}{extra})"


def any_match(value: str, patterns) -> str:
    return "(" + " OR ".join(matches(value, p) for p in patterns) + ")"


def any_contains(value: str, terms) -> str:
    return "(" + " OR ".join(f"contains({value}, {q(t)})" for t in terms) + ")"


def clean(value: str) -> str:
    out = f"regexp_replace({value}, '<[^>]+>', ' ', 'g')"
    for ref, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        out = f"replace({out}, {q(ref)}, {q(char)})"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    return f"coalesce(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '')"


def norm(value: str) -> str:
    return f"lower({clean(value)})"


def text_hash(value: str) -> str:
    return f"sha256({norm(value)})"


def viable(cleaned: str) -> str:
    letters = f"length(regexp_replace({cleaned}, '[^A-Za-z]', '', 'g'))"
    return (
        f"((length({cleaned}) >= 15 AND {letters} >= 3) OR (length({cleaned}) >= 6 AND "
        f"{letters} >= 2 AND {matches(cleaned, R.SHORT_TEXT_SIGNAL, 'i')}))"
    )


def identity(value: str, fallback: str = "N/A") -> str:
    return (
        f"CASE WHEN {value} IS NULL OR lower(trim({value})) IN ('', 'nan', 'none', 'null', 'nat') "
        f"THEN {q(fallback)} ELSE trim({value}) END"
    )


def staff(name: str = "commenter_name", mail: str = "commenter_email") -> str:
    return (
        f"(contains(lower(coalesce({mail}, '')), '@{STAFF_DOMAIN}') OR "
        + any_contains(f"lower(coalesce({name}, ''))", R.STAFF_NAME_TOKENS) + ")"
    )


def plus(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def greatest(labels, prefix: str = "") -> str:
    return "greatest(" + ", ".join(prefix + x for x in labels) + ")"


def first_max(labels, prefix: str = "") -> str:
    top = greatest(labels, prefix)
    cases = " ".join(f"WHEN {prefix}{x} = {top} THEN {q(x)}" for x in labels)
    return f"CASE {cases} END"


def active(prefix: str = "") -> str:
    cases = ", ".join(
        f"CASE WHEN {prefix}{x} >= {L.DEFAULT_THRESHOLDS[x]!r}::DOUBLE THEN {q(x)} END"
        for x in L.LABELS)
    names = f"concat_ws(', ', {cases})"
    return (
        f"CASE WHEN {names} <> '' THEN {names} WHEN {greatest(L.LABELS, prefix)} > 0 "
        f"THEN {first_max(L.LABELS, prefix)} ELSE 'neutral' END"
    )


def component_sum(labels, prefix: str = "") -> str:
    return plus(f"CASE WHEN {prefix}{x} > 0.1::DOUBLE THEN {prefix}{x} ELSE 0 END" for x in labels)


def component_count(labels, prefix: str = "") -> str:
    return plus(f"CASE WHEN {prefix}{x} > 0.1::DOUBLE THEN 1 ELSE 0 END" for x in labels)


def component_list(labels, prefix: str = "") -> str:
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {prefix}{x} > 0.1::DOUBLE THEN {q(x)} END" for x in labels) + ")"


def entropy(prefix: str = "") -> str:
    clipped = [f"least(greatest({prefix}{x}, 1e-9), 1.0)" for x in L.LABELS]
    total = plus(clipped)
    return f"(ln({total}) - {plus(f'{c} * ln({c})' for c in clipped)} / {total})"


def monday(ts: str) -> str:
    return f"CAST(date_trunc('week', {ts}) AS DATE)"


def week_key(ts: str) -> str:
    return f"concat(isoyear({ts}), '-W', lpad(CAST(weekofyear({ts}) AS VARCHAR), 2, '0'))"


def week_label(ts: str) -> str:
    return f"concat('W', weekofyear({ts}), '/', isoyear({ts}))"


def draw(key: str, seed: int = 42) -> str:
    return f"sha256(concat('{seed}:', CAST({key} AS VARCHAR)))"


def boolean_verdict(raw: str) -> str:
    t = f"translate(upper({raw}), '*# ', '')"
    return (
        f"CASE WHEN contains({t}, 'VERDICT:TRUE') THEN true "
        f"WHEN contains({t}, 'VERDICT:FALSE') THEN false "
        f"WHEN contains({t}, 'TRUE') AND NOT contains({t}, 'FALSE') THEN true "
        f"WHEN contains({t}, 'FALSE') AND NOT contains({t}, 'TRUE') THEN false END"
    )


def json_body(raw: str) -> str:
    """Answers in the test views hold at most one object."""
    return f"nullif(regexp_extract({raw}, '(?s)\\{{.*\\}}'), '')"


def flag(name: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN {q(name)} END"


# --- fraud scan ------------------------------------------------------------------------------

_LISTS = {
    "urgency": R.URGENCY_TERMS, "investment": R.INVESTMENT_TERMS, "job": R.JOB_TERMS,
    "smishing": R.SMISHING_TERMS, "loan": R.LOAN_TERMS, "engagement": R.ENGAGEMENT_TERMS,
    "task": R.TASK_TERMS, "impersonation": R.IMPERSONATION_TERMS, "prize_fee": R.PRIZE_FEE_TERMS,
    "pii": R.PII_TERMS, "debt": R.DEBT_RELIEF_TERMS, "benefit": R.BENEFIT_TERMS,
    "aware": R.AWARENESS_TERMS, "prize": R.LOTTERY_TERMS, "phishing": R.PHISHING_TERMS,
    "sms": R.SMS_SPAM_TERMS, "financial": R.FINANCIAL_SPAM_TERMS, "sending": R.SEND_TERMS,
    "bait": R.BAIT_TERMS, "off": R.OFF_PLATFORM_TERMS, "predatory": R.PREDATORY_TERMS,
}


def payment(term: str) -> str:
    if term.isalpha() and len(term) <= 4:
        return f"regexp_matches(t, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    return f"contains(t, {q(term)})"


def _scan_flags() -> str:
    out = [f"{any_contains('t', terms)} AS {name}" for name, terms in _LISTS.items()]
    out += [
        f"{plus(f'CASE WHEN contains(t, {q(k)}) THEN 1 ELSE 0 END' for k in R.SCAM_KEYWORDS)} AS kw",
        f"{plus(f'CASE WHEN {payment(k)} THEN 1 ELSE 0 END' for k in R.PAYMENT_TERMS)} AS pays",
        "concat_ws('|', " + ", ".join(
            flag(k, f"contains(t, {q(k)})") for k in dict.fromkeys(R.SCAM_KEYWORDS)) + ") AS words",
        f"regexp_matches(raw, {q(R.EMAIL)}, 'i') AS mail",
        f"regexp_matches(raw, {q(R.PHONE)}) AS phone",
        f"regexp_matches(raw, {q(R.URL)}, 'i') AS url",
        f"{matches('raw', R.SHORTLINK, 'i')} AS short",
        f"{matches('t', R.SMS_ACTION)} AS act", f"{matches('t', R.SMS_PROMO)} AS promo",
        f"{matches('t', R.SMS_FREE)} AS free_word",
        "regexp_matches(t, '(^|[^0-9])[0-9]{5}([^0-9]|$)') AS code",
        f"{matches('t', R.SHORTCODE_ACTION)} AS code_act",
        f"{matches('t', R.SHORTCODE_PROMO)} AS code_promo",
        f"({matches('t', R.ACCOUNT_PHRASE)} AND "
        f"len(regexp_extract_all(t, {q(R.ACCOUNT_CONTEXT)})) >= 2) AS account",
    ]
    return ", ".join(out)


_POINTS = (
    (2, "mail"), (2, "phone"), (4, "short"), (1, "url"),
    (4, "bait AND off"), (3, "pays >= 1 AND off"), (2, "pays >= 2"), (4, "predatory AND off"),
    (4, "predatory AND pays >= 1"), (3, "urgency AND pays >= 1"),
    (5, "investment AND (pays >= 1 OR off)"),
    (2, "investment AND NOT (pays >= 1 OR off) AND urgency"),
    (5, "job AND pays >= 1 AND urgency"), (2, "job AND pays >= 1 AND NOT urgency"),
    (3, "sending AND pays >= 1"), (4, "smishing AND link"), (2, "smishing AND urgency"),
    (4, "loan AND pays >= 1"), (4, "loan AND (engagement OR pii)"),
    (5, "task AND (pays >= 1 OR off)"), (3, "job AND off AND (engagement OR urgency)"),
    (2, "job AND off AND NOT (engagement OR urgency)"),
    (5, "impersonation AND contains(t, 'gift card')"),
    (5, "impersonation AND (pays >= 1 OR pii OR contains(t, 'gold') OR contains(t, 'withdraw cash'))"),
    (5, "impersonation AND (contains(concat(' ', t), ' pin') OR contains(t, 'pins') OR "
        "contains(t, 'numbers on the back'))"),
    (5, "prize_fee"), (5, "debt"), (5, "benefit AND (pii OR sending OR off)"),
    (5, "prize AND link"), (3, "prize AND urgency"), (4, "phishing AND link"),
    (4, "phishing AND pii"), (3, "sms AND link"), (2, "sms AND urgency"),
    (4, "financial AND (link OR pays >= 1)"), (4, "phone AND act AND (promo OR (free_word AND link))"),
    (5, "code AND code_act AND code_promo"), (5, "account"),
    (3, "contains(t, 'lottery') AND mail"), (-3, "aware AND NOT off AND pays = 0"),
)
SEVERITY = (
    "CASE WHEN short OR heuristic_score >= 15 THEN 'HIGH' WHEN heuristic_score >= 8 THEN 'MEDIUM' "
    "WHEN heuristic_score >= 5 THEN 'LOW' END"
)


def _support() -> str:
    cells, counts = [], []
    for p in R.SUPPORT_NEED:
        cells.append(flag(p, matches("n", p)))
    return "concat_ws('|', " + ", ".join(cells) + ")"


def _hints(value: str, order) -> str:
    return "concat_ws('|', " + ", ".join(
        flag(x, any_match(value, R.RARE_HINTS[x])) for x in order) + ")"


def _severe_flags() -> str:
    act = L.DEFAULT_THRESHOLDS

    def num(x: float) -> str:
        return f"{x!r}::DOUBLE"

    def band(x: str) -> str:
        return num(max(0.05, act[x] * 0.75))

    floor = "CASE dom " + " ".join(
        f"WHEN {q(x)} THEN {num(act[x] * 0.20)}" for x in (*L.SERIOUS, "confusion")) + " END"
    tests = [
        (f"{x}_review_band",
         f"{x} >= CASE WHEN contains(concat('|', hints, '|'), '|{x}|') THEN {num(b * 0.65)} "
         f"ELSE {num(b)} END") for x, b in L.REVIEW_BANDS.items()
    ]
    tests += [
        ("embarrassment_review_band", f"embarrassment >= {band('embarrassment')}"),
        ("sadness_above_review_band", f"sadness >= {band('sadness')}"),
        ("sadness_disappointment_cluster",
         f"disappointment >= {band('disappointment')} AND sadness >= {num(act['sadness'] * 0.6)}"),
        ("fear_nervousness_cluster",
         f"fear >= {num(act['fear'] * 0.5)} AND nervousness >= {num(act['nervousness'] * 0.5)}"),
        ("severe_sum_high", f"ssum >= {num(max(0.45, sum(act[x] for x in L.SEVERE_SUM) * 0.5))}"),
        ("severe_hard_guardrail", f"ssum >= {num(0.55)} OR spike >= {num(0.40)}"),
        ("support_need_signal", f"hits <> '' AND ctx >= {floor}"),
        ("support_need_with_grief_hint",
         f"hits <> '' AND NOT ctx >= {floor} AND grief >= {num(0.08)}"),
        ("lexical_hardship_override", f"hardship AND ctx >= {num(0.08)}"),
        ("multi_hit_context_override", "n_hits >= 3 AND hard_context"),
    ]
    return "concat_ws('|', " + ", ".join(flag(n, c) for n, c in tests) + ")"


_STRONG = (
    "severe_sum_high", "severe_hard_guardrail", "support_need_signal",
    "support_need_with_grief_hint", "sadness_above_review_band", "grief_review_band",
    "remorse_review_band",
)
_NEG11 = tuple(x for x in L.NEGATIVE if x != "confusion")
_OTHER_FLAGS = (
    "sadness_disappointment_cluster", "fear_nervousness_cluster", "lexical_hardship_override",
    "multi_hit_context_override",
)


def has_any(column: str, names) -> str:
    return "(" + " OR ".join(
        f"contains(concat('|', {column}, '|'), '|{n}|')" for n in names) + ")"


def _views() -> dict[str, tuple[tuple[str, ...], str]]:
    v = dict(oracle_views())
    v["scan0"] = (("interactions",),
                  "SELECT *, content AS raw, lower(content) AS t FROM interactions")
    v["scan1"] = (("scan0",), f"SELECT *, {_scan_flags()} FROM scan0")
    v["scan2"] = (("scan1",), "SELECT *, (url OR short) AS link FROM scan1")
    v["scan"] = (("scan2",), (
        "SELECT *, greatest(0, least(6, kw) + "
        + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for p, c in _POINTS)
        + ") AS heuristic_score, concat_ws('|', nullif(words, ''), "
        + ", ".join([flag("email_address", "mail"), flag("phone_number", "phone"),
                     flag("url", "url"), flag("shortlink", "short")])
        + ") AS matched_terms FROM scan2"
    ))
    v["cand"] = (("scan",), (
        f"SELECT *, {SEVERITY} AS severity_level, {identity('community_name')} AS community, "
        f"{identity('commenter_name', 'Unknown')} AS member FROM scan WHERE NOT {staff()} "
        f"AND {SEVERITY} IS NOT NULL"
    ))
    peer = f"{any_match('t', R.PEER_SUPPORT)} AND NOT {any_contains('t', R.PEER_BLOCKERS)}"
    signals = "concat_ws(', ', " + ", ".join(
        flag(n, matches("t", p)) for n, p in R.BUSINESS_SIGNALS) + ")"
    n_signals = plus(f"CASE WHEN {matches('t', p)} THEN 1 ELSE 0 END" for _, p in R.BUSINESS_SIGNALS)
    talk = [
        r"\b(?:is this a scam\?)\b", r"\b(?:warning|don't click|do not click|beware|scam alert"
        r"|be careful|watch out|this is a scam|fake)\b", R.AWARENESS_TALK[1],
    ]
    talk[0] = r"(^|[^\p{L}\p{N}_])is this a scam\?[\p{L}\p{N}_]"
    aware = f"{any_match('t', talk)} AND NOT {any_contains('t', R.AWARENESS_BLOCKERS)}"
    v["gated"] = (("cand", "accounts"), (
        f"SELECT c.*, {signals} AS sigs, ({peer}) AS g1, ({n_signals} >= 3 AND NOT "
        f"{any_contains('t', R.BUSINESS_BLOCKERS)}) AS g2, ({aware}) AS g3, "
        "(coalesce(a.account_days_old, 365) < 7 AND coalesce(a.user_post_count, 1) = 1) AS g4, "
        "a.account_days_old AS age FROM cand c LEFT JOIN accounts a USING (interaction_id)"
    ))
    v["gates"] = (("gated",), (
        "SELECT *, CASE WHEN g1 THEN 'safe_peer_support' WHEN g2 THEN 'safe_business' "
        "WHEN g3 THEN 'safe_awareness' WHEN g4 THEN 'new_account_risk' ELSE 'proceed' END AS gate, "
        "CASE WHEN g1 THEN 'peer support without predatory signals' "
        "WHEN g2 THEN concat('business signals: ', sigs) WHEN g3 THEN 'warning others about scams' "
        "WHEN g4 THEN concat('new account (', age, 'd) with first post') ELSE '' END AS gate_reason "
        "FROM gated"
    ))
    v["answered"] = (("gates", "verdicts"), (
        "SELECT g.*, coalesce(v.scam_raw, 'ERROR: Timeout') AS scam_raw, v.context_raw, "
        f"{json_body('v.scam_raw')} AS body FROM gates g LEFT JOIN verdicts v USING (interaction_id)"
    ))
    v["parsed0"] = (("answered",), (
        "SELECT *, CASE WHEN starts_with(scam_raw, 'ERROR:') THEN scam_raw WHEN body IS NULL "
        "THEN 'JSON_PARSE_ERROR' ELSE 'OK' END AS status FROM answered"
    ))
    v["parsed"] = (("parsed0",), (
        "SELECT *, "
        "CASE WHEN status = 'OK' THEN CAST(json_extract_string(body, '$.is_scam') AS BOOLEAN) "
        "WHEN status LIKE 'ERROR:%' AND severity_level IN ('HIGH', 'MEDIUM') THEN true END AS scam, "
        "CASE WHEN status = 'OK' THEN CAST(json_extract_string(body, '$.confidence') AS DOUBLE) "
        "WHEN status LIKE 'ERROR:%' THEN CASE severity_level WHEN 'HIGH' THEN 0.9::DOUBLE "
        "WHEN 'MEDIUM' THEN 0.75::DOUBLE ELSE 0.2::DOUBLE END END AS conf, "
        "CASE WHEN status = 'OK' THEN json_extract_string(body, '$.recommended_action') "
        "WHEN status LIKE 'ERROR:%' AND severity_level = 'HIGH' THEN 'block' "
        "WHEN status LIKE 'ERROR:%' AND severity_level = 'LOW' THEN 'audit' "
        "ELSE 'flag_for_review' END AS action0, "
        "CASE WHEN status = 'OK' THEN array_to_string(CAST(json_extract(body, '$.indicators') "
        "AS VARCHAR[]), '|') WHEN status LIKE 'ERROR:%' THEN matched_terms ELSE '' END AS inds, "
        "CASE WHEN status = 'OK' THEN json_extract_string(body, '$.reasoning') "
        "WHEN status LIKE 'ERROR:%' THEN 'reviewer unavailable; heuristic fallback applied' "
        "ELSE '' END AS reason0 FROM parsed0"
    ))
    v["routed0"] = (("parsed",), (
        "SELECT *, CASE WHEN status = 'OK' AND action0 = 'block' AND starts_with(gate, 'safe_') "
        "THEN 'flag_for_review' ELSE action0 END AS action, "
        "(status = 'OK' AND coalesce(scam, false) AND coalesce(conf, 0) >= 0.6::DOUBLE AND "
        "coalesce(conf, 0) < 0.85::DOUBLE) AS need_context, "
        "(coalesce(scam, false) AND coalesce(conf, 0) >= 0.85::DOUBLE) AS confident, "
        "(status = 'OK' AND action0 = 'flag_for_review' AND gate = 'new_account_risk') AS noted "
        "FROM parsed"
    ))
    v["routed1"] = (("routed0",), (
        "SELECT *, (need_context AND json_extract_string(context_raw, '$.context_verdict') = "
        "'context_pass') AS passed, (confident OR action = 'block') AS urgent FROM routed0"
    ))
    v["routed"] = (("routed1",), (
        "SELECT *, CASE WHEN status <> 'OK' THEN CASE WHEN coalesce(scam, false) AND severity_level "
        "IN ('HIGH', 'MEDIUM') THEN 'flag' ELSE 'audit' END WHEN urgent THEN CASE WHEN "
        "coalesce(passed, false) THEN 'audit' ELSE 'flag' END WHEN action = 'flag_for_review' THEN "
        "'audit' ELSE 'drop' END AS disposition, "
        "CASE WHEN status <> 'OK' THEN CASE WHEN NOT (coalesce(scam, false) AND severity_level IN "
        "('HIGH', 'MEDIUM')) THEN 'reviewer unavailable: weak fallback' END "
        "WHEN urgent AND coalesce(passed, false) THEN concat('context override: ', "
        "json_extract_string(context_raw, '$.pattern')) WHEN urgent AND noted THEN "
        "concat('account note: ', gate_reason) WHEN NOT urgent AND action = 'flag_for_review' "
        "THEN 'unclear verdict' END AS audit_reason FROM routed1"
    ))
    risky = (
        f"({has_any('inds', R.PAYMENT_TERMS)} OR ({has_any('inds', R.OFF_PLATFORM_TERMS)} AND "
        f"{has_any('inds', R.BAIT_TERMS)}))"
    )
    v["reviewed"] = (("routed",), (
        "SELECT *, CASE WHEN coalesce(scam, false) AND coalesce(conf, 0) >= 0.85::DOUBLE AND "
        f"{risky} THEN 1 WHEN coalesce(scam, false) AND coalesce(conf, 0) >= 0.75::DOUBLE THEN 2 "
        "WHEN coalesce(scam, false) AND coalesce(conf, 0) >= 0.6::DOUBLE THEN 3 ELSE 4 END AS "
        "priority FROM routed WHERE disposition = 'flag'"
    ))
    v["sig0"] = (("interactions",), (
        f"SELECT *, {norm('content')} AS n, lower(content) AS low FROM interactions"))
    v["sig1"] = (("sig0",), (
        f"SELECT *, {_support()} AS hits, {_hints('n', sorted(R.RARE_HINTS))} AS hints, "
        f"{any_match('low', R.HARDSHIP_PHRASES)} AS hardship, "
        f"{any_match('low', R.HARDSHIP_CONTEXT)} AS hard_context FROM sig0"
    ))
    v["sig"] = (("sig1",), (
        "SELECT *, CASE WHEN hits = '' THEN 0 ELSE len(string_split(hits, '|')) END AS n_hits "
        "FROM sig1"))
    dom_set = (*L.SERIOUS, "confusion")
    v["sev0"] = (("sig", "scores"), (
        f"SELECT i.*, s.* EXCLUDE (interaction_id), {component_sum(L.SEVERE_SUM)} AS ssum, "
        f"{component_count(L.SEVERE_SUM)} AS scount, {greatest(L.SERIOUS)} AS spike, "
        f"{first_max(dom_set)} AS dom, {greatest(dom_set)} AS dom_score, "
        f"{greatest(L.SUPPORT_CONTEXT)} AS ctx, {component_list(L.SEVERE_SUM)} AS comps "
        "FROM sig i JOIN scores s USING (interaction_id)"
    ))
    v["sev1"] = (("sev0",), f"SELECT *, {_severe_flags()} AS flags0 FROM sev0")
    v["sev2"] = (("sev1",), (
        f"SELECT *, CASE WHEN NOT {has_any('flags0', _STRONG)} AND NOT "
        f"{has_any('flags0', _OTHER_FLAGS)} AND hits = '' AND scount <= 1 THEN '' ELSE flags0 END "
        f"AS flags, {plus(_NEG11)} AS negsum, {component_count(_NEG11)} AS negcount, "
        f"{greatest(L.NEGATIVE)} AS neg_peak FROM sev1"
    ))
    neg_dom = first_max((*_NEG11, "confusion"))
    v["detail"] = (("sev2",), (
        "SELECT *, flags <> '' AS severe, flags = '' AND neg_peak > 0 AND ((negsum >= 0.2::DOUBLE "
        "AND negsum < 0.55::DOUBLE) OR (ctx >= 0.18::DOUBLE AND negsum >= 0.12::DOUBLE) OR (hits <> '' "
        f"AND ctx >= 0.12::DOUBLE)) AS mild, {neg_dom} AS neg_dom, {component_list(_NEG11)} AS neg_comps, "
        "CASE WHEN scount > 0 THEN ssum / scount ELSE 0 END AS savg, "
        "CASE WHEN negcount > 0 THEN negsum / negcount ELSE 0 END AS navg, "
        f"{first_max(L.LABELS)} AS top_label, {greatest(L.LABELS)} AS top_score FROM sev2"
    ))
    v["severe"] = (("detail",), (
        "SELECT *, round(ssum * 100, 1) AS total_negative, round(dom_score * 100, 1) AS score100, "
        "round(savg * 100, 1) AS avg100, concat(upper(dom[1]), dom[2:]) AS emotion "
        f"FROM detail WHERE severe AND NOT {staff()}"
    ))
    v["verified0"] = (("severe", "verdicts"), (
        "SELECT s.*, coalesce(v.sanity_raw, 'ERROR: Timeout') AS sanity_raw FROM severe s "
        "LEFT JOIN verdicts v USING (interaction_id)"))
    v["verified1"] = (("verified0",), (
        "SELECT *, starts_with(sanity_raw, 'ERROR:') AS failed, CASE WHEN NOT starts_with(sanity_raw,"
        f" 'ERROR:') THEN {boolean_verdict('sanity_raw')} END AS verdict, (hits <> '' OR "
        f"total_negative >= 55 OR {has_any('flags', ('support_need_signal', 'support_need_with_grief_hint', 'severe_sum_high'))}) "
        "AS over FROM verified0"))
    v["verified"] = (("verified1",), (
        "SELECT *, CASE WHEN failed THEN false WHEN verdict THEN true WHEN verdict IS NULL THEN over "
        "ELSE over AND total_negative >= 70 END AS keep FROM verified1"))
    v["vsource"] = (("verified",), (
        "SELECT *, CASE WHEN failed THEN NULL WHEN verdict THEN 'gemini_true' WHEN verdict IS NULL "
        "AND keep THEN 'recall_override_ambiguous' WHEN keep THEN 'recall_override_false' ELSE "
        "'gemini_false' END AS source, CASE WHEN failed THEN sanity_raw WHEN verdict IS NOT NULL THEN "
        "'Verified' WHEN keep THEN 'Recall Override' ELSE 'Ambiguous' END AS status FROM verified"))
    v["wk"] = (("detail",), f"SELECT *, {monday('activity_date')} AS monday FROM detail")
    v["prof"] = (("interactions", "scores"), (
        f"SELECT {monday('i.activity_date')} AS monday, "
        + ", ".join(f"avg(s.{x}) AS {x}" for x in L.LABELS)
        + " FROM interactions i JOIN scores s USING (interaction_id) GROUP BY 1"))
    neg, tot = plus(L.NEGATIVE), plus(L.LABELS)
    v["health"] = (("prof",), (
        f"SELECT *, CASE WHEN {tot} <> 0 THEN round(10 * (1 - {neg} / {tot}), 2) END AS health "
        "FROM prof"))
    # teacher answers
    v["taught"] = (("teacher",), (
        "SELECT interaction_id, starts_with(teacher_raw, '{') AS valid, " + ", ".join(
            "coalesce(TRY_CAST(CASE WHEN starts_with(teacher_raw, '{') THEN "
            f"json_extract_string(teacher_raw, '$.{x}') END AS DOUBLE), 0) AS t_{x}"
            for x in L.LABELS) + " FROM teacher"))
    v["pool"] = (("interactions",), (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cleaned ORDER BY interaction_id) AS rn "
        f"FROM (SELECT *, {clean('content')} AS cleaned FROM interactions)) "
        f"WHERE rn = 1 AND {viable('cleaned')}"))
    v["pairs"] = (("pool", "taught", "scores"), (
        "SELECT p.interaction_id, p.cleaned, t.* EXCLUDE (interaction_id, valid), s.* EXCLUDE "
        "(interaction_id) FROM pool p JOIN taught t USING (interaction_id) JOIN scores s USING "
        "(interaction_id) WHERE t.valid"))
    v["conf"] = (("pairs",), " UNION ALL ".join(
        f"SELECT {q(x)} AS label, {L.DEFAULT_THRESHOLDS[x]!r}::DOUBLE AS threshold, "
        f"count(*) FILTER (WHERE t_{x} >= th AND {x} >= th) AS tp, "
        f"count(*) FILTER (WHERE t_{x} < th AND {x} >= th) AS fp, "
        f"count(*) FILTER (WHERE t_{x} >= th AND {x} < th) AS fn, "
        f"count(*) FILTER (WHERE t_{x} < th AND {x} < th) AS tn FROM "
        f"(SELECT *, {L.DEFAULT_THRESHOLDS[x]!r}::DOUBLE AS th FROM pairs)" for x in L.LABELS))
    # training candidates
    v["train0"] = (("interactions",), (
        f"SELECT * EXCLUDE (content), {clean('content')} AS content FROM interactions"))
    v["train1"] = (("train0",), (
        f"SELECT *, {norm('content')} AS n, {text_hash('content')} AS text_hash FROM train0"))
    v["train2"] = (("train1",), (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text_hash ORDER BY interaction_id) "
        f"AS rn FROM train1 WHERE {viable('content')} AND n <> '') WHERE rn = 1"))
    v["master"] = (("external",), (
        f"SELECT row_no, text, {text_hash('text')} AS text_hash FROM external WHERE has_labels"))
    v["train"] = (("train2", "master", "scores"), (
        f"SELECT t.*, s.* EXCLUDE (interaction_id), {entropy()} AS ent, {plus(_NEG11)} AS negsum, "
        f"{greatest(L.SERIOUS)} AS spike, {first_max(L.LABELS)} AS prim, {greatest(L.LABELS)} AS "
        f"prim_score, {_hints('n', R.RARE_HINTS)} AS hints, {greatest(L.RARE)} AS rare_sig, "
        f"{greatest(L.UPBEAT)} AS fp_sig, {any_match('lower(content)', R.CONFLICT)} AS conflict, "
        f"{greatest([x for x in L.LABELS if x != 'neutral'])} AS peak2 FROM train2 t JOIN scores s "
        "USING (interaction_id) WHERE text_hash NOT IN (SELECT text_hash FROM master)"))
    rare = "(rare_sig >= 0.08::DOUBLE OR hints <> '')"
    v["masks"] = (("train",), (
        f"SELECT *, {rare} AS m1, ent >= (SELECT quantile_cont(ent, 0.75) FROM train) AS m2, "
        "(fp_sig >= 0.25::DOUBLE AND (negsum >= 0.25::DOUBLE OR spike >= 0.2::DOUBLE OR hints <> '' OR "
        f"conflict)) AS m3, (neutral >= 0.25::DOUBLE AND peak2 <= 0.18::DOUBLE AND NOT {rare}) AS m4, "
        "true AS m5 FROM train"))
    return v


VIEWS = _views()


def statement(body: str, views: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in VIEWS[name][0]:
            visit(needed)
        order.append(name)

    for name in views:
        visit(name)
    if not order:
        return body
    parts = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    glue = ", " if body.lstrip().upper().startswith("WITH ") else " "
    if glue == ", ":
        body = body.lstrip()[5:]
    return f"WITH {parts}{glue}{body}"
