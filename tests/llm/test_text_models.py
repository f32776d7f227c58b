"""Personal data, toxicity and URL filters: brute force, held-out accuracy, defined cases."""

import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthlight.llm import pii, toxicity, urls

# --- personal data --------------------------------------------------------------------------

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (
                True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15,
            )[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-1 2+()9é@.") for _ in range(rng.randrange(26)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("4111 1111-1111 1111 or 1.2.3.4.5.6.7.8") == brute_spans("4111 1111-1111 1111 or 1.2.3.4.5.6.7.8")


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_field_reads_its_table_and_new_sentences(field):
    for sentence in pii.LABELLED:
        text, spans = pii.read_labelled(sentence)
        assert pii.find_spans([text], field)[0][1] == sorted((a, pii.KINDS.index(k), b) for k, a, b in spans)
    new = {
        "Please mail paul (at) firma (dot) org soon.": ["paul (at) firma (dot) org"],
        "Call (212) 555 0188 before noon.": ["(212) 555 0188"],
        "The box at 10[.]20[.]30[.]40 is up.": ["10[.]20[.]30[.]40"],
        "In 1999 there were 25 of 300 left, see 3.1 and 4.2.": [],
        "We sat at the table by the dot on the map.": [],
    }
    for text, want in new.items():
        assert [text[a:b] for a, _, b in pii.find_spans([text], field)[0][1]] == want


def test_viterbi_finds_the_best_path(field):
    rng = np.random.default_rng(3)
    scores = [rng.normal(size=(n, len(field.start))) for n in (1, 2, 4, 3, 4)]
    k = len(field.start)
    for score, path in zip(scores, pii.viterbi(field, scores), strict=True):
        def value(p, score=score):
            return field.start[p[0]] + score[0, p[0]] + sum(
                field.move[p[i - 1], p[i]] + score[i, p[i]] for i in range(1, len(p)))
        best = max(value(p) for p in np.ndindex(*[k] * len(score)))
        assert value(tuple(path)) == pytest.approx(best)


def test_long_stretches_are_decoded_in_blocks(field, monkeypatch):
    """In bounded memory, and with the labels and spans of all steps at once."""
    rng = np.random.default_rng(5)
    scores = [rng.normal(size=(n, len(field.start))) for n in (1, 7, 40, 41, 300, 2)]
    table = "tel 0171 5550 122, 10 dot 0 dot 12 dot 7; 4111.1111.1111.1111 and 12 of 19.99 at a@b.co\n" * 40
    whole, spans = pii.viterbi(field, scores), pii.find_spans([table, "Tel. (415) 555 0132", table[:900]], field)
    assert len(spans[0][1]) > len(spans[0][0]) > 0
    monkeypatch.setattr(pii, "STEPS", 64)
    monkeypatch.setattr(pii, "_BLOCK", 50)
    assert all((a == b).all() for a, b in zip(whole, pii.viterbi(field, scores), strict=True))
    assert pii.find_spans([table, "Tel. (415) 555 0132", table[:900]], field) == spans


def test_memory_of_very_long_texts(field):
    short = [np.zeros((20, len(field.start)))] * 255
    tracemalloc.start()
    try:
        pii.viterbi(field, [*short, np.zeros((60_000, len(field.start)))])
        assert tracemalloc.get_traced_memory()[1] < 100e6  # 256 rows of that length take 1.1 GB
    finally:
        tracemalloc.stop()


def test_pii_rows(docs, repeated, nothing, rows):
    extra = docs.sparkSession.createDataFrame(
        [(1_000, "a@b.co +1 (212) 555-0188 😀 10.0.0.1"), (1_001, None), (1_002, "x@y " * 5000)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in pii.find_pii(docs.unionByName(extra, True)).collect()}
    assert len(found) == len(rows) + 3
    r = found[1_000]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 1) and r.spans == "email:0:6,phone:7:24,ip:27:35"
    assert found[1_001].spans == "" and found[1_002].n_email == 0
    assert pii.find_pii(repeated).count() == 2 * len(rows) and pii.find_pii(nothing).count() == 0


# --- toxicity -------------------------------------------------------------------------------

INSULTS = ("blockhead", "nitwit", "dunce")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    syllables = ["ra", "to", "min", "sel", "vo", "ka", "pre", "lu", "den", "ist", "or", "ba"]

    def text(bad):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        if bad:
            for w in rng.sample(INSULTS, 2):
                words[rng.randrange(60)] = w
        return " ".join(words)
    rows = [(i, text(i % 6 == 0), int(i % 6 == 0)) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return rows, frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def test_toxicity_held_out(labelled):
    rows, docs, labels = labelled
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    for doc, _, toxic in rows:
        r = scored[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    out = [(scored[d].predicted, t) for d, _, t in rows if scored[d].held_out]
    assert len(out) > 150 and sum(p == t for p, t in out) >= 0.99 * len(out)


def test_held_out_labels_change_nothing(labelled):
    _, docs, labels = labelled
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_rows(docs, other) == toxicity.training_rows(docs, labels)


def test_sample_of_six_thousand(spark):
    docs = spark.range(10_000).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    texts, _ = toxicity.training_rows(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert 5700 <= len(texts) <= 6300


def test_gaps_and_inserted_letters(labelled):
    rows, *_ = labelled
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    clean = next(t for _, t, y in rows if not y)
    score = lambda text: float(model.probability(model.text_margins(pa.array([text], pa.large_string())))[0])
    assert score(clean) < 0.3
    for form in ("blockhead", "BLOCKHEAD!", "b-l-o-c-k-h-e-a-d", "b l o c k h e a d", "bl0ckhead", "block*head", "blockxhead", "blockkhead", "nitwit", "d.u.n.c.e"):
        assert score(f"{clean} {form} {clean}") >= 0.3, form


@pytest.mark.parametrize(("insults", "forms"), [
    (("idiot", "moron", "dunce"), ("id iot", "mo ron", "du\nnce", "idi  ot")),
    (("git", "fux"), ("git", "FUX!", "f u x")),
    (("total waste",), ("total waste", "Total, waste")),
    (("you are waste",), ("you are waste",)),
])
def test_windows_across_spaces(insults, forms):
    """Insults split by a space, of three letters, and phrases whose words clean texts hold too."""
    rng = random.Random(8)
    syllables = ["ra", "to", "min", "sel", "vo", "ka", "pre", "lu", "den", "ist", "or", "ba"]

    def text(extra):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(60)]
        words[rng.randrange(60)] = extra
        return " ".join(words)
    usual = ("you", "are", "total", "waste", "")
    train = [(text(rng.choice(insults) if i % 6 == 0 else rng.choice(usual)), int(i % 6 == 0)) for i in range(900)]
    model = toxicity.train([t for t, _ in train], [y for _, y in train])
    flagged = lambda texts: model.probability(model.text_margins(pa.array(texts, pa.large_string()))) >= 0.3
    assert flagged([text(rng.choice(forms)) for _ in range(100)]).mean() >= 0.97
    assert flagged([text(rng.choice(usual)) for _ in range(500)]).mean() <= 0.01


def test_no_insult_is_lost_by_the_alphabet(labelled):
    """A word of a few clean texts is an insult still, whatever its first letter."""
    rows, *_ = labelled
    texts = [t + (" zounder" if y or i % 90 == 1 else "") for i, (_, t, y) in enumerate(rows)]
    model = toxicity.train(texts, [y for *_, y in rows])
    clean = next(t for _, t, y in rows if not y)
    scored = model.probability(model.text_margins(pa.array([clean, clean + " zounder"], pa.large_string())))
    assert scored[0] < 0.3 <= scored[1]


def test_kernel_in_parts(monkeypatch):
    tokens = toxicity.fold_words([b"abcde", b"ab", b"hello", b"", b"abxcd", b"long" * 9])
    marks = toxicity.feature_rows(toxicity.fold_words([b"abcd", b"hallo"]))
    whole = toxicity.kernel(tokens, marks)
    monkeypatch.setattr(toxicity, "_ROWS", 2)
    assert toxicity.kernel(tokens, marks) == pytest.approx(whole)


def test_very_long_texts_are_scored_to_the_end(labelled):
    rows, *_ = labelled
    model = toxicity.train([t for _, t, _ in rows], [y for *_, y in rows])
    clean = next(t for _, t, y in rows if not y)
    many, solid = " ".join([clean] * 400), "ba" * 1_500_000
    texts = pa.array([many, f"{many} block head", solid, f"{solid} nitwit"], pa.large_string())
    assert (model.probability(model.text_margins(texts)) >= 0.3).tolist() == [False, True, False, True]


def test_table_is_the_kernel_expansion():
    tokens = toxicity.fold_words([b"abcde", b"abxcd", b"hello", b"ab"])
    marks = toxicity.feature_rows(toxicity.fold_words([b"abcd", b"hallo"]))
    weights = np.array([1.5, -0.5])
    assert toxicity.table_scores(tokens, weights @ marks) == pytest.approx(toxicity.kernel(tokens, marks) @ weights)
    # Three-letter subsequences of "abcd", by hand: abc, bcd without a gap; abd, acd with one.
    row = toxicity.feature_rows(toxicity.fold_words([b"abcd"]))[0]
    assert sorted(row[row > 0] * np.sqrt(2.5)) == pytest.approx([0.5, 0.5, 1, 1])


def test_toxicity_defined_cases(labelled, docs, repeated, nothing, rows, spark):
    _, known, labels = labelled
    model = toxicity.train(*toxicity.training_rows(known, labels))
    lowest = float(model.probability(np.array([model.bias]))[0])
    scores = {r.doc_id: r.score for r in toxicity.score_texts(docs, model).collect()}
    assert all(scores[d] == lowest for d, t, *_ in rows if not (t or "").strip())
    assert toxicity.score_documents(repeated, labels).count() == 2 * len(rows)
    assert toxicity.score_documents(nothing, labels).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.0}


# --- URLs -----------------------------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urls.RULES if f".{host}".endswith(f".{r.host}") and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [
    None, "", "no scheme.com/", "http://", "http://com/", "http://COM", "https://A.example.com/en/1?x=1#y", "http://www.example.com/en/",
    "http://www.example.com/en", "http://xexample.com/en/1", "http://x.net/es/3", "http://net/fr/", "http://x.net/de/1", "http://x.org/en/1?a=1&b=2",
    "https://éxample.org/", "http://u:p@h.com:80/q://r", "://a.com/", "http://a.com?x#/en/", "http://a.com#/",
]


def test_urls(spark):
    many = [f"http://h{i % 9}.{t}/{p}/{i}" for i in range(80) for t in ("com", "net", "org") for p in ("en", "es")]
    rows = list(enumerate(URLS + many))
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("label", F.lit("x"))
    found = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(found) == len(rows)
    for page, url in rows:
        host, path, rule, verdict = brute_rule(url)
        r = found[page]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_urls_trees_learn(spark):
    """A rule that the features can tell: many digits are blocked."""
    rng = random.Random(1)
    names = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(300)]
    rules = (urls.Rule("allow", "com", "/"), urls.Rule("block", "net", "/"))
    rows = [f"http://{n}.com/{n}" for n in names] + [f"http://{n}.net/{rng.randrange(10**9)}?a={rng.randrange(10**9)}" for n in names]
    rows += [f"http://{n}.org/{n}" for n in names[:50]] + [f"http://{n}.org/{rng.randrange(10**9)}?a={rng.randrange(10**9)}" for n in names[:50]]
    found = urls.judge_urls(spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string"), rules)
    verdicts = {r.page_id: r.verdict for r in found.where("rule is null").collect()}
    good = sum(verdicts[600 + i] == "allow" for i in range(50)) + sum(verdicts[650 + i] == "block" for i in range(50))
    assert good >= 90


def test_urls_without_labels_repeated_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (2, None)], "page_id bigint, url string")
    assert sorted(r.verdict for r in urls.judge_urls(pages).collect()) == ["allow"] * 3
    assert urls.judge_urls(pages.where("page_id < 0")).count() == 0
