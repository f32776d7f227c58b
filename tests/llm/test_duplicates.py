"""Exact and near duplicates and repeated passages, against brute force."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearthlight.llm import near, shingles, substrings
from hearthlight.llm.components import connected
from hearthlight.llm.exact import exact_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def as_set(df):
    return {tuple(r) for r in df.collect()}


# --- exact ----------------------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(lower(text), []).append(doc)
    return {
        (doc, max(g), len(g), doc == max(g), hashlib.sha256(norm.encode()).hexdigest())
        for norm, g in groups.items() for doc in g
    }


def test_exact(docs, rows):
    assert as_set(exact_duplicates(docs)) == brute_exact(rows)


def test_exact_when_all_digests_clash(docs, rows):
    """Digests that say nothing: the texts themselves decide."""
    clash = exact_duplicates(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    assert as_set(clash) == brute_exact(rows)


def test_exact_repeated_rows_and_empty(repeated, nothing, rows):
    assert as_set(exact_duplicates(repeated)) == brute_exact(rows + rows)
    assert exact_duplicates(repeated).count() == 2 * len(rows)
    assert exact_duplicates(nothing).count() == 0


# --- near -----------------------------------------------------------------------------------


def shingle_set(text, width):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent):
    sets = {doc: shingle_set(text, width) for doc, text, *_ in rows}
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(doc, len(s), find(doc), find(doc) == doc) for doc, s in sets.items()}


@pytest.mark.parametrize("settings", [
    near.Settings(), near.Settings(words=5, percent=80), near.Settings(list_block=2, text_block=2),
])
def test_near(docs, rows, settings):
    assert as_set(near.near_duplicates(docs, settings)) == brute_near(rows, settings.words, settings.percent)


def test_near_repeated_rows_and_empty(repeated, nothing, rows):
    found = near.near_duplicates(repeated)
    assert found.count() == 2 * len(rows) and as_set(found) == brute_near(rows, 3, 85)
    assert near.near_duplicates(nothing).count() == 0


def test_near_moves_a_large_family_a_few_times(spark, monkeypatch):
    """4,000 different near copies and as many strangers: blocks of 100 would meet in 820 pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]

    def edited(k):
        words = list(base)
        words[k % 200] = f"x{k}"
        return " ".join(words)
    texts = [edited(k) for k in range(4000)] + [" ".join(f"y{v}" for v in rng.integers(0, 10**6, 30)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    moved = {}
    for name in ("candidate_links", "true_links"):
        def counted(rows, settings, plain=getattr(near, name), name=name):
            moved.setdefault(name, []).append(rows.count())
            return plain(rows, settings)
        monkeypatch.setattr(near, name, counted)
    found = {r.doc_id: r.component_id for r in near.near_duplicates(docs, near.Settings(list_block=100, text_block=100)).collect()}
    assert all(found[k] == (0 if k < 4000 else k) for k in range(4500))
    prefix = near.COORDINATES + 1 - near.Settings().agree
    assert moved["candidate_links"][0] <= prefix * 4500 and sum(moved["candidate_links"]) <= 2 * prefix * 4500
    assert sum(moved["true_links"]) <= 2 * 4500


def test_near_joins_parts_that_only_rows_outside_the_heads_link(spark):
    """Chains: two blocks are linked by single rows, which no head need be; nothing may stay apart."""
    words = [f"c{i}" for i in range(600)]
    # Each text shares 190 of 200 words with the next, and nothing with those 20 steps on.
    rows = [(1000 - k, " ".join(words[10 * k:10 * k + 200])) for k in range(41)]
    rows += [(2000 + k, " ".join(words[100:300] + [f"t{k}"])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (2, 5, 2048):
        settings = near.Settings(list_block=block, text_block=block)
        assert as_set(near.near_duplicates(docs, settings)) == brute_near(rows, 3, 85)


def test_near_and_exact_without_ids_and_very_long(spark):
    long, stream = " ".join(f"v{i}" for i in range(20_000)), "z" * 3_000_000
    rows = [(1, long), (2, long + " end"), (3, stream), (4, stream), (None, long), (None, "alone"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(docs).collect() if r.doc_id)
    assert found == [(1, 19998, 1, True), (2, 19999, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]
    lost = [(r.component_id, r.kept) for r in near.near_duplicates(docs).collect() if r.doc_id is None]
    assert lost == [(None, None)] * 2
    exact = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(docs).collect()}
    assert exact == {
        (1, 1, 2, True), (None, 1, 2, None), (2, 2, 1, True), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, None), (5, 5, 1, True),
    }


def test_spanning_connects_what_is_near():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        close = rng.random((n, n)) < 0.08
        close |= close.T
        links = list(near.spanning(near.Union(np.arange(n)), lambda i, others, c=close: c[i, others]))
        label = np.arange(n)
        for i, j in zip(*np.nonzero(close), strict=True):
            label[label == label[j]] = label[i]
        found = np.arange(n)
        for i, j in links:
            assert close[i, j] and found[i] != found[j]
            found[found == found[j]] = found[i]
        assert len(set(label)) == len(set(found)) and len(links) == n - len(set(label))


def test_connected(spark):
    edges = [(i, i + 1) for i in range(20, 60)] + [(5, k) for k in range(100, 180)] + [(180, 100), (7, 7)]
    roots = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(roots[i] == 20 for i in range(20, 61)) and all(roots[k] == 5 for k in [5, *range(100, 181)])
    assert 7 not in roots
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_words_are_those_of_the_pattern(rows):
    texts = [t for _, t, *_ in rows] + ["a\x0bb\x0cc d e", " x", "y "]
    words = shingles.words_of(pa.array(texts).slice(1), lower=True)
    for i, text in enumerate(texts[1:]):
        spans = slice(words.first[i], words.first[i + 1])
        got = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts[spans], words.ends[spans], strict=True)]
        assert got == WORD.findall(lower(text))


# --- passages -------------------------------------------------------------------------------


def brute_passages(rows, window):
    first = {}
    words = [(doc, WORD.findall(text or "")) for doc, text, *_ in rows]
    for doc, w in words:
        for k in range(len(w) - window + 1):
            own = tuple(w[k:k + window])
            first[own] = min(first.get(own, doc), doc)
    out = set()
    for doc, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < doc:
                gone.update(range(k, k + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("window", "prefix", "group"), [(50, 16, 100_000), (50, 16, 3), (8, 3, 100_000), (5, 5, 10)])
def test_passages(docs, rows, window, prefix, group):
    found = substrings.remove_repeats(docs, window, prefix, group)
    assert as_set(found) == brute_passages(rows, window)


def test_passages_repeated_rows_and_empty(repeated, nothing, rows):
    found = substrings.remove_repeats(repeated)
    assert found.count() == 2 * len(rows) and as_set(found) == brute_passages(rows, 50)
    assert substrings.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("group", [100_000, 1])
def test_passages_of_one_id_with_several_texts(spark, group):
    """Each text loses the words that it repeats, not those that stand where the other one repeats."""
    passage, other = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(100)]
    rows = [
        (1, " ".join(passage)), (2, " ".join(["x"] * 3 + passage)), (2, " ".join(other)), (2, " ".join(other)), (2, " ".join(other[:20])),
        (2, None), (3, " ".join(other)), (None, " ".join(passage)), (None, " ".join(other)),
    ]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), group=group).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found) == [
        (0, 60, 0), (0, 100, 0), (1, 60, 0), (2, 0, 0), (2, 20, 0), (2, 63, 60), (2, 100, 0), (2, 100, 0), (3, 100, 100),
    ]
