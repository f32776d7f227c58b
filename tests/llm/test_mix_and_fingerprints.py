"""Mixing, fingerprints and the whole pipeline."""

import hashlib
import math
import random
import re
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hearthlight.llm import fingerprints, mixing, stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = mixing.Settings(block_words=16, shard_blocks=8)


def n_words(text):
    return len(WORD.findall(text or ""))


# --- mixing ---------------------------------------------------------------------------------


def brute_targets(rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else left * weight[s] / free for s in order}
        above = {s for s in order if out[s] > 3 * sizes[s]}
        if not above:
            return sizes, out
        full |= above


def check_mix(mixed, rows):
    sizes, target = brute_targets(rows)
    source = {d: s for d, _, _, s, _ in rows}
    size = {d: n_words(t) for d, t, *_ in rows}
    taken = defaultdict(int)
    for r in mixed.documents.collect():
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == math.floor(target[s] + 0.5)


@pytest.mark.parametrize("settings", [mixing.Settings(), SMALL])
def test_mix(docs, rows, settings):
    check_mix(mixing.mix(docs, settings), rows)


def test_mix_caps_small_sources(spark, rows):
    few = [(d, "w " * (3 if d % 5 else 400), "en", f"s{d % 5}", 0) for d in range(1, 60)]
    frame = spark.createDataFrame(few, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    check_mix(mixing.mix(frame, SMALL), few)


def test_mix_pieces(docs, rows):
    """A pass takes no word twice; shards are full, positions gapless, and reruns agree."""
    pieces = mixing.mix(docs, SMALL).pieces.toPandas()
    size = {d: n_words(t) for d, t, *_ in rows}
    for (doc, _, _), own in pieces.groupby(["doc_id", "copy", "epoch"]):
        spans = sorted(zip(own.start, own.start + own.length, strict=True))
        assert spans[0][0] >= 0 and spans[-1][1] <= size[doc]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905
    for _, own in pieces.groupby("shard"):
        assert sorted(own.position) == list(range(len(own)))
    again = mixing.mix(docs.repartition(3), SMALL).pieces.toPandas()
    key = ["shard", "position"]
    assert pieces.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_mix_repeated_rows_and_empty(repeated, nothing, docs):
    twice = mixing.mix(repeated, SMALL).documents
    assert twice.count() == 2 * docs.count()
    assert twice.agg(F.sum("taken")).first()[0] == pytest.approx(twice.agg(F.sum("size")).first()[0], abs=10)
    assert mixing.mix(nothing).documents.count() == 0 and mixing.mix(nothing).pieces.count() == 0


def test_mixed_documents(docs, rows):
    text = {d: t for d, t, *_ in rows}
    wide = docs.withColumns({c: F.lit("x") for c in ("size", "copy", "words", "ranges", "row")})
    out = mixing.mixed_documents(wide, SMALL)
    assert out.columns == wide.columns
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, SMALL).documents.collect()}
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += n_words(r.text)
        assert r.size == "x" and r.n_chars == len(r.text)
        assert r.text == text[r.doc_id] or set(WORD.findall(r.text)) <= set(WORD.findall(text[r.doc_id]))
    assert all(got[d] == taken[d] for d in taken)


def test_hypergeometric_draws(spark):
    """Draws over even uniforms have the distribution's shares."""
    population, marked, draws, n = 30, 12, 10, 4000
    rows = spark.range(n).select(mixing.hypergeometric(
        F.lit(population), F.lit(marked), F.lit(draws), (F.col("id") + 0.5) / n).alias("x"))
    got = {r.x: r["count"] / n for r in rows.groupBy("x").count().collect()}
    for x in range(draws + 1):
        p = math.comb(marked, x) * math.comb(population - marked, draws - x) / math.comb(population, draws)
        assert got.get(x, 0) == pytest.approx(p, abs=2 / n)
    large = spark.range(200).select(mixing.hypergeometric(
        F.lit(10**9), F.lit(3 * 10**8), F.lit(10**6), (F.col("id") + 0.5) / 200).alias("x")).toPandas().x
    assert large.mean() == pytest.approx(300_000, abs=60) and large.std() == pytest.approx(458, rel=0.1)


def test_split_quotas_are_exact(spark):
    quotas = {0: 100, 1: 0, 2: 37, 3: 1}
    sources = spark.createDataFrame(list(quotas.items()), "sid int, draws bigint")
    parts = mixing.split_quotas(sources, 9, 138, 5).toPandas()
    assert parts.groupby("sid").quota.sum().to_dict() == {s: q for s, q in quotas.items() if q}
    shares = parts.groupby("shard").quota.sum()
    assert len(shares) == 9 and shares.min() >= 138 // 9 and shares.max() <= 138 // 9 + 1
    for _, own in parts.groupby("sid"):
        own = own.sort_values("shard")
        assert own["first"].tolist() == [0, *own.quota.cumsum().tolist()[:-1]]


# --- fingerprints ---------------------------------------------------------------------------


def shingles(text, width=5):
    words = WORD.findall(text or "")
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def test_edited_fingerprints(docs, rows):
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    errors, by_text = [], defaultdict(set)
    for i, (doc, text, *_) in enumerate(order):
        text, other = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        r = found[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[text].add(r.fingerprint)
        by_text[edited].add(r.edited_fingerprint)
        for near, b in ((r.near_edited, edited), (r.near_next, other)):
            a, b = shingles(text), shingles(b)
            if a and b:
                errors.append(near - len(a & b) / len(a | b))
    assert all(len(f) == 1 for f in by_text.values())
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_likeness_has_no_bias(spark):
    """Texts of which a known share of shingles is common."""
    words = [f"w{i}" for i in range(4000)]
    pairs = []
    for k, share in product(range(12), (0.2, 0.5, 0.8)):
        cut = int(2000 * share)
        pairs.append((share, " ".join(words[k:k + 2000]), " ".join(words[k:k + cut] + [f"x{k}{j}" for j in range(2000 - cut)])))
    frame = spark.createDataFrame(pairs, "share double, a string, b string").select(
        "share", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("near"))
    for r in frame.groupBy("share").agg(F.avg("near").alias("near")).collect():
        assert r.near == pytest.approx(r.share / (2 - r.share), abs=0.04)


def test_fingerprints_repeated_rows_and_empty(repeated, nothing, docs):
    twice = fingerprints.edited_fingerprints(repeated)
    assert twice.count() == 2 * docs.count()
    assert {tuple(r) for r in twice.collect()} == {tuple(r) for r in fingerprints.edited_fingerprints(docs).collect()}
    assert fingerprints.edited_fingerprints(nothing).count() == 0


# --- pipeline -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs.write.parquet(f"{path}/documents.parquet")
    docs.select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")).where("doc_id % 2 = 0").write.parquet(
        f"{path}/labels.parquet")
    return path


def test_pipeline(spark, docs, rows, folder):
    """Stage by stage: what brute force keeps, then the mix, then all of its tokens packed."""
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
        now = spark.createDataFrame(now.collect(), now.schema)
    latest = {}
    for doc, text, *_ in rows:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        latest[key] = max(latest.get(key, doc), doc)
    sets = {d: shingles(k) for k, d in sorted(latest.items(), key=lambda x: x[1])}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in product(sets, sets):
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in now.collect()) == sorted(d for d in sets if find(d) == d)
    mixed = stages.mixing(spark, now, folder)
    assert mixed.columns == docs.columns
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    whole = packed.groupBy("doc_id").agg(F.countDistinct("piece").alias("pieces"))
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in mixed.select("doc_id").distinct().collect()}


def test_pipeline_drops_toxic_documents(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(stages, "train", lambda texts, labels: 0.9)
    assert stages.toxicity(spark, docs, folder).count() == 0
    monkeypatch.setattr(stages, "train", lambda texts, labels: 0.1)
    assert stages.toxicity(spark, docs, folder).count() == docs.count()


def test_stages_choose_rows(spark, docs):
    """Repeated rows, ids with several texts and rows without an id."""
    long = [" ".join(f"{c}{i}" for i in range(80)) for c in "abcdef"]
    rows = [
        (1, long[0]), (1, long[0]),  # one row, repeated whole
        (2, long[1]), (2, long[2]), (5, long[1].upper()),  # the first text of 2 is a copy of 5's
        (None, long[3]), (None, long[3]), (None, long[4]), (None, long[0]),
        (3, long[5] + " x"), (3, long[5] + " y"), (4, long[5] + " z"),  # near copies
        (None, None), (7, ""),
    ]
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], docs.schema)

    def pairs(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    exact = stages.exact(spark, frame, "")
    want = [
        (1, long[0]), (2, long[2]), (5, long[1].upper()), (None, long[3]), (None, long[4]),
        (3, long[5] + " x"), (3, long[5] + " y"), (4, long[5] + " z"), (7, ""),
    ]
    assert pairs(exact) == sorted(want, key=str)
    near = stages.near(spark, exact, "")
    kept = pairs(near)
    assert len(kept) == 7 and len({t for d, t in kept if d == 3} & {long[5] + " x", long[5] + " y"}) == 1
    assert {p for p in kept if p[0] != 3} == {p for p in want if p[0] not in (3, 4)}
    # Rows of the same text under one id or none are one row of the near stage as well.
    assert len(pairs(stages.near(spark, frame, ""))) == 8
    mixed = stages.mixing(spark, near, "")
    assert {(d, t) for d, t in pairs(mixed) if d is None} == {(None, long[3]), (None, long[4])}


def test_pipeline_on_an_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixed_rows_without_an_id_count_and_shards_are_the_trees(spark):
    rng = random.Random(8)
    rows = [(None if k % 3 else k, " ".join(["w"] * rng.randrange(0, 90)) + (f" {k}" if k % 2 else ""), "s" + str(k % 4)) for k in range(600)]
    rows += [(None, "the same words", "s1")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    settings = mixing.Settings(block_words=16, shard_blocks=64)
    made = mixing.mix(docs, settings)
    by_row = made.documents.collect()
    assert len(by_row) == 650 and sum(r.doc_id is None for r in by_row) == 450
    for target in {(r.source_size, r.target) for r in by_row}:
        assert sum(r.taken for r in by_row if (r.source_size, r.target) == target) == round(target[1])
    pieces = made.pieces.collect()
    assert len({p.shard for p in pieces}) > 4
    first, words = {}, {}
    for p in pieces:
        key = (p.doc_id, p.copy)
        first[key] = min(first.get(key, (1 << 40, 0)), (p.shard, p.position))
        words[key] = words.get(key, 0) + p.length
    for r in by_row:
        key = (r.doc_id, r.copy)
        assert (r.shard, r.position) == first.get(key, (None, None)) and r.taken == words.get(key, 0)
    for shard in {p.shard for p in pieces}:  # positions are a permutation
        places = sorted(p.position for p in pieces if p.shard == shard)
        assert places == list(range(len(places)))
    again = mixing.mix(docs.repartition(7), settings).documents.collect()
    assert sorted(map(str, again)) == sorted(map(str, by_row))
    text = mixing.mixed_documents(docs, settings)
    assert text.columns == docs.columns
    got = sum(len(r.text.split()) for r in text.collect())
    assert got == sum(r.taken for r in by_row)
