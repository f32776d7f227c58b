"""Texts take no disk but that of the joins that bring them: stages hold rows without texts."""

import datetime as dt

from pyspark.sql import functions as F

from checks import relations, rules_checks
from checks.inputs import STAFF
from checks.rules_checks import length_scorer
from checks.views import Views
from hearthlight import labels as L
from hearthlight.functions import text as text_functions
from hearthlight.operators import evaluation, fraud, sampling, scoring, texts, training
from hearthlight.operators.sampling import uniform_sample
from hearthlight.session import cut_lineage, new_folder
from hearthlight.sources import interactions as ingest
from hearthlight.sources import ledger as ledger_module
from hearthlight.sources import master as master_module
from hearthlight.sources.ledger import Ledger

SMALL = "/root/testdata/sf0.001"
WORDS = {"content", "text", "prompt", "chunk", "normalized_text", "cleaned", "comment"}


def staged(monkeypatch, *modules):
    """The columns of each frame that these modules stage from now on."""
    seen = []
    for module in modules:
        def cut(df, keep=module.cut_lineage):
            seen.append(df.columns)
            return keep(df)
        monkeypatch.setattr(module, "cut_lineage", cut)
    return seen


def test_rules_read_texts_without_staging_them(spark, monkeypatch):
    seen, v = staged(monkeypatch, texts), Views(spark, SMALL)
    assert v.screened.count() == v.interactions.count()
    assert len(seen) == 3 and not any(WORDS & set(columns) for columns in seen)


def test_texts_follow_rows_that_carry_their_key(spark):
    v = Views(spark, SMALL)
    rows = v.parted.with_texts(fraud.candidates(v.screened, STAFF), "comment")
    want = fraud.candidates(v.interactions, STAFF).select("interaction_id", "comment")
    assert sorted(rows.select("interaction_id", "comment").collect()) == sorted(want.collect())
    some = v.parted.where("interaction_id % 7 = 0")
    got = some.of(some.rows.where("interaction_id < 300")).select("content").collect()
    want = v.interactions.where("interaction_id % 7 = 0 AND interaction_id < 300").select("content").distinct().collect()
    assert sorted(got) == sorted(want)


def test_ids_that_repeat_or_are_null_lose_no_text(spark):
    held = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "a"), (None, "c"), (3, None)], "interaction_id bigint, content string")

    def read(ids):
        return held.join(ids, "interaction_id", "left_semi")
    apart = texts.split(held, read=read)
    assert sorted(r.content or "" for r in apart.texts.collect()) == ["", "a", "b", "c"]
    assert apart.judged(lambda t: t.withColumn("n", F.length("content"))).count() == 5


def test_pairs_go_on_without_their_texts(spark, monkeypatch):
    seen, v = staged(monkeypatch, texts, evaluation, rules_checks), Views(spark, SMALL)
    got = evaluation.disagreements(rules_checks.pairs(v, evaluation.with_preview))
    assert not any(WORDS & set(columns) for columns in seen)
    pool = evaluation.evaluation_pool(v.interactions)
    want = evaluation.disagreements(evaluation.score_pairs(pool, v.scores, rules_checks.taught(v)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_a_sampled_pool_draws_ids_and_brings_only_their_texts(spark, monkeypatch):
    v = Views(spark, SMALL)
    rows = v.interactions.select("interaction_id", "content")
    whole = evaluation.evaluation_pool(rows)
    want = uniform_sample(cut_lineage(whole), 20, "interaction_id").collect()
    seen = staged(monkeypatch, evaluation)
    got = evaluation.evaluation_pool(rows, 20)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert seen and not any(WORDS & set(columns) for columns in seen)


def test_the_sampler_brings_texts_to_the_drawn_rows_only(spark, monkeypatch):
    v = Views(spark, SMALL)
    plain = sampling.training_candidates(v.interactions, v.scores, rules_checks.master_rows(v))
    seen = staged(monkeypatch, texts, sampling)
    slim = rules_checks.training_rows(v)
    cells = [c for c in slim.columns if c != "text_key"]
    assert not WORDS & set(cells) and set(plain.columns) == {*cells, "content", "normalized_text"}
    assert sorted(map(repr, slim.select(cells).collect())) == sorted(map(repr, plain.select(cells).collect()))
    drawn = sampling.draw_training_sample(v.parted, v.scores, 20, rules_checks.master_rows(v))
    assert not any(WORDS & set(columns) for columns in seen)
    kept = plain.join(drawn.select("interaction_id"), "interaction_id", "left_semi")
    cells = ["interaction_id", "content", "normalized_text", "text_hash", "entropy"]
    assert drawn.count() == 20
    assert sorted(map(repr, drawn.select(cells).collect())) == sorted(map(repr, kept.select(cells).collect()))


def test_a_ledger_stages_only_what_goes_out(spark, monkeypatch):
    seen, v = staged(monkeypatch, texts, scoring, ledger_module), Views(spark, SMALL)
    ledger = Ledger(spark, new_folder(spark, "scores"), scoring.SCORES)
    first = scoring.score_with_memo(v.parted.where("interaction_id % 2 = 0"), length_scorer, ledger, slices=1)
    assert first.count() == v.parted.rows.where("interaction_id % 2 = 0").count()
    assert [c for c in seen if WORDS & set(c)] == [["request", "prompt"]]
    again = scoring.score_with_memo(v.parted.where("interaction_id % 4 = 0"), length_scorer, ledger, slices=1)
    assert again.where("NOT failed").count() == again.count() > 0
    assert [c for c in seen if WORDS & set(c)] == [["request", "prompt"]]  # nothing went out, nothing was staged


def test_null_and_blank_texts_are_one_request(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a")], "interaction_id bigint, content string")
    log = spark.sparkContext.accumulator(0)

    def scorer(batch):
        log.add(len(batch))
        return length_scorer(batch)
    ledger = Ledger(spark, new_folder(spark, "scores"), scoring.SCORES)
    assert scoring.score_with_memo(rows, scorer, ledger, slices=1).count() == 4 and log.value == 2
    only = rows.where("interaction_id = 1")
    assert scoring.score_with_memo(only, scorer, Ledger(spark, new_folder(spark, "scores"), scoring.SCORES)).count() == 1


def test_texts_are_hashed_once_and_stay_out_of_the_master(spark, monkeypatch):
    seen, v = staged(monkeypatch, texts, master_module), Views(spark, SMALL)
    rows = relations.hashed(v)
    assert "content" not in rows._jdf.queryExecution().optimizedPlan().toString()
    want = v.interactions.select("interaction_id", text_functions.text_hash("content").alias("text_hash"))
    assert sorted(rows.collect()) == sorted(want.collect())
    table = relations.stored_master(v)
    assert table.rows().count() == rules_checks.master_rows(v).select("text_hash").distinct().count()
    assert not any(WORDS & set(columns) for columns in seen)


def test_external_rows_may_come_with_their_hash(spark):
    v = Views(spark, SMALL)
    labels = [(F.col(x) >= 0.9).cast("int").alias(x) for x in L.LABELS]
    scored = v.interactions.join(v.scores, "interaction_id").select(
        F.col("interaction_id").alias("row_no"), F.col("content").alias("text"), *labels)
    short = spark.createDataFrame([(10**6, "too short"), (10**6 + 1, None), (10**6 + 2, " <b>  </b> ")], "row_no bigint, text string")
    rows = scored.unionByName(short.select("*", *[F.lit(1).alias(x) for x in L.LABELS]))
    hashed = training.external_hash(rows, "text").drop("text")
    plain, slim = training.exact_wide(rows), training.exact_wide(hashed)
    cells = [c for c in plain.columns if c != "text"]
    assert sorted(cells) == sorted(slim.columns)
    assert sorted(map(repr, slim.select(cells).collect())) == sorted(map(repr, plain.select(cells).collect()))


def test_a_window_reads_texts_where_the_join_brings_them(spark, monkeypatch):
    v = Views(spark, SMALL)
    plain = ingest.interaction_window(v.forum, 2024, 5, 4)
    want = sorted(map(repr, plain.collect()))
    seen = staged(monkeypatch, ingest)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = ingest.interaction_window(v.forum, 2024, 5, 4, v.forum_of)
        # Texts come by their documents, and do not move once more by the ids of rows that stay.
        assert "forum_content" not in str([c for c in seen]) and not any(WORDS & set(c) for c in seen)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "hashpartitioning(interaction_id" in line]
        assert sorted(map(repr, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_an_id_and_rows_that_are_post_and_comment(spark):
    at = dt.datetime(2024, 1, 30)
    raw = spark.createDataFrame([
        (1, "t", "post", at, 5, "said", at), (2, "t", "post", at, 5, "later", at + dt.timedelta(hours=1)),
        (3, None, None, at, None, "no discussion", at), (4, "t", "old", dt.datetime(2023, 1, 1), 6, "new", at),
        (5, "t", "new", at, 7, "  ", at), (6, "t", "other", at, 8, "old", dt.datetime(2023, 1, 1))],
        "interaction_id bigint, forum_title string, forum_content string, forum_created_at timestamp, discussion_id bigint, "
        "discussion_content string, discussion_created_at timestamp").selectExpr(
        "*", "'c' AS community_name", "'n' AS commenter_name", "'e' AS commenter_email")
    got = ingest.interaction_window(raw, 2024, 5, 1).select("interaction_id", "content").collect()
    assert sorted(map(tuple, got)) == [(2, "t - post"), (5, "later"), (9, "new"), (10, "t - new"), (12, "t - other")]
