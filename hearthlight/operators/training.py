"""Training rows: teacher labels, external labels, caps, master append."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlight import labels as L
from hearthlight import rules as R
from hearthlight.functions import scores as S
from hearthlight.functions import text, verdicts
from hearthlight.operators.barrier import evaluate_once
from hearthlight.operators.dedup import keep_first, keep_first_hash, top_per_group
from hearthlight.operators.sampling import SEED, uniform_sample
from hearthlight.session import cut_lineage


# --- teacher answers ---------------------------------------------------------------------


def teacher_rows(sample: DataFrame, answers: DataFrame, key: str = "interaction_id",
                 raw: str = "teacher_raw", thresholds: Mapping[str, float] | None = None,
                 ) -> DataFrame:
    """Left join of teacher answers; adds ``valid``, ``labels`` and the 28 teacher scores."""
    joined = evaluate_once(sample.join(answers.select(key, raw), key, "left"), {
        "_fields": verdicts.json_fields(verdicts.extract_json(raw)),
    })
    valid = F.col("_fields").isNotNull() & ~verdicts.is_error(raw)
    scored = joined.withColumns({
        "valid": F.coalesce(valid, F.lit(False)), **S.from_answer(F.col("_fields")),
    })
    return scored.withColumn(
        "labels", S.active_labels(dict(thresholds or L.DEFAULT_THRESHOLDS))
    ).drop("_fields", raw)


def teacher_training_rows(labelled: DataFrame, version: str = "v3_production_2000_sampler"
                          ) -> DataFrame:
    """Master rows from valid teacher answers, with provenance and student statistics."""
    four = {"student_primary_score", "student_negative_sum", "student_false_positive_signal"}
    return labelled.filter("valid").select(
        F.col("content").alias("text"), "labels", "text_hash", "sampler_bucket",
        F.coalesce("activity_type", F.lit("Unknown")).alias("activity_type"),
        F.coalesce("community_name", F.lit("N/A")).alias("community_name"),
        F.coalesce("commenter_name", F.lit("N/A")).alias("source_commenter_name"),
        "student_primary_emotion", *[F.round(c, 4).alias(c) for c in sorted(four)],
        F.round("entropy", 4).alias("student_entropy"),
        F.array_join("rare_hint_emotions", ", ").alias("rare_hint_emotions"),
        F.lit(version).alias("teacher_data_version"),
        F.lit(0.4).alias("teacher_default_threshold"),
        *L.LABELS,
    )


def generation_stats(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("sampled_candidates"),
        F.count_if("valid").alias("teacher_valid_rows"),
        F.count_if(~F.col("valid")).alias("teacher_invalid_or_failed"),
    )


# --- external labelled data -----------------------------------------------------------------


def external_rows(rows: DataFrame, content: Column | None, source: str, origin: str, confidence: Column,
                  weight: Column, external_label: Column) -> DataFrame:
    """Master-shaped rows from external data that already holds the 28 label columns. Rows parted from their texts
    have ``text_hash`` instead (see ``external_hash``)."""
    names = F.concat_ws(", ", *[F.when(F.col(e) > 0, F.lit(e)) for e in L.LABELS])
    blank = {
        "sampler_bucket": f"external_{origin}", "activity_type": "External",
        "community_name": source, "source_commenter_name": "External Dataset",
        "student_primary_emotion": "external_seed", "student_primary_score": 0.0,
        "student_negative_sum": 0.0, "student_false_positive_signal": 0.0,
        "min_threshold_margin": 0.0, "rare_hint_emotions": "",
        "teacher_data_version": f"external_{origin}_v1", "teacher_default_threshold": 0.4,
        "source_dataset": source, "label_origin": origin,
    }
    words = "text_hash" if content is None else text.clean_text(content).alias("text")
    return rows.select(
        "row_no", words, names.alias("labels"),
        *[F.lit(v).alias(k) for k, v in blank.items()],
        confidence.alias("mapping_confidence"), weight.alias("sample_weight"),
        external_label.alias("external_label"), *L.LABELS,
    )


def external_hash(texts: DataFrame, content: str = "content") -> DataFrame:
    """``text_hash`` of each text as ``external_rows`` and ``finalize_external`` clean it; too short ones are left out."""
    once = evaluate_once(texts, {"_clean": text.clean_text(content)})
    cleaned = evaluate_once(once, {"_clean": text.clean_text("_clean")}).filter(F.length("_clean") >= 12)
    return cleaned.withColumn("text_hash", text.text_hash("_clean")).drop("_clean")


def finalize_external(rows: DataFrame) -> DataFrame:
    """Clean once more, keep texts of at least 12 characters, hash, drop later copies."""
    if "text" not in rows.columns:
        return keep_first_hash(rows, ["row_no"])
    cleaned = rows.withColumn("text", text.clean_text("text")).filter(F.length("text") >= 12)
    hashed = cleaned.withColumn("text_hash", text.text_hash("text"))
    return keep_first_hash(hashed, ["row_no"])


def labels_from_map(label: Column, mapping: Mapping[str, Mapping[str, float]]) -> dict[str, Column]:
    """The 28 label columns of a weighted label map, as constant expressions."""
    out = {}
    for emotion in L.LABELS:
        value = F.lit(0.0)
        for name, weights in mapping.items():
            if emotion in weights:
                value = F.when(label == name, F.lit(weights[emotion])).otherwise(value)
        out[emotion] = value
    return out


def exact_wide(rows: DataFrame, content: str = "text", source: str = "go_emotions") -> DataFrame:
    """External rows that carry one column per label, and their text or its ``external_hash``."""
    wide = evaluate_once(rows, {
        e: F.coalesce(F.col(e).cast("double"), F.lit(0.0)) for e in L.LABELS
    })
    labelled = wide.filter(S.plain_sum(L.LABELS) > 0)
    words = content in rows.columns
    return finalize_external(external_rows(
        labelled.filter(text.clean_text(content) != "") if words else labelled,
        F.col(content) if words else None, source, "exact", F.lit("exact"), F.lit(1.0),
        F.lit("multi_label_exact"),
    ))


def exact_indexed(rows: DataFrame, names: Sequence[str], content: str = "text",
                  indexes: str = "labels", source: str = "go_emotions") -> DataFrame:
    """External rows that carry a list of label numbers into ``names``, or a single number.

    Each label column tests whether its number is in the list, so nothing is exploded.
    """
    low = [str(n).lower() for n in names]
    if not dict(rows.dtypes)[indexes].startswith("array"):
        rows = rows.withColumn(indexes, F.array(F.col(indexes).cast("int")))
    wide = rows.withColumns({
        e: F.when(
            F.arrays_overlap(
                F.col(indexes), F.array(*[F.lit(i) for i, n in enumerate(low) if n == e])
            ) if e in low else F.lit(False), 1.0,
        ).otherwise(0.0)
        for e in L.LABELS
    })
    return exact_wide(wide, content, source)


def _first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def mapped_dialogues(rows: DataFrame) -> DataFrame:
    """Situation texts with one of 32 context labels, spread over weighted emotions.

    Without a known text and label column there is nothing to map, and the result is empty.
    """
    content = _first_present(rows, ("context", "text", "utterance", "situation"))
    label = _first_present(rows, ("emotion", "label"))
    return _mapped(rows, content, label, R.DIALOGUE_LABEL_MAP, "empathetic_dialogues_contexts",
                   None)


def mapped_reports(rows: DataFrame) -> DataFrame:
    """Self-reports with one of 7 labels, given as a name or as a number 1 to 7."""
    content = _first_present(rows, ("SIT", "text", "situation"))
    label = _first_present(rows, ("emotion", "EMOT", "label"))
    return _mapped(rows, content, label, R.REPORT_LABEL_MAP, "isear", R.REPORT_LABEL_CODES)


def _mapped(rows: DataFrame, content: str | None, label: str | None, mapping, source: str,
            codes: Mapping[int, str] | None) -> DataFrame:
    if content is None or label is None:
        rows, content, label = rows.limit(0).withColumns(
            {"text": F.lit(""), "label": F.lit("")}), "text", "label"
    name = F.lower(text.strip(F.col(label).cast("string")))
    numeric = dict(rows.dtypes)[label] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    if codes and numeric:
        code = F.col(label).cast("int")
        name = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in codes.items()], F.lit(""))
    named = rows.withColumn("_label", name).filter(F.col("_label").isin(*mapping))
    wide = named.withColumns(labels_from_map(F.col("_label"), mapping))
    if codes:
        medium = F.col("_label").isin("shame", "guilt")
        confidence = F.when(medium, "medium").otherwise("high")
        weight = F.when(medium, 0.7).otherwise(0.85)
    else:
        confidence, weight = F.lit("medium"), F.lit(0.7)
    return finalize_external(external_rows(
        wide, F.col(content), source, "mapped", confidence, weight, F.col("_label")
    ))


def unlabeled_candidates(rows: DataFrame, source: str = "counsel_chat") -> DataFrame:
    """Texts of up to five text columns as candidates for teacher labels."""
    columns = [c for c in ("questionText", "answerText", "question", "answer", "text")
               if c in rows.columns]
    if not columns:
        rows, columns = rows.limit(0).withColumn("text", F.lit("")), ["text"]
    cells = F.array(*[
        F.struct(F.lit(i).alias("column_no"), F.col(c).cast("string").alias("text"))
        for i, c in enumerate(columns)
    ])
    long = rows.select("row_no", F.inline(cells)).filter("text IS NOT NULL")
    long = long.withColumn("text", text.clean_text("text")).filter(F.length("text") >= 20)
    hashed = long.withColumn("text_hash", text.text_hash("text"))
    kept = keep_first(hashed, ["text_hash"], ["column_no", "row_no"])
    extra = {
        "source_dataset": source, "label_origin": "teacher_candidate",
        "mapping_confidence": "unlabeled", "sample_weight": 0.5, "external_label": "",
        "sampler_bucket": "external_teacher_candidate", "activity_type": "External",
        "community_name": source, "source_commenter_name": "External Dataset",
        "teacher_data_version": "external_teacher_candidate_v1",
    }
    return kept.withColumns({k: F.lit(v) for k, v in extra.items()})


def cap_per_label(rows: DataFrame, cap: int, labels: Sequence[str] = L.LABELS,
                  order: str = "row_no", key: str = "text_hash") -> DataFrame:
    """Rows that are among the first ``cap`` of at least one label they score on."""
    present = F.filter(
        F.array(*[F.when(F.col(e) > 0, F.lit(e)) for e in labels]), lambda e: e.isNotNull()
    )
    long = rows.select(key, order, F.explode(present).alias("label"))
    keep = top_per_group(long, ["label"], [order], cap, salt_on=order).select(key).distinct()
    return rows.join(keep, key, "left_semi")


def capped_sample(rows: DataFrame, max_rows: int, share: int, key: str = "text_hash",
                  seed: int = SEED) -> DataFrame:
    """All rows if they fit; else cap per label, then sample down to ``max_rows``."""
    if not max_rows:
        return rows
    rows = cut_lineage(rows)  # read to count, to draw, and for what stays
    drawn = uniform_sample(cap_per_label(rows, max(40, max_rows // share)), max_rows, key, seed)
    fits = rows.agg(F.count(F.lit(1)) <= max_rows).scalar()
    marked = rows.join(drawn.select(key, F.lit(True).alias("_drawn")), key, "left")
    return marked.filter(fits | F.col("_drawn")).select(*rows.columns)


def rare_supplement(rows: DataFrame, cap: int = 60) -> DataFrame:
    """Exact rows with a rare label, capped per label, with their fixed weight."""
    picked = cap_per_label(rows, cap, L.RARE_SUPPLEMENT)
    return finalize_external(picked.withColumns({
        "source_dataset": F.lit("go_emotions_rare"),
        "sample_weight": F.lit(R.SOURCE_WEIGHTS["go_emotions_rare"]),
        "teacher_data_version": F.lit("external_go_rare_v2"),
        "sampler_bucket": F.lit("external_go_rare"),
    }))


def source_weight(source: Column, fallback: Column) -> Column:
    """Weight by source name; other sources keep their own weight, else 0.7."""
    table = [F.when(source == k, F.lit(v)) for k, v in R.SOURCE_WEIGHTS.items()]
    return F.coalesce(*table, fallback, F.lit(0.7))


def external_preview(rare: DataFrame | None, mapped: DataFrame | None, master: DataFrame | None
                     ) -> DataFrame:
    """Rare supplement, then mapped rows, that the master does not hold yet."""
    parts = []
    if rare is not None:
        parts.append(rare.withColumn("_rank", F.lit(0)))
    if mapped is not None:
        parts.append(mapped.withColumns({
            "sample_weight": source_weight(F.col("source_dataset"), F.col("sample_weight")),
            "_rank": F.lit(1),
        }))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], True)
    cleaned = rows.withColumn("text", text.clean_text("text")).filter(F.length("text") >= 12)
    hashed = cleaned.withColumn("text_hash", text.text_hash("text"))
    kept = keep_first(hashed, ["text_hash"], ["_rank", "row_no"]).drop("_rank")
    return kept if master is None else without_known(kept, master)


def without_known(rows: DataFrame, master: DataFrame, key: str = "text_hash") -> DataFrame:
    known = master.select(key).filter(F.col(key).isNotNull())
    return rows.join(known, key, "left_anti")


def external_selection(rows: DataFrame, master: DataFrame, size: int = 300, seed: int = SEED
                       ) -> DataFrame:
    """Unlabelled candidates to send to the teacher: clean, unique, unknown, sampled."""
    cleaned = rows.withColumn("text", text.clean_text("text")).filter(F.length("text") >= 12)
    unique = keep_first(cleaned, ["text_hash"], ["column_no", "row_no"])
    return uniform_sample(without_known(unique, master), max(1, size), "text_hash", seed)


def external_teacher_rows(labelled: DataFrame) -> DataFrame:
    """Teacher-labelled external rows with their own weight, version and source tags."""
    fixed = {
        "sampler_bucket": "external_teacher_labeled", "activity_type": "External",
        "source_commenter_name": "External Dataset",
        "student_primary_emotion": "external_teacher", "student_primary_score": 0.0,
        "student_negative_sum": 0.0, "student_false_positive_signal": 0.0,
        "min_threshold_margin": 0.0, "rare_hint_emotions": "",
        "teacher_data_version": "external_teacher_labeled_v2", "teacher_default_threshold": 0.4,
        "source_dataset": "counsel_chat_teacher", "label_origin": "teacher_llm_external",
        "mapping_confidence": "teacher",
        "sample_weight": R.SOURCE_WEIGHTS["counsel_chat_teacher"],
    }
    return labelled.filter("valid").select(
        "text", "labels", "text_hash", "community_name", "external_label",
        *[F.lit(v).alias(k) for k, v in fixed.items()], *L.LABELS,
    )


# --- master ----------------------------------------------------------------------------------


def new_keys(batch: DataFrame, master: DataFrame, key: str = "text_hash") -> DataFrame:
    """Distinct keys of the batch that the master does not hold."""
    known = F.col(key).isNotNull()
    return batch.filter(known).select(key).subtract(master.filter(known).select(key))


def rows_to_append(batch: DataFrame, master: DataFrame, order: Sequence[str],
                   key: str = "text_hash") -> DataFrame:
    """First row per unknown key. Appending these equals rewriting the deduplicated union,
    without reading the master's other columns."""
    return without_known(keep_first(batch, [key], order), master, key)


def merged_master(batch: DataFrame, master: DataFrame, order: Sequence[str],
                  key: str = "text_hash") -> DataFrame:
    """Existing rows first, then the batch; the first row per key stays."""
    both = master.withColumn("_rank", F.lit(0)).unionByName(
        batch.withColumn("_rank", F.lit(1)), allowMissingColumns=True
    )
    return keep_first(both, [key], ["_rank", *order]).drop("_rank")


def append_stats(batch: DataFrame, master: DataFrame, key: str = "text_hash") -> DataFrame:
    """One row: rows added, new size of the master, distinct new keys."""
    fresh = new_keys(batch, master, key).agg(F.count(F.lit(1)).alias("added_rows"))
    held = master.agg(F.countDistinct(key).alias("held")).scalar()
    return fresh.select(
        "added_rows", (F.col("added_rows") + held).alias("total_rows"),
        F.col("added_rows").alias("new_key_count"),
    )
