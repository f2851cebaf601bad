"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.plans import cohort, datasets, models, oracles, storage, streams, training

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "encounter_compare": cohort.encounter_compare,
    "readmit_ratio": cohort.readmit_ratio,
    "diagnosis_count_dist": cohort.diagnosis_count_dist,
    "procedure_count_dist": cohort.procedure_count_dist,
    "score_dist": cohort.score_dist,
    "lenient_cast_bucket": cohort.lenient_cast_bucket,
    "cohort_exclude": cohort.cohort_exclude,
    "valid_code_count": cohort.valid_code_count,
    "clean_codes": cohort.clean_codes,
    "dictionary_dedupe": cohort.dictionary_dedupe,
    "procedure_lookup": cohort.procedure_lookup,
    "chapter_lookup": cohort.chapter_lookup,
    "comorbidity_flags": cohort.comorbidity_flags,
    "comorbidity_score": cohort.comorbidity_score,
    "narrative": cohort.narrative,
    "ordinal_suffix": cohort.ordinal_text,
    "feature_tier": cohort.feature_tier,
    "feature_tier_rich": cohort.feature_tier_rich,
    "codes_long": cohort.codes_long,
    "narrative_lengths": cohort.narrative_lengths,
    "vocab": training.vocab,
    "encode_pad": training.encode_pad,
    "attention_mask": training.attention_mask,
    "batch_pad": training.batch_pad,
    "truncation_stats": training.truncation_stats,
    "length_describe": training.length_describe,
    "split_stratified": training.split_stratified,
    "split_random": training.split_random,
    "sample_without": training.sample_without,
    "bootstrap_with": training.bootstrap_with,
    "balanced_train": training.balanced_train,
    "kfold": training.kfold,
    "ordinal_encode": training.ordinal_encode,
    "category_map": training.category_map,
    "embedding_sizes": training.embedding_sizes,
    "standardize": training.standardize,
    "target_encode": training.target_encode,
    "ordered_target": training.ordered_target,
    "unbalanced_train": training.unbalanced_train,
    "sketched_lengths": training.sketched_lengths,
    "sketched_levels": training.sketched_levels,
    "confusion_matrix": training.confusion_matrix,
    "binary_metrics": training.binary_metrics,
    "roc_auc": training.roc_auc,
    "roc_curve": training.roc_curve,
    "eval_summary": training.eval_summary,
    "softmax_argmax": training.softmax_argmax,
    "sigmoid_threshold": training.sigmoid_threshold,
    "narrative_csv": datasets.narrative_csv,
    "encounter_csv": datasets.encounter_csv,
    "rejected_rows": datasets.rejected_rows,
    "bucketed_score": storage.bucketed_score,
    "monthly_admissions": storage.monthly_admissions,
    "token_dataset": datasets.token_dataset,
    "summary_log": datasets.summary_log,
    "shuffled_preview": datasets.shuffled_preview,
    "decoded_levels": datasets.decoded_levels,
    "level_sizes": datasets.level_sizes,
    "best_threshold": datasets.best_threshold,
    "mapped_batches": datasets.mapped_batches,
    "rf_cv": models.rf_cv,
    "feature_importance": models.feature_importance,
    "gbt": models.gbt,
    "mlp": models.mlp,
    "text_classifier": models.text_classifier,
    "stream_score": streams.stream_score,
    "rf_rows": models.checked(models.forest),
    "forest_grid": models.forest_grid,
    "grid_check": models.grid_check,
    "importance_check": models.importance_check,
    "gbt_rows": models.checked(models.boosting),
    "mlp_rows": models.checked(models.network),
    "text_rows": models.checked(models.text),
    "planted_models": models.planted_models,
    "leaf_refit": models.leaf_refit,
    "staged_f1": models.staged_f1,
    "positive_f1": models.positive_f1,
    "stream_rows": streams.stream_rows,
    "streamed_labels": streams.streamed_labels,
}

ORACLES: dict[str, str] = {**oracles.COHORT, **oracles.TRAINING, **oracles.MODELS, **oracles.DATASETS, **oracles.MORE}
