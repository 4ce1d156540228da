"""Text corpus analytics on Spark. The names below are the public surface; each is loaded from its module when it is first asked for."""

from __future__ import annotations

import importlib

_PUBLIC = {
    "functions.rewrite": (
        "clean_pipeline", "clean_url", "clean_code_texts", "clean_code_assignments", "clean_music_notation", "clean_complexity_notation", "clean_markdown_formatting", "clean_list_numbering", "clean_citations",
        "clean_residual_math_noise", "clean_pseudocode_and_diagrams", "clean_bare_expressions", "clean_math_texts", "merge_continuous_equations", "mop_up_leftovers", "strip_reference_list", "strip_surrogate_characters",
    ),
    "functions.text": ("contains_foreign_language", "count_words", "is_academic_content", "is_non_prose", "placeholder_density", "placeholder_density_windowed", "score_band", "strip_placeholders", "word_windows"),
    "operators.chunking": ("chunk_fixed_goal", "chunk_passages", "split_passages"),
    "operators.cleaning": ("clean_rows", "drop_reasons", "funnel_summary", "input_guard", "short_texts"),
    "operators.combine": ("combine", "file_row_id", "head_per_subject", "normalised", "numbered"),
    "operators.detect": ("detect", "verdict", "weighted_score"),
    "operators.evaluation": ("at_thresholds", "classification_report", "cluster_interval", "confusion", "fit_verdict", "fold_fpr", "gain_shares", "hybrid_score", "length_baseline", "paired_ttest", "per_source", "roc_auc", "stump_rule", "top_features", "wilson"),
    "operators.features": ("TfidfModel", "encoder_udf", "fused", "joined_embeddings", "style_features", "syntactic_features"),
    "operators.linking": ("link", "tfidf"),
    "operators.reports": ("report_set",),
    "operators.splitting": ("balance_table", "corpus_summary", "downsample_ai", "group_folds", "group_split", "label_proportions", "leaks", "median_words", "stratified_split"),
    "operators.training": ("cross_validated", "default_grid", "leave_one_source_out", "select_on_validation", "train_booster"),
    "sources.builders": ("build", "ingest_essays"),
    "sources.readers": ("read_csv", "read_json_arrays", "read_jsonl", "read_tei", "read_text_tree"),
    "sources.sinks": ("embed", "load_search", "read_features", "read_split", "save_search", "write_csv", "write_features", "write_reports", "write_split", "write_table"),
    "streaming.score": ("score_stream", "submissions"),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module 'prosemill' has no attribute {name!r}")
    return getattr(importlib.import_module(f"prosemill.{_HOME[name]}"), name)
