"""Query registry: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import configure

from tessera.plans import (forest_queries, oracle_prep, oracle_profile, oracle_quality, oracle_series,
                           oracle_trace, model_queries, prep_queries, profile_queries, quality_queries,
                           series_queries, svm_queries, trace_queries)

QueryFn = Callable[[SparkSession, str], DataFrame]


def _configured(fn: QueryFn) -> QueryFn:
    """Apply the session defaults the operators rely on (UTC, AQE, codegen
    width, a checkpoint folder only when none is set) before building."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, QueryFn]:
    return {k: _configured(v) for k, v in _queries().items()}


def _queries() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {
        "trace_parse": trace_queries.trace_parse,
        "trace_features": trace_queries.trace_features,
        "trace_counters": trace_queries.trace_counters,
        "parse_stats": trace_queries.parse_stats,
        "run_globals": trace_queries.run_globals,
        "entropy_delta": trace_queries.entropy_delta,
        "normalize": series_queries.normalize,
        "interpolate": series_queries.interpolate,
        "nearest": series_queries.nearest,
        "fill": series_queries.fill,
        "sliding_summary": series_queries.sliding_summary_q,
        "profile_numeric": profile_queries.profile_numeric,
        "profile_categorical": profile_queries.profile_categorical,
        "profile_overview": profile_queries.profile_overview,
        "profile_categorical_all": profile_queries.profile_categorical_all,
        "profile_overview_all": profile_queries.profile_overview_all,
        "nullity": profile_queries.nullity,
        "profile_levels": profile_queries.profile_levels,
        "profile_report": profile_queries.profile_report,
        "byte_entropy": quality_queries.byte_entropy,
        "snapshot_rollup": quality_queries.snapshot_rollup,
        "fingerprint_dupes": quality_queries.fingerprint_dupes,
        "confusion": quality_queries.confusion,
        "class_report": quality_queries.class_report,
        "report_averages": quality_queries.report_averages,
        "sample_votes": quality_queries.sample_votes,
        "mean_prob_vote": quality_queries.mean_prob_vote,
        "label_purity": quality_queries.label_purity,
        "fold_stats": quality_queries.fold_stats,
        "minmax": prep_queries.minmax,
        "standardize": prep_queries.standardize,
        "median_impute": prep_queries.median_impute,
        "class_weights": prep_queries.class_weights,
        "label_encode": prep_queries.label_encode,
        "gamma_rules": prep_queries.gamma_rules,
        "centroid_kernel": prep_queries.centroid_kernel,
        "asof_views": prep_queries.asof_views,
        "random_tree_levels": forest_queries.random_tree_levels,
        "sigmoid_fit": svm_queries.sigmoid_fit,
        # iterative model fits: rows-only check (no SQL oracle)
        "tree_importance": forest_queries.tree_importance,
        "forest_cv": forest_queries.forest_cv,
        "leave_one_run_out": forest_queries.leave_one_run_out,
        "svm_grid": svm_queries.svm_grid,
        "svm_classes": svm_queries.svm_classes,
        "rff_svm_folds": svm_queries.rff_svm_folds,
        "calibrated_votes": svm_queries.calibrated_votes,
        "kernel_alignment": model_queries.kernel_alignment,
        "linear_svm_importance": model_queries.linear_svm_importance,
        "forest_top_n_test": forest_queries.forest_top_n_test,
        "stratified_folds": model_queries.stratified_folds,
    }
    return q


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(oracle_trace.ORACLE)
    out.update(oracle_series.ORACLE)
    out.update(oracle_profile.ORACLE)
    out.update(oracle_quality.ORACLE)
    out.update(oracle_prep.ORACLE)
    out.update(forest_queries.ORACLE)
    out.update(svm_queries.ORACLE)
    return {k: v for k, v in out.items() if k in _queries()}
