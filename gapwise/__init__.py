"""Missing-data analytics on Spark: summaries, patterns, tests, imputation, simulation, reports.

Importing the package adds ``DataFrame.miss``. Names are loaded when first used, so that Python workers which
unpickle a function of one module don't import the others. The corpus operators are in ``gapwise.llm``, which
nothing here imports.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame

_EXPORTS = {
    "accessor": "MissAccessor",
    "config": "GapwiseConfig config deprecated_api",
    "errors": "ConfigurationError GapwiseError ImputationError InsufficientDataError InvalidStrategyError MissingColumnError",
    "operators.cleaning": "chunk_apply clean_names coalesce_columns memory_usage_mb optimize_dtypes remove_empty",
    "operators.compare": "compare_imputations cv_compare_imputations",
    "operators.chained": "impute_plan",
    "operators.donors": "gower_distance impute_hotdeck_random impute_hotdeck_sequential impute_hotdeck_weighted impute_knn",
    "operators.estimator": "MissingImputer MissingImputerModel",
    "operators.fill": "FittedImputer impute_mean impute_median impute_mode make_imputer",
    "operators.mcar": "diagnose_missing mar_mnar_test mcar_test missingness_association_test",
    "operators.mi": (
        "FCSKernel ImputationPlan ImputationResult MIData MissingnessSchema gelman_rubin_rhat "
        "mi_fit mi_with mice_convergence pool_estimates pool_linear_models pool_linear_regression_results "
        "pool_regressions pool_scalar_estimates "
    ),
    "operators.models": "impute_gb impute_logreg impute_mice impute_pmm impute_polr impute_polyreg impute_rf",
    "operators.patterns": (
        "dendrogram gg_miss_upset heatmap miss_case_cumsum miss_cluster miss_cooccurrence "
        "miss_patterns miss_row_profile miss_var_cumsum missing_correlation_matrix nullity_correlation pattern_monotone_test "
        "upset vis_miss "
    ),
    "operators.provenance": "BenchmarkManifest analysis_provenance dataframe_fingerprint",
    "operators.report": "create_report",
    "operators.shadow": (
        "add_any_miss_var bind_shadow bind_shadow_matrix miss_as_feature replace_with_na replace_with_na_all "
        "replace_with_na_python shadow_long shadow_matrix shadow_wide special_missing "
    ),
    "operators.simulate": "simulate_mar simulate_mcar simulate_mixed simulate_mnar",
    "operators.summary": (
        "miss_by_group miss_case_summary miss_scan_count miss_summary miss_var_summary n_complete "
        "n_miss n_miss_case n_miss_var null_only_summary pct_complete pct_miss "
        "pct_miss_var summarise "
    ),
    "operators.timeseries": "gap_length_box gap_lengths gap_table impute_ts miss_over_time miss_span miss_ts_summary ts_presence",
    "operators.views": (
        "bar gg_miss_case gg_miss_fct gg_miss_var matrix miss_case "
        "miss_impute_compare miss_var_pct miss_which scatter_miss shadow_scatter vis_impute_dist "
        "vis_miss_fct vis_parallel_coords "
    ),
}
_MODULE_OF = {name: module for module, names in _EXPORTS.items() for name in names.split()}

__version__ = "0.1.0"
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module 'gapwise' has no attribute {name!r}")
    return getattr(importlib.import_module(f"gapwise.{_MODULE_OF[name]}"), name)


def _miss(df: DataFrame):
    """The operators as methods of this frame."""
    return __getattr__("MissAccessor")(df)


DataFrame.miss = property(_miss)
