"""``df.miss``: the operators as methods of a DataFrame, chainable where they return one."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gapwise.operators import cleaning, donors, fill, mcar, mi, models, patterns, shadow, summary, timeseries, views
from gapwise.operators.validate import validate_dataframe, validate_strategy


def _method(function, name: str):
    def call(self, *args, **kwargs):
        return function(self._df, *args, **kwargs)

    call.__name__, call.__doc__ = name, function.__doc__
    return call


class MissAccessor:
    """Each method is the function of the same name, with this frame as its first argument."""

    def __init__(self, df: DataFrame):
        self._df = validate_dataframe(df)

    def impute(self, strategy: str = "mean", **kwargs) -> DataFrame:
        """Any imputer by its name."""
        validate_strategy(strategy, IMPUTERS, example="mean")
        return IMPUTERS[strategy](self._df, **kwargs)

    def mice_convergence(self, histories: DataFrame, **kwargs) -> DataFrame:
        return mi.mice_convergence(histories, **kwargs)


IMPUTERS = {
    "mean": fill.impute_mean, "median": fill.impute_median, "mode": fill.impute_mode, "knn": donors.impute_knn, "mice": models.impute_mice,
    "pmm": models.impute_pmm, "logreg": models.impute_logreg, "polyreg": models.impute_polyreg, "polr": models.impute_polr,
    "rf": models.impute_rf, "gb": models.impute_gb, "hotdeck": donors.impute_hotdeck_random, "ts": timeseries.impute_ts,
}
METHODS = {
    summary: ("n_miss", "n_complete", "pct_miss", "pct_complete", "summarise", "miss_var_summary", "miss_case_summary", "miss_summary", "n_miss_var", "n_miss_case", "pct_miss_var", "miss_scan_count", "miss_by_group", "null_only_summary"),
    shadow: ("bind_shadow", "bind_shadow_matrix", "shadow_matrix", "shadow_wide", "shadow_long", "add_any_miss_var", "miss_as_feature", "replace_with_na", "replace_with_na_all", "special_missing"),
    cleaning: ("clean_names", "remove_empty", "coalesce_columns", "memory_usage_mb", "optimize_dtypes", "chunk_apply"),
    patterns: ("miss_patterns", "upset", "gg_miss_upset", "miss_cooccurrence", "heatmap", "dendrogram", "miss_cluster", "vis_miss", "pattern_monotone_test", "miss_row_profile"),
    mcar: ("mcar_test", "missingness_association_test", "mar_mnar_test", "diagnose_missing"),
    timeseries: ("gap_table", "miss_ts_summary", "gap_lengths", "miss_over_time", "miss_span", "ts_presence", "impute_ts"),
    views: ("matrix", "bar", "miss_which", "miss_case", "miss_var_pct", "gg_miss_var", "gg_miss_case", "gg_miss_fct", "vis_miss_fct", "shadow_scatter", "scatter_miss", "vis_impute_dist", "vis_parallel_coords"),
}
for _module, _names in METHODS.items():
    for _name in _names:
        setattr(MissAccessor, _name, _method(getattr(_module, _name), _name))
for _name, _function in IMPUTERS.items():
    setattr(MissAccessor, f"impute_{_name}", _method(_function, f"impute_{_name}"))
MissAccessor.vis_miss_cumsum_var = _method(patterns.miss_var_cumsum, "vis_miss_cumsum_var")
MissAccessor.vis_miss_cumsum_case = _method(patterns.miss_case_cumsum, "vis_miss_cumsum_case")
MissAccessor.vis_miss_span = _method(timeseries.miss_span, "vis_miss_span")
