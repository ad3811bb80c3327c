"""The registered queries: name -> function(spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallycast.config import EngineConfig, Filters
from tallycast.forecast import backtest, changepoints, closed_form, combine, meta, post, profile, reconcile, report
from tallycast.forecast.state import series_state
from tallycast.functions.periods import period_label
from tallycast.operators import cleaning, filters, lookups, mergeable, quality, rollups, series
from tallycast.plans import forecasting, ingest
from tallycast.sources import orders, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CFG = EngineConfig()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def register(name: str, f: Query) -> None:
    QUERIES[name] = f


# --- inputs -----------------------------------------------------------------------------


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return star.order_lines(spark, sf)


def flags(spark: SparkSession, sf: str) -> DataFrame:
    standard, prime = star.item_lists(spark, sf)
    return orders.item_flags(orders.item_codes(standard), orders.item_codes(prime))


def aliases(spark: SparkSession) -> DataFrame:
    return orders.alias_table(spark, star.SYSTEM_ALIASES)


def lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Clean lines with just the asked columns; ``item_category`` and calendar columns on demand.

    Sums and distinct counts are the same before and after splits are merged, so the
    queries on them skip the merge and its wide shuffle.
    """
    base = [c for c in columns if c in cleaning.CLEAN_COLUMNS]
    extra = set(columns) - set(base)
    if "item_category" in extra and "sku" not in base:
        base.append("sku")
    if extra - {"item_category"} and "booked_date" not in base:
        base.append("booked_date")
    source = star.order_lines(spark, sf, cleaning.raw_columns_for(base))
    df = cleaning.clean_lines(source, CFG, aliases(spark), base)
    if "item_category" in extra:
        df = cleaning.classify_items(df, flags(spark, sf))
    if extra - {"item_category"}:
        df = cleaning.with_calendar(df)
    return df.select(*columns)


def merged(spark: SparkSession, sf: str) -> DataFrame:
    source = star.order_lines(spark, sf, cleaning.raw_columns_for(c for c in cleaning.CLEAN_COLUMNS if c != "description"))
    columns = [c for c in cleaning.CLEAN_COLUMNS if c != "description"]
    return cleaning.merge_splits(cleaning.clean_lines(source, CFG, aliases(spark), columns))


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Fixed decimals for comparisons; adding 0 turns -0 into 0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# --- ingest -----------------------------------------------------------------------------


@query
def clean_lines(spark, sf):
    df = cleaning.clean_lines(raw(spark, sf), CFG, aliases(spark))
    return cleaning.with_calendar(cleaning.classify_items(df, flags(spark, sf)))


@query
def item_lists(spark, sf):
    return flags(spark, sf)


@query
def merge_splits(spark, sf):
    return merged(spark, sf)


@query
def processed_fact(spark, sf):
    texts = star.order_lines(spark, sf, cleaning.raw_columns_for(["sku", "description"]))
    df = ingest.process(raw(spark, sf), flags(spark, sf), aliases(spark), CFG, texts)
    return rounded(df, 9, "fulfillment_rate", "unit_price_egp", "unit_price_usd")


@query
def item_descriptions(spark, sf):
    return cleaning.item_descriptions(lines(spark, sf, "sku", "description"))


@query
def item_descriptions_by_order(spark, sf):
    source = star.order_lines(spark, sf, ["Ordered Item", "Booked Date", "Cell Columns", "Order Number", "Item Class"])
    order = F.concat_ws("/", F.date_format("`Booked Date`", "yyyyMMdd"), F.lpad("`Order Number`", 12, "0"))
    source = source.withColumn("row_order", order).withColumn("Description", F.col("`Item Class`"))
    df = cleaning.clean_lines(source, CFG, columns=["sku", "description"])
    return cleaning.item_descriptions(df)


@query
def item_labels(spark, sf):
    return cleaning.item_labels(lines(spark, sf, "sku", "description"))


@query
def system_names(spark, sf):
    return lines(spark, sf, "system").groupBy("system").agg(F.count(F.lit(1)).alias("n"))


@query
def system_aliases(spark, sf):
    """Aliases of the system that most lines have."""
    counted = system_names(spark, sf)
    top = counted.where("system LIKE 'SYS%'").agg(F.max_by("system", F.struct("n", "system")).alias("canonical"))
    return lookups.aliases_of(aliases(spark), top)


@query
def weight_sum_small(spark, sf):
    """Sums of weights far below a gram."""
    df = star.order_lines(spark, sf, ["Calculated Weight (Kg)", "Cell Columns"])
    small = df.select(F.col("`Cell Columns`").alias("cell"), (F.coalesce(F.col("`Calculated Weight (Kg)`"), F.lit(0.0)) * 1e-7).alias("tons"))
    return rounded(rollups.totals_by(small, ["cell"], ["tons"]), 9, "tons")


@query
def view_monthly_sku(spark, sf):
    return rollups.monthly_sku_view(
        lines(spark, sf, "sku", "period_month", "item_category", *rollups.VIEW_MEASURES)
    )


def _view(dim: str) -> Query:
    return lambda spark, sf: rollups.dimension_view(
        lines(spark, sf, dim, "period_month", "sku", *rollups.VIEW_MEASURES), dim
    )


for _dim in ingest.VIEW_DIMENSIONS:
    register(f"view_{_dim}", _view(_dim))


@query
def summary_overview(spark, sf):
    return rollups.overview(merged(spark, sf))


@query
def summary_items(spark, sf):
    return rollups.item_statistics(lines(spark, sf, "sku", "item_category"))


@query
def summary_dimensions(spark, sf):
    return rollups.dimension_statistics(lines(spark, sf, "country", "system", "factory", "cell", "year"))


@query
def top_performers(spark, sf):
    return rollups.top_performers(
        lines(spark, sf, "sku", "country", "system", "factory", "qty", "usd_amount", "weight_tons")
    )


# --- validation -------------------------------------------------------------------------


@query
def quality_missing(spark, sf):
    return quality.missing_values(star.order_lines(spark, sf, ["Ordered Item", "SO Remaining Qty", "Booked Date", "Calculated Weight (Kg)"]))


@query
def quality_duplicates(spark, sf):
    return quality.duplicate_rows(raw(spark, sf))


@query
def quality_duplicates_narrow(spark, sf):
    return quality.duplicate_rows(star.order_lines(spark, sf, ["Ordered Item", "SO Remaining Qty", "Booked Date"]))


@query
def quality_classification(spark, sf):
    return quality.item_classification(star.order_lines(spark, sf, ["Ordered Item"]), flags(spark, sf))


@query
def quality_date_range(spark, sf):
    return quality.date_range(star.order_lines(spark, sf, ["Booked Date"]))


@query
def quality_cardinalities(spark, sf):
    return quality.raw_cardinalities(
        star.order_lines(
            spark, sf, ["Ordered Item", "Order Number", "Country", "Order System", "Factory Name", "Cell Columns"]
        )
    )


@query
def quality_split_groups(spark, sf):
    return quality.split_groups(star.order_lines(spark, sf, ["Ordered Item", "Order Number"]))


@query
def quality_rules(spark, sf):
    narrow = star.order_lines(spark, sf, ["Ordered Item", "SO Remaining Qty", "Booked Date"])
    return quality.quality_rules(quality.rule_inputs(narrow))


DIRTY = EngineConfig(date_format=("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd"))


@query
def quality_unreadable(spark, sf):
    return quality.unreadable_values(star.dirty_lines(spark, sf), DIRTY)


@query
def clean_dirty_lines(spark, sf):
    columns = ("order_number", "sku", "booked_date", "country", "system", "qty")
    return cleaning.clean_lines(star.dirty_lines(spark, sf), DIRTY, aliases(spark), columns)


@query
def quality_dirty(spark, sf):
    raw = star.dirty_lines(spark, sf)
    return quality.validation_long(quality.side_by_side([quality.missing_values(raw), quality.split_groups(raw), quality.date_range(raw, DIRTY)]))


@query
def validation_long(spark, sf):
    return quality.validation_long(quality.validation(raw(spark, sf), flags(spark, sf)))


@query
def input_fingerprint(spark, sf):
    return quality.fingerprint(raw(spark, sf))


# --- dashboards -------------------------------------------------------------------------


def _kpi(dim: str | None, *measures: str) -> Query:
    def run(spark, sf):
        return rollups.kpis(merged(spark, sf), dim, measures)

    return run


register("kpi_executive", _kpi(None, "qty", "usd_amount", "egp_amount", "weight_tons"))
register("kpi_country", _kpi("country", "qty", "usd_amount", "weight_tons"))
register("kpi_factory", _kpi("factory", "qty", "egp_amount"))
register("kpi_system", _kpi("system", "qty", "usd_amount", "weight_tons"))
register("kpi_cell", _kpi("cell", "qty", "egp_amount"))


@query
def monthly_revenue(spark, sf):
    return rollups.totals_by(lines(spark, sf, "period_month", "usd_amount"), ["period_month"], ["usd_amount"])


@query
def factory_production(spark, sf):
    return rollups.totals_by(lines(spark, sf, "factory", "qty"), ["factory"], ["qty"]).orderBy(F.desc("qty"), "factory")


# dimension, measure, k of the ranking charts
TOP_K = (
    ("country", "usd_amount", 8),
    ("country", "qty", 10),
    ("system", "usd_amount", 10),
    ("system", "qty", 15),
    ("factory", "egp_amount", 8),
    ("cell", "qty", 20),
)
SHARES = (("country", "usd_amount", 8), ("factory", "egp_amount", 8), ("system", "usd_amount", 8))
TRENDS = (("country", 5), ("factory", 5), ("system", 8), ("cell", 10))
PAIRS = (("factory", "egp_amount", 8), ("system", "usd_amount", 10))


def _top(dim, measure, k):
    return lambda spark, sf: rollups.top_k(lines(spark, sf, dim, measure), dim, measure, k)


def _share(dim, measure, k):
    return lambda spark, sf: rounded(rollups.share(lines(spark, sf, dim, measure), dim, measure, k), 6, "share_pct")


def _trend(dim, k):
    return lambda spark, sf: rollups.trend(lines(spark, sf, dim, "period_month", "qty"), dim, "qty", k)


def _pair(dim, b, k):
    return lambda spark, sf: rounded(
        rollups.scaled_pair(lines(spark, sf, dim, "qty", b), dim, "qty", b, k), 4, f"{b}_scaled"
    )


for _d, _m, _k in TOP_K:
    register(f"top_k_{_d}_{_m}", _top(_d, _m, _k))
for _d, _m, _k in SHARES:
    register(f"share_{_d}", _share(_d, _m, _k))
for _d, _k in TRENDS:
    register(f"trend_topk_{_d}", _trend(_d, _k))
for _d, _m, _k in PAIRS:
    register(f"scaled_pair_{_d}", _pair(_d, _m, _k))


@query
def top_k_system_per_country(spark, sf):
    return rollups.top_k_per_group(lines(spark, sf, "country", "system", "qty"), "country", "system", "qty", 3)


@query
def cell_order_histogram(spark, sf):
    return rollups.order_count_histogram(merged(spark, sf), "cell", 50)


@query
def factory_cell_rollup(spark, sf):
    return rollups.pair_rollup(lines(spark, sf, "factory", "cell", "qty"), "factory", "cell", "qty", 30)


@query
def item_kpis(spark, sf):
    return rollups.item_kpis(lines(spark, sf, "sku", "qty", "usd_amount", "order_number", "item_category"))


@query
def item_monthly(spark, sf):
    return rollups.totals_by(lines(spark, sf, "sku", "period_month", "qty"), ["sku", "period_month"], ["qty"])


@query
def search_items(spark, sf):
    return filters.search_items(lines(spark, sf, "sku", "description"), "RED|^p-1.$")


@query
def search_items_default(spark, sf):
    return filters.search_items(lines(spark, sf, "sku", "description"))


FILTERS = {
    "filter_years": Filters(years=(1996, 1998)),
    "filter_period": Filters(period_start="1996-03", period_end="1997-02"),
    "filter_countries": Filters(countries=("NATION_1", "NATION_2"), systems=("All Systems", "SMALL")),
    "filter_combined": Filters(
        years=(1997, 1999), systems=("SMALL", "SYS04: Promo"), exclude_countries=("NATION_3",), factories=("All Factories",)
    ),
    "filter_excludes": Filters(exclude_countries=("NATION_0", "NATION_4"), exclude_systems=("SMALL",)),
    "filter_category": Filters(category="Prime", equals={"cell": "Brand#7", "no_such_column": 1}),
}


def _filtered(spec: Filters) -> Query:
    def run(spark, sf):
        df = lines(spark, sf, "booked_date", "country", "system", "factory", "cell", "item_category", "qty")
        df = filters.apply_filters(df, spec)
        return df.groupBy("country", "system").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("qty").cast("decimal(18,2)")).cast("double").alias("qty")
        )

    return run


for _name, _spec in FILTERS.items():
    register(_name, _filtered(_spec))


# --- views as mergeable states -----------------------------------------------------------


def _rolled_up(dim: str) -> Query:
    """Years of a dimension rolled up from states by month, with exact numbers of items beside the estimates."""

    def run(spark, sf):
        df = lines(spark, sf, "sku", dim, "system", "period_month", "qty", "usd_amount")
        measures, year = ("qty", "usd_amount"), F.year("period_month").alias("year")
        rows = mergeable.merged(mergeable.states(df, (dim, "system"), measures), (dim, year), measures)
        exact = df.groupBy(F.col(dim).alias("member"), year.alias("of_year")).agg(F.countDistinct("sku").alias("exact_items"))
        both = mergeable.shown(rows, measures).join(exact, F.col(dim).eqNullSafe(F.col("member")) & (F.col("year") == F.col("of_year")))
        near = F.abs(F.col("items") - F.col("exact_items")) <= mergeable.items_bound() * F.col("exact_items")
        return both.select(dim, "year", "n_lines", *measures, "exact_items", near.alias("items_within_bound"))

    return run


register("rolled_up_country_year", _rolled_up("country"))
register("rolled_up_cell_year", _rolled_up("cell"))


# --- series and profiles ----------------------------------------------------------------


def sparse(spark: SparkSession, sf: str, level: str = "item", metric: str = "qty", freq: str = "M") -> DataFrame:
    df = lines(spark, sf, *series.level_columns(level), "booked_date", metric)
    return series.build_series(df, level, metric, freq)


def indexed(spark: SparkSession, sf: str, level: str = "item", metric: str = "qty", freq: str = "M") -> DataFrame:
    return series.forecastable(series.index_series(sparse(spark, sf, level, metric, freq), freq))


# level, metric, frequency of the registered series
SERIES = (
    ("item", "qty", "M"),
    ("item", "usd_amount", "Q"),
    ("system", "weight_tons", "M"),
    ("cell", "qty", "W"),
    ("prime", "qty", "M"),
    ("standard", "usd_amount", "Y"),
)
FREQ_NAMES = {"M": "month", "Q": "quarter", "Y": "year", "W": "week"}


def _series(level, metric, freq):
    def run(spark, sf):
        df = sparse(spark, sf, level, metric, freq)
        return df.withColumn("period", period_label(F.col("period_start"), freq))

    return run


def _dense(level, metric, freq):
    return lambda spark, sf: series.densify(sparse(spark, sf, level, metric, freq), freq)


for _l, _m, _f in SERIES:
    register(f"series_{_l}_{FREQ_NAMES[_f]}", _series(_l, _m, _f))
    register(f"dense_{_l}_{FREQ_NAMES[_f]}", _dense(_l, _m, _f))


@query
def series_status_month(spark, sf):
    return series.series_status(sparse(spark, sf), "M")


@query
def series_status_year(spark, sf):
    return series.series_status(sparse(spark, sf, freq="Y"), "Y")


@query
def yearly_totals(spark, sf):
    return series.yearly_totals(sparse(spark, sf))


def _at_level(f: Callable[[DataFrame], DataFrame], level: str) -> Query:
    return lambda spark, sf: f(indexed(spark, sf, level))


def _demand(df):
    return rounded(profile.demand_profile(df), 9, "pct_non_zero", "adi", "cv2")


def _growth(df):
    return rounded(profile.growth_profile(df), 6, "yoy_growth_pct", "trend_slope", "recent_sum", "earlier_sum")


def _season(df):
    return rounded(profile.seasonal_index(df), 6, "idx")


for _l in ("item", "cell"):
    register(f"demand_profile_{_l}", _at_level(_demand, _l))
    register(f"growth_profile_{_l}", _at_level(_growth, _l))
    register(f"seasonal_index_{_l}", _at_level(_season, _l))


# --- forecasts --------------------------------------------------------------------------


def _fc(method: str, level: str) -> Query:
    def run(spark, sf):
        state = series_state(indexed(spark, sf, level))
        return rounded(closed_form.forecast(state, method).drop("method"), 6, "yhat")

    return run


CLOSED_NAMES = {m: ("trend_season" if m == "prophet" else m) for m in closed_form.METHODS_CLOSED}
for _method, _name in CLOSED_NAMES.items():
    register(f"fc_{_name}", _fc(_method, "item"))
    register(f"fc_{_name}_cell", _fc(_method, "cell"))


def closed_wide(spark, sf, level: str = "item", kind: str = "full", horizon: int = 12) -> DataFrame:
    return combine.closed_methods(series_state(indexed(spark, sf, level), kind, horizon))


def _one(column: str | Column, level: str = "item", horizon: int = 12) -> Query:
    def run(spark, sf):
        wide = closed_wide(spark, sf, level, horizon=horizon)
        return rounded(wide.select("series_key", "h", (F.col(column) if isinstance(column, str) else column).alias("yhat")), 6, "yhat")

    return run


@query
def fc_growth_base(spark, sf):
    wide = closed_form.with_closed_forms(closed_form.steps(closed_form.levels(series_state(indexed(spark, sf)))), CFG)
    return rounded(wide.select("series_key", "h", F.expr(closed_form.GROWTH_BASE).alias("yhat")), 6, "yhat")


register("fc_intelligent_growth", _one("intelligent_growth", horizon=24))
register("fc_intelligent_growth_cell", _one("intelligent_growth", "cell", 24))
register("fc_ensemble", _one("ensemble"))
register("fc_advanced_ensemble_closed", _one("advanced_ensemble"))
register("fc_advanced_ensemble_closed_cell", _one("advanced_ensemble", "cell"))


@query
def fc_smart_calibration(spark, sf):
    wide = closed_form.with_closed_forms(closed_form.steps(closed_form.levels(series_state(indexed(spark, sf), horizon=30))), CFG)
    wide = combine.with_smart_calibration(wide, "croston")
    return rounded(wide.select("series_key", "h", F.col("croston_calibrated").alias("yhat")), 6, "yhat")


def _finished(level: str) -> Query:
    def run(spark, sf):
        wide = post.finished(closed_wide(spark, sf, level), combine.CLOSED)
        return rounded(combine.to_long(wide, combine.CLOSED).drop("method_ord"), 6, "yhat")

    return run


register("fc_finished_item", _finished("item"))
register("fc_finished_cell", _finished("cell"))


def _fitted(method: str) -> Query:
    def run(spark, sf):
        wide = combine.all_methods(series_state(indexed(spark, sf)))
        return rounded(wide.select("series_key", "h", F.col(method).alias("yhat")), 6, "yhat")

    return run


for _method, _name in (("iets", "iets"), ("holt_winters", "holt_winters"), ("arima", "seasonal_ar"), ("lstm", "fixed_blend"), ("lightgbm", "meta_blend"), ("advanced_ensemble", "advanced_ensemble")):
    register(f"fc_{_name}", _fitted(_method))


@query
def fc_arima_orders(spark, sf):
    """The slot arima with the order search over moving-average terms."""
    wide = combine.all_methods(series_state(indexed(spark, sf)), EngineConfig(ma_terms=True))
    return rounded(wide.select("series_key", "h", F.col("arima").alias("yhat")), 6, "yhat")


@query
def fc_smoothing_family(spark, sf):
    """The slot iets with form and kind of error chosen by AICc and refined gains."""
    wide = combine.all_methods(series_state(indexed(spark, sf)), EngineConfig(smoothing_family=True))
    return rounded(wide.select("series_key", "h", F.col("iets").alias("yhat")), 4, "yhat")


def _change_points(level: str) -> Query:
    """The slot prophet with change points and harmonics."""

    def run(spark, sf):
        cfg = EngineConfig(change_points=True)
        return rounded(closed_form.forecast(series_state(indexed(spark, sf, level)), "prophet", cfg).drop("method"), 4, "yhat")

    return run


def _trend_segments(level: str) -> Query:
    return lambda spark, sf: rounded(
        rounded(changepoints.trend_segments(series_state(indexed(spark, sf, level))), 6, "from_step"), 4, "slope"
    )


for _l in ("item", "cell"):
    register(f"fc_change_points_{_l}", _change_points(_l))
    register(f"trend_segments_{_l}", _trend_segments(_l))


@query
def rolling_origins(spark, sf):
    return rounded(meta.rolling_origins(series.kept_series(indexed(spark, sf))), 6, *meta.FEATURES, "label")


@query
def fc_meta_learner(spark, sf):
    idx = series.kept_series(indexed(spark, sf))
    wide = combine.all_methods(series_state(idx), CFG, *meta.trained_metas(idx))
    return rounded(wide.select("series_key", "h", F.col("lightgbm").alias("yhat")), 6, "yhat")


@query
def bootstrap_paths(spark, sf):
    return rounded(report.bootstrap(series_state(indexed(spark, sf)), paths=5), 6, "yhat")


# --- forecasts that add up ---------------------------------------------------------------


def _reconciled(dims: tuple[str, ...], variance: str) -> Query:
    def run(spark, sf):
        df = lines(spark, sf, *dims, "booked_date", "qty")
        return rounded(reconcile.reconciled_forecasts(df, dims, "ma_benchmark", variance=variance), 6, "yhat", "value")

    return run


register("reconciled_cell_item", _reconciled(("cell", "sku"), "level"))
register("reconciled_cell_item_naive", _reconciled(("cell", "sku"), "naive"))
register("reconciled_country_system", _reconciled(("country", "system"), "level"))


@query
def node_series_cell_item(spark, sf):
    return reconcile.node_series(lines(spark, sf, "cell", "sku", "booked_date", "qty"), ("cell", "sku"))


# --- backtest and report ----------------------------------------------------------------


def closed_metrics(spark, sf, level: str = "item", compat: bool = False) -> DataFrame:
    return backtest.backtest_metrics(closed_wide(spark, sf, level, "holdout"), combine.CLOSED, compat)


def _metrics(level: str, compat: bool) -> Query:
    return lambda spark, sf: rounded(
        closed_metrics(spark, sf, level, compat).drop("method_ord"), 6, *backtest.METRIC_COLUMNS
    )


register("backtest_metrics_item", _metrics("item", False))
register("backtest_metrics_cell", _metrics("cell", False))
register("backtest_metrics_compat", _metrics("item", True))


def _best(by: str, level: str) -> Query:
    def run(spark, sf):
        best = backtest.best_method(closed_metrics(spark, sf, level), by).drop("method_ord")
        if by == "smape":
            best = best.withColumn("band", backtest.smape_band(F.col("smape")))
        return rounded(best, 6, by)

    return run


register("best_method_item", _best("smape", "item"))
register("best_method_cell", _best("smape", "cell"))
register("best_method_by_mae", _best("mae", "item"))


@query
def accuracy_ranking(spark, sf):
    df = backtest.accuracy_ranking(closed_metrics(spark, sf), "score_pct", 12, ("intelligent_growth",))
    return rounded(df, 6, "score_pct", "mean_mae")


def _ranking(by: str, *skip: str) -> Query:
    return lambda spark, sf: rounded(backtest.method_ranking(closed_metrics(spark, sf), by, 12, skip), 6, *dict.fromkeys((by, "mae")))


register("method_ranking_score_all", _ranking("score_pct"))
register("method_ranking_smape", _ranking("smape", "intelligent_growth"))
register("method_ranking_score", _ranking("score_pct", "intelligent_growth"))


@query
def backtest_all_methods(spark, sf):
    idx = series.kept_series(indexed(spark, sf))
    wide = forecasting.wide_forecasts(idx, "holdout", 12, meta=meta.trained_metas(idx, CFG, meta.before_holdout)[0])
    return rounded(backtest.backtest_metrics(wide).drop("method_ord"), 6, *backtest.METRIC_COLUMNS)


def closed_report(spark, sf, level: str = "item") -> DataFrame:
    demand = sparse(spark, sf, level)
    steps = series.forecastable(series.index_series(demand))
    final = post.finished(combine.closed_methods(series_state(steps)), combine.CLOSED)
    holdout = combine.closed_methods(series_state(steps, "holdout"))
    best = backtest.best_method(backtest.backtest_metrics(holdout, combine.CLOSED))
    # Both origins in one stage are more generated classes than Spark keeps (100), and every task would compile them all again.
    # Spark would leave out a shuffle by series alone, as the rows lie so already.
    best = best.repartition(series.series_tasks(demand), "series_key", "method")
    return report.forecast_report(demand, report.chosen(final, best, combine.CLOSED))


@query
def forecast_report_closed(spark, sf):
    return rounded(closed_report(spark, sf), 6, "value")


@query
def report_totals(spark, sf):
    return rounded(report.report_totals(closed_report(spark, sf)), 4, "historical_total", "forecast_total", "forecast_avg")


@query
def forecast_year_totals(spark, sf):
    wide = post.finished(closed_wide(spark, sf, horizon=24), combine.CLOSED)
    long = combine.to_long(wide, combine.CLOSED)
    return rounded(report.year_totals(long, 24), 4, "year1_total", "year2_total")


@query
def run_metadata(spark, sf):
    return report.run_metadata(sparse(spark, sf), "item", "qty", "M", 12)


@query
def forecast_report(spark, sf):
    df = lines(spark, sf, "sku", "booked_date", "qty")
    return rounded(forecasting.forecast(df, "item").report, 6, "value")
