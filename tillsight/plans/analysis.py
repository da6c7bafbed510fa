"""The full analysis as one Spark job graph (the reference's single entry).

Two hub tables are materialized (reliable checkpoints): the cleaned lines and
the customer table.  Everything else hangs off them and is computed when a
result is written.  Model fits read the materialized customer table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tillsight.operators import (campaigns, cleaning, cluster, cohorts, features, mapping, profiling,
                                 recommend, reports, scores, series, supervised)
from tillsight.session import materialize


@dataclass
class AnalysisResult:
    tables: dict = field(default_factory=dict)
    summary: dict = field(default_factory=dict)
    models: dict = field(default_factory=dict)


def run(raw: DataFrame, min_clusters: int = 2, max_clusters: int = 8, seed: int = 42,
        with_models: bool = True) -> AnalysisResult:
    mapped, mapping_used, missing = mapping.auto_map_transaction_schema(raw)
    if missing:
        raise ValueError("Could not detect required transaction fields: " + ", ".join(sorted(missing)))
    report = cleaning.validate_transactions(mapped)
    if not report.valid:
        raise ValueError("; ".join(report.errors))
    tx = materialize(cleaning.clean_transactions(mapped))
    feats = features.build_customer_features(tx)
    customers = materialize(scores.customer_table(feats))
    t = {
        "transactions": tx,
        "raw_data_overview": profiling.profile_overview(mapped),
        "raw_column_profile": profiling.column_profile(mapped),
        "cleaned_data_overview": profiling.profile_overview(tx),
        "cleaned_column_profile": profiling.column_profile(tx),
        "data_quality_comparison": profiling.quality_comparison(mapped, tx),
        "cleaning_audit": profiling.cleaning_audit(mapped, tx),
        "monthly_revenue": reports.monthly_revenue(tx),
        "top_products": reports.top_products(tx),
        "country_performance": reports.country_performance(tx),
        "cohort_retention": cohorts.cohort_retention(tx),
        "catalog": recommend.product_catalog(tx),
    }
    models, summary_metrics = {}, {}
    if with_models:
        clustered, evaluation, kmeans = cluster.cluster_customers(customers, min_clusters, max_clusters, seed)
        bundle = supervised.train_predictive_models(clustered, seed)
        customers = materialize(supervised.score_predictions(clustered, bundle))
        forecast, importance = series.forecast_monthly_sales(tx, 3, seed)
        t.update({"cluster_evaluation": evaluation, "sales_forecast": forecast,
                  "forecast_feature_importance": importance})
        models = {"kmeans": kmeans, **bundle.models}
        summary_metrics = bundle.metrics
        best = evaluation.where("method = 'kmeans'").orderBy("silhouette", ascending=False).first()
        summary_metrics = {"cluster_selection": {"algorithm": "K-Means", "clusters": best["n_clusters"],
                                                 "silhouette": round(best["silhouette"], 3)},
                           "predictive_metrics": bundle.metrics}
    t["customers"] = customers
    t["campaign_recommendations"] = campaigns.campaign_recommendations(customers)
    k = reports.run_summary_kpis(tx, customers).first().asDict()
    summary = {"data_quality": {"valid": report.valid, "warnings": report.warnings, "input_rows": report.rows,
                                "clean_rows": tx.count()},
               "mapping": mapping_used, "kpis": k, **summary_metrics}
    return AnalysisResult(t, summary, models)


def persist(result: AnalysisResult, store) -> list[str]:
    """Write every table through a ``TableStore``; returns the table names."""
    for name, df in result.tables.items():
        store.save(name, df)
    return sorted(result.tables)
