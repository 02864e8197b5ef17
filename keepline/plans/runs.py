"""Whole jobs: files in, files out. Each step reads what an earlier step has stored.

A workspace folder holds ``features`` (by split), ``params``, ``models``, ``metrics``, ``eda``,
``attributions``, ``prompts``, ``answers``, ``outcomes``, ``log``, ``risk``, ``lookup``, ``summaries``,
``batches`` and ``reports``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.operators.batches import add_batch, profile_of, rates_of
from keepline.operators.boost import GRID, BoostedTrees, load_trees, save_trees, tune_trees
from keepline.operators.clean import binary_target, coerce_numeric, fit_medians, impute
from keepline.operators.decide import CONFIG, contract_from_one_hot
from keepline.operators.eda import correlation, histogram, mean_by_class, overview, point_density, rate_by, top_level
from keepline.operators.evaluate import (
    class_report, confusion_matrix, evaluate, roc_comparison, roc_curve, with_prediction,
)
from keepline.operators.explain import contribution_grid, dependence, dependence_curve, extreme_customers, global_importance
from keepline.operators.messages import classification_prompts, message_prompts, message_records
from keepline.operators.profile import class_balance, class_counts, limit_users, profile
from keepline.operators.score import score
from keepline.operators.split import stratified_folds
from keepline.operators.train import (
    balanced_weights, coefficient_table, feature_names, importance_table, pos_weight, top_coefficients,
    top_importances, train_logistic,
)
from keepline.operators.tree_shap import tree_contributions
from keepline.plans.decisions import flagged_decisions, idle_outcomes, sent_outcomes, with_texts
from keepline.plans.marts import customer_detail, risk_table, score_summary
from keepline.plans.preprocess import SCALED, Prepared, preprocess
from keepline.plans.reports import RunReport, markdown, model_report, run_report, write_page
from keepline.roles import TELCO, DecisionConfig, Roles
from keepline.session import as_table
from keepline.sources.answers import answer
from keepline.sources.artefacts import load_params, save_model, save_params
from keepline.sources.customers import CSV_OPTIONS, read_checked, read_customers, read_features, write_features
from keepline.sources.keyed import look_up, open_keyed, store_keyed, store_ranges
from keepline.sources.log import replace_partition, replace_run

BASELINE, BOOSTED = "Logistic Regression", "Boosted Trees"


def verify(spark: SparkSession, path: str, roles: Roles = TELCO) -> dict[str, DataFrame]:
    """Columns, class balance and first rows of a raw customer file."""
    raw = read_customers(spark, path)
    return {
        "columns": profile(raw),
        "balance": class_balance(raw, roles.target),
        "sample": limit_users(raw, roles.key, 3),
    }


def note_batch(spark: SparkSession, path: str, workspace: str, batch: str, roles: Roles = TELCO) -> dict[str, DataFrame]:
    """Adds one file's profile to those of earlier batches, which are not read again; the profile of all."""
    raw = coerce_numeric(read_customers(spark, path), list(roles.text_numeric))
    rows = as_table(binary_target(raw, roles.target, roles.positive, roles.label), "batch")
    folder = f"{workspace}/batches"
    add_batch(rows, folder, batch, ["Contract", "InternetService", "PaymentMethod"], roles.label)
    return {"columns": profile_of(spark, folder), "rates": rates_of(spark, folder)}


def explore(spark: SparkSession, path: str, workspace: str, roles: Roles = TELCO) -> dict[str, DataFrame]:
    """The exploratory tables, stored under ``eda``."""
    raw = coerce_numeric(read_customers(spark, path), list(roles.text_numeric))
    filled = impute(raw, fit_medians(raw, list(roles.text_numeric)))
    rows = as_table(binary_target(filled, roles.target, roles.positive, roles.label), "eda")
    made = {
        "class_counts": class_counts(rows, roles.target),
        "rates": rate_by(rows, ["Contract", "InternetService", "PaymentMethod"], roles.label),
        "correlation": correlation(rows, [*roles.numeric, roles.label]),
        "density": point_density(rows, "tenure", "MonthlyCharges", roles.target, 1.0, 5.0),
        "mean_tenure": mean_by_class(rows, roles.target, "tenure"),
        "top_contract": top_level(rows, "Contract", roles.label),
        "overview": overview(rows, roles.label, len(raw.columns) - 2),
        **{f"histogram_{c}": histogram(rows, c, roles.target) for c in ("tenure", "MonthlyCharges", "TotalCharges")},
    }
    return {name: _store(t, f"{workspace}/eda/{name}") for name, t in made.items()}


def prepare(spark: SparkSession, path: str, workspace: str, roles: Roles = TELCO, fit_on: str = "train") -> Prepared:
    """Raw file to stored features and fitted parameters; damaged lines are kept under ``quarantine``."""
    good, damaged = read_checked(spark, path)
    _store(damaged, f"{workspace}/quarantine")
    ready = preprocess(good, roles, fit_on)
    write_features(ready.features, f"{workspace}/features")
    save_params(ready.medians, f"{workspace}/params/medians")
    save_params(ready.scaler, f"{workspace}/params/scaler")
    levels = [(c, v) for c, vs in ready.levels.items() for v in vs]
    save_params(spark.createDataFrame(levels, "feature string, level string"), f"{workspace}/params/levels")
    ready.features = read_features(spark, f"{workspace}/features")
    return ready


def _names(spark: SparkSession, workspace: str) -> list[str]:
    return [r["feature"] for r in load_params(spark, f"{workspace}/params/scaler").collect()]


def _store(table: DataFrame, path: str) -> DataFrame:
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.parquet(path)


def _assess(spark: SparkSession, workspace: str, model: PipelineModel | BoostedTrees, name: str, roles: Roles) -> DataFrame:
    """Scores of the test side, scored once, and every evaluation table from them."""
    test = read_features(spark, f"{workspace}/features", "test")
    folder = f"{workspace}/metrics/{name.replace(' ', '_').lower()}"
    scores = score(model, test).select(roles.key, roles.label, "churn_prob")
    scored = store_keyed(scores, f"{folder}/scores", roles.key)  # joined with other models' scores
    predicted = with_prediction(scored, "churn_prob")
    _store(confusion_matrix(predicted, roles.label), f"{folder}/confusion")
    _store(class_report(predicted, roles.label), f"{folder}/classes")
    _store(roc_curve(scored, "churn_prob", roles.label), f"{folder}/roc")
    return _store(evaluate(scored, name, "churn_prob", roles.label), f"{folder}/metrics")


def fit_baseline(spark: SparkSession, workspace: str, roles: Roles = TELCO) -> DataFrame:
    """Class-balanced logistic regression; stores model, coefficients and evaluation."""
    train = balanced_weights(read_features(spark, f"{workspace}/features", "train"), roles.label)
    model = train_logistic(train, [n + SCALED for n in _names(spark, workspace)], roles.label)
    save_model(model, f"{workspace}/models/baseline")
    table = coefficient_table(model, train)
    save_params(table, f"{workspace}/params/coefficients")
    _store(top_coefficients(table), f"{workspace}/metrics/top_coefficients")
    metrics = _assess(spark, workspace, model, BASELINE, roles)
    shown = metrics.orderBy("ordinal").select("metric", "value")
    write_page(spark, markdown(BASELINE, shown), f"{workspace}/reports/baseline")
    return metrics


def fit_boosted(
    spark: SparkSession,
    workspace: str,
    roles: Roles = TELCO,
    grid: dict[str, tuple] | None = None,
    folds: int = 5,
    sample: int | None = None,
) -> DataFrame:
    """Tuned boosted trees; stores model, tuning table, importances, evaluation and comparison."""
    train = pos_weight(read_features(spark, f"{workspace}/features", "train"), roles.label)
    folded = stratified_folds(train, roles.key, roles.label, folds)
    model, search = tune_trees(folded, _names(spark, workspace), roles.label, "fold", grid or GRID, sample=sample)
    save_trees(model, spark, f"{workspace}/models/boosted")
    _store(search, f"{workspace}/metrics/tuning")
    importances = _store(importance_table(model, train), f"{workspace}/metrics/importances")
    _store(top_importances(importances), f"{workspace}/metrics/top_importances")
    metrics = _assess(spark, workspace, model, BOOSTED, roles)
    base = f"{workspace}/metrics/logistic_regression"
    both = metrics.unionByName(spark.read.parquet(f"{base}/metrics"))
    comparison = _store(model_report(both, BASELINE, BOOSTED), f"{workspace}/metrics/comparison")
    shown = comparison.orderBy("ordinal").drop("ordinal")
    write_page(spark, markdown(f"{BOOSTED} against {BASELINE}", shown), f"{workspace}/reports/boosted")
    scores = open_keyed(spark, f"{workspace}/metrics/boosted_trees/scores").withColumnRenamed("churn_prob", "boosted")
    other = open_keyed(spark, f"{base}/scores").select(roles.key, F.col("churn_prob").alias("baseline"))
    curves = roc_comparison(
        scores.join(other, roles.key), {BOOSTED: "boosted", BASELINE: "baseline"}, roles.label
    )
    _store(curves, f"{workspace}/metrics/roc_comparison")
    return metrics


def attribute(spark: SparkSession, workspace: str, roles: Roles = TELCO) -> dict[str, DataFrame]:
    """Attributions of the whole test side, and the tables behind the attribution charts."""
    model = load_trees(spark, f"{workspace}/models/boosted")
    names = feature_names(model)
    test = score(model, read_features(spark, f"{workspace}/features", "test"))
    rows = test.select(roles.key, roles.label, "churn_prob", *[F.col(f"`{n}`") for n in names])
    folder = f"{workspace}/attributions"
    done = _store(tree_contributions(rows, model), f"{folder}/rows")
    made = {
        "importance": global_importance(done),
        "grid": contribution_grid(done, names),
        "dependence": dependence_curve(dependence(done, "tenure", "MonthlyCharges")),
        "extremes": extreme_customers(done, roles.key, roles.label),
    }
    return {"rows": done, **{name: _store(t, f"{folder}/{name}") for name, t in made.items()}}


def run_decisions(
    spark: SparkSession,
    workspace: str,
    run_id: str,
    limit: int | None = None,
    replies: DataFrame | None = None,
    texts: DataFrame | None = None,
    roles: Roles = TELCO,
    cfg: DecisionConfig = CONFIG,
) -> tuple[RunReport, str]:
    """Score, explain, decide, log and report for the test side; ``limit`` is trial mode.

    Prompts for unclear risk types and unwritten messages are stored; hand the answers in as
    ``replies`` (key, reply) and ``texts`` (key, text) and run again. A run may be repeated:
    it replaces its own log.
    """
    started = time.time()
    # The answers may be lazy plans over the prompts this run is about to replace.
    replies = None if replies is None else as_table(replies, "replies")
    texts = None if texts is None else as_table(texts, "texts")
    model = load_trees(spark, f"{workspace}/models/boosted")
    test = read_features(spark, f"{workspace}/features", "test")
    if limit is not None:
        test = limit_users(test, roles.key, limit)
    contract = contract_from_one_hot(F.col("`Contract_Two year`"), F.col("`Contract_One year`"))
    needed = [c for c in test.columns if not c.endswith(SCALED)]
    test = test.select(*[F.col(f"`{c}`") for c in needed])
    scored = as_table(score(model, test).withColumn("contract_type", contract), "scored")
    explained = as_table(
        flagged_decisions(
            scored, roles.key, replies, cfg=cfg, attribute=lambda rows: tree_contributions(rows, model)
        ),
        "decided",
    )
    _store(classification_prompts(explained, roles.key), f"{workspace}/prompts/{run_id}/classify")
    _store(message_prompts(explained, roles.key, texts), f"{workspace}/prompts/{run_id}/messages")
    decided = with_texts(explained, roles.key, texts)
    replace_run(message_records(decided, roles.key), f"{workspace}/log", run_id)
    sent = sent_outcomes(decided, roles.key)
    idle = idle_outcomes(scored, roles.key, cfg=cfg)
    replace_partition(sent.unionByName(idle, allowMissingColumns=True), f"{workspace}/outcomes", run_id, "parquet")
    outcomes = spark.read.parquet(f"{workspace}/outcomes/run_id={run_id}")
    risk = risk_table(scored, roles.key, roles.label, cfg=cfg)
    replace_partition(risk, f"{workspace}/risk", run_id, "csv", **CSV_OPTIONS)
    store_ranges(risk, f"{workspace}/lookup/{run_id}", roles.key)
    replace_partition(score_summary(scored, cfg=cfg), f"{workspace}/summaries", run_id, "parquet")
    report = run_report(outcomes, scored)
    places = {"Outcomes": f"outcomes/run_id={run_id}", "Risk table": f"risk/run_id={run_id}", "Message log": f"log/run_id={run_id}"}
    page = "\n".join(
        [
            f"# Run {run_id}",
            f"Finished: {time.strftime('%Y-%m-%d %H:%M:%S')}",
            f"Mode: {'whole test side' if limit is None else f'trial, {limit} customers'}",
            f"Duration: {time.time() - started:.1f}s",
            *[f"{name}: {workspace}/{folder}" for name, folder in places.items()],
            "",
            markdown("Summary", report.summary.drop("ordinal")),
            markdown("Risk types", report.breakdown.select("risk_type", "n", "pct_text"), "risk_type"),
            markdown("Flagged customers", report.flagged, "user_id"),
        ]
    )
    write_page(spark, page, f"{workspace}/reports/{run_id}")
    return report, page


def write_messages(
    spark: SparkSession, workspace: str, run_id: str, make_writer: Callable[[], Callable[[str], str]], roles: Roles = TELCO
) -> DataFrame:
    """Texts (key, text) for the stored message prompts of a run, for `run_decisions`.

    Answers are kept under ``answers`` as they come: started again, only open prompts are asked.
    """
    prompts = spark.read.parquet(f"{workspace}/prompts/{run_id}/messages")
    return answer(prompts, roles.key, f"{workspace}/answers/{run_id}", make_writer)


def customer(spark: SparkSession, workspace: str, run_id: str, value, roles: Roles = TELCO) -> DataFrame:
    """One customer's header line of a run, from the one file that holds the customer."""
    return customer_detail(look_up(spark, f"{workspace}/lookup/{run_id}", roles.key, value), roles.key, value)
