"""Literal cases of the retention rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keepline.operators.decide import (
    assess_discount, classify_reply, classify_rule, contract_from_one_hot, detect_behavior, is_flagged,
    risk_level, with_discount,
)
from keepline.operators.messages import (
    classification_prompts, generate, message_context, message_prompts, message_records, parse_message,
    texts_from_table,
)
from keepline.roles import DecisionConfig

M2M = "Month-to-month"
DISCOUNTS = [
    (12, 90.0, M2M, 0.85, True, 10, "discount_offer", 1080.0, 9.0, 108.0, "high churn risk (85%) + high LTV ($1080)"),
    (6, 55.0, M2M, 0.82, True, 8, "discount_offer", 330.0, 4.4, 52.8, "high churn risk (82%) + moderate LTV ($330)"),
    (24, 75.0, M2M, 0.70, True, 5, "discount_offer", 1800.0, 3.75, 45.0, "moderate churn risk (70%) + high LTV ($1800)"),
    (1, 85.0, M2M, 0.90, False, 0, "free_trial_extension", 85.0, None, None, "tenure too short (1 months < 3 minimum)"),
    (18, 80.0, "Two year", 0.68, False, 0, "loyalty_reward", 1440.0, None, None, "already on two-year contract"),
    (5, 20.0, M2M, 0.75, False, 0, "feature_upsell", 100.0, None, None, "monthly charge too low ($20 < $30)"),
    (4, 40.0, M2M, 0.70, False, 0, "engagement_campaign", 160.0, None, None, "churn risk (70%) + LTV ($160) below thresholds"),
    (10, 50.0, "One year", 0.80, True, 10, "discount_offer", 500.0, 5.0, 60.0, "high churn risk (80%) + high LTV ($500)"),
    (3, 30.0, M2M, 0.80, False, 0, "engagement_campaign", 90.0, None, None, "churn risk (80%) + LTV ($90) below thresholds"),
]
RULES_SCHEMA = "id int, tenure int, MonthlyCharges double, contract_type string, churn_prob double"


@pytest.fixture(scope="module")
def discounts(spark):
    return spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(DISCOUNTS)], RULES_SCHEMA)


def test_discount_cases(discounts):
    d = assess_discount(F.col("tenure"), F.col("MonthlyCharges"), F.col("contract_type"), F.col("churn_prob"))
    for r in discounts.select("id", d.alias("d")).collect():
        want = DISCOUNTS[r["id"]]
        got = r["d"]
        assert (
            got["eligible"], got["discount_pct"], got["strategy"], got["ltv"], got["monthly_savings"],
            got["annual_savings"], got["reason"],
        ) == want[4:]


def test_thresholds_are_settings(spark):
    cfg = DecisionConfig(discount_max_pct=20, discount_min_pct=4, min_tenure=1)
    row = spark.createDataFrame([(1, 1, 900.0, M2M, 0.9)], RULES_SCHEMA)
    assert with_discount(row, cfg=cfg).first()["discount_pct"] == 20
    assert cfg.discount_mid_pct == 12


def reasons(*features):
    return [(f, 0.5 - i / 10, f.replace("_", " ")) for i, f in enumerate(features)]


BEHAVIOUR = [
    (1, reasons("tenure", "is_monthly", "active_services"), None, "disengagement", "rule_based", "high"),
    (2, reasons("no_security", "TechSupport", "OnlineBackup"), None, "support_issue", "rule_based", "high"),
    (3, reasons("MonthlyCharges", "no_security", "is_fiber"), " Support_issue.\n", "support_issue", "llm", "medium"),
    (4, reasons("no_security", "tenure", "TechSupport"), None, "support_issue", "rule_based", "high"),
    (5, reasons("MonthlyCharges", "no_security", "is_fiber"), "unsure", "disengagement", "llm", "medium"),
    (6, reasons("MonthlyCharges", "no_security", "is_fiber"), None, "disengagement", "llm", "medium"),
    (7, reasons("tenure", "tenure", "is_fiber"), None, "disengagement", "rule_based", "high"),
    (8, [], None, "disengagement", "llm", "medium"),
]
REASONS = "array<struct<feature:string,shap_value:double,reason:string>>"


@pytest.fixture(scope="module")
def behaviour(spark):
    rows = spark.createDataFrame(
        [(i, r, 8, 70.0, M2M, 1, 0.72) for i, r, *_ in BEHAVIOUR],
        f"id int, top_reasons {REASONS}, tenure int, MonthlyCharges double, contract_type string, "
        "active_services int, churn_prob double",
    )
    answers = [(i, t) for i, _, t, *_ in BEHAVIOUR if t is not None]
    # answers written twice, as after a retried task
    replies = spark.createDataFrame(answers + answers, "id int, reply string")
    return rows, replies


def test_behaviour_cases(behaviour):
    rows, replies = behaviour
    got = {r["id"]: r for r in detect_behavior(rows, "id", replies).collect()}
    assert len(got) == len(BEHAVIOUR)
    for i, _, _, kind, method, confidence in BEHAVIOUR:
        assert (got[i]["risk_type"], got[i]["method"], got[i]["confidence"]) == (kind, method, confidence)
        template = "support_template" if kind == "support_issue" else "reengagement_template"
        assert got[i]["routing"] == f"email_generator:{template}"
    assert got[1]["reasons"] == ["tenure", "is monthly", "active services"]


def test_rule_needs_a_strict_majority(spark):
    rows = spark.createDataFrame(
        [(1, reasons("tenure", "no_security")), (2, reasons("tenure"))], f"id int, top_reasons {REASONS}"
    )
    kinds = rows.select(classify_rule(F.col("top_reasons")).alias("k")).collect()
    assert [r["k"] for r in kinds] == [None, None]


def test_only_unclear_customers_are_asked(behaviour):
    rows, _ = behaviour
    prompts = {r["id"]: r["prompt"] for r in classification_prompts(rows, "id").collect()}
    assert sorted(prompts) == [3, 5, 6, 8]
    assert "  - no security (SHAP: +0.400)" in prompts[3]
    assert "tenure_months=8 |" in prompts[3] and "monthly_charge=70.0 |" in prompts[3]


MESSAGES = [
    (1, "disengagement", True, 10, 9.0, "discount_offer", 12, 90.0, 2,
     ["very short account tenure", "month-to-month contract", "low number of active services"],
     "- Special Offer: 10% discount approved (saves $9.0/month)",
     "Include the 10% discount offer with a clear call-to-action to claim it"),
    (2, "support_issue", False, 0, None, "feature_upsell", 8, 70.0, 1,
     ["no online security add-on", "no tech support service", "no online backup service"],
     "- No discount (alternative: Highlight 2 premium features they aren't using)",
     "Highlight 2 premium features they aren't using"),
    (3, "disengagement", False, 0, None, "something_else", None, None, None, [],
     "- No discount (alternative: personalized offer)", "Include a clear next step call-to-action"),
]


@pytest.fixture(scope="module")
def decided(spark):
    return spark.createDataFrame(
        [(*m[:10], M2M if m[6] else None, 0.85) for m in MESSAGES],
        "id int, risk_type string, eligible boolean, discount_pct int, monthly_savings double, strategy string, "
        "tenure int, MonthlyCharges double, active_services int, reasons array<string>, contract_type string, churn_prob double",
    )


def test_message_context(decided):
    got = {r["id"]: r for r in message_context(decided).collect()}
    for m in MESSAGES:
        assert got[m[0]]["discount_section"] == m[10]
        assert got[m[0]]["cta_instruction"] == m[11]
    assert got[1]["reasons_text"] == ", ".join(MESSAGES[0][9])
    assert got[3]["reasons_text"] == "general disengagement"


def test_message_prompts(spark, decided):
    prompts = {r["id"]: r["prompt"] for r in message_prompts(decided, "id").collect()}
    assert "service has gaps" in prompts[2] and "interest has faded" in prompts[1]
    assert MESSAGES[0][10] in prompts[1]
    assert "tenure_months=a few |" in prompts[3] and "monthly_charge=N/A |" in prompts[3]
    done = spark.createDataFrame([(1,)], "id int")
    assert sorted(r["id"] for r in message_prompts(decided, "id", done).collect()) == [2, 3]


PARSED = {
    "Subject: A\n\nHello": ("A", "Hello", "Subject: A\n\nHello"),
    "SUBJECT: A: b\nx\nsubject: C": ("C", "x", "SUBJECT: A: b\nx\nsubject: C"),
    "no subject": ("We'd love to keep you with us", "no subject", "no subject"),
    "  \nSubject:   \n body \n": ("We'd love to keep you with us", "body", "Subject:   \n body"),
    "": ("We'd love to keep you with us", "", ""),
    " Subject: first\n Subject: indented stays body": ("first", "Subject: indented stays body", "Subject: first\n Subject: indented stays body"),
}


def test_parse_message(spark):
    rows = spark.createDataFrame([(t,) for t in PARSED], "t string")
    for r in rows.select("t", parse_message(F.col("t")).alias("m")).collect():
        assert tuple(r["m"]) == PARSED[r["t"]]


def test_generate_opens_one_writer_per_partition(spark, decided):
    def make_writer():
        opened = []
        return lambda prompt: f"Subject: hi\n\n{len(opened)}{prompt[:5]}"

    prompts = message_prompts(decided, "id").repartition(2)
    texts = generate(prompts, "id", make_writer)
    assert texts.schema.simpleString() == "struct<id:int,text:string>"
    assert sorted(r["text"] for r in texts.collect()) == ["Subject: hi\n\n0Lette"] * 3
    replies = spark.createDataFrame([(1, "x"), (9, "y")], "id int, text string")
    assert [tuple(r) for r in texts_from_table(prompts, replies, "id").collect()] == [(1, "x")]


def test_records(decided):
    rows = decided.withColumn("text", F.lit("Subject: Hi\n\nDear you"))
    got = message_records(rows, "id")
    assert got.columns == [
        "user_id", "timestamp", "churn_prob", "risk_type", "discount_pct", "eligible", "subject", "body",
        "top_reasons", "strategy", "status",
    ]
    assert got.where("user_id = 1").first()["subject"] == "Hi"
    some = decided.withColumn("text", F.when(F.col("id") == 1, "Dear").when(F.col("id") == 2, " \n"))
    assert [r["user_id"] for r in message_records(some, "id").collect()] == [1]


def test_flags_levels_contract(spark):
    rows = spark.createDataFrame([(0.65,), (0.6499999,), (0.80,), (None,)], "p double").select(
        is_flagged(F.col("p")).alias("f"), risk_level(F.col("p")).alias("l")
    )
    assert [tuple(r) for r in rows.collect()] == [(True, "Medium"), (False, "Low"), (True, "High"), (False, "Low")]
    hot = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (None, None)], "two int, one int")
    names = hot.select(contract_from_one_hot(F.col("two"), F.col("one")).alias("c")).collect()
    assert [r["c"] for r in names] == ["Two year", "One year", M2M, M2M]
    answers = spark.createDataFrame([(" Support.\n",), ("no",), (None,)], "r string")
    kinds = answers.select(classify_reply(F.col("r")).alias("k")).collect()
    assert [r["k"] for r in kinds] == ["support_issue", "disengagement", "disengagement"]


def test_pending_records(spark):
    rows = spark.createDataFrame(
        [(1, 0.9, "support_issue", 10, True, ["a"], "s", "Subject: Hi\nbody"), (2, 0.8, "support_issue", 0, False, ["a"], "s", None), (3, 0.8, "x", 0, False, ["a"], "s", " ")],
        "id long, churn_prob double, risk_type string, discount_pct int, eligible boolean, reasons array<string>, strategy string, text string",
    )
    got = {r["user_id"]: (r["subject"], r["body"], r["status"]) for r in message_records(rows, "id", pending=True).collect()}
    assert got == {1: ("Hi", "body", "simulated"), 2: (None, None, "pending"), 3: (None, None, "pending")}
    assert message_records(rows, "id").count() == 1
