"""Decision and message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    KEY, decisions, outcomes, replies, snapshots, texts, with_profile,
)
from catalog.registry import query
from catalog.sql import classify_prompt, exact, fixed, message_prompt, sql, strip
from catalog.tables import records
from keepline.operators.decide import (
    assess_discount, classify_reply, classify_rule, is_flagged, ltv, one_reply_per_key, risk_level,
)
from keepline.operators.explain import explain
from keepline.operators.messages import (
    classification_prompts, generate, message_context, message_prompts, parse_message,
)
from keepline.plans.decisions import flagged_decisions
from keepline.plans.marts import log_view


def flagged(spark, sf):
    return explain(with_profile(spark, sf).where(is_flagged(F.col("churn_prob"))))


@query("i01_classify_rule", sql("SELECT customerID, rule_type FROM behaved"))
def _(spark, sf):
    return flagged(spark, sf).select(KEY, classify_rule(F.col("top_reasons")).alias("rule_type"))


@query(
    "i02_classify_fallback",
    sql(
        "SELECT customerID, CASE WHEN contains(lower(trim(CASE TechSupport WHEN 'No' THEN ' Support_issue.' WHEN 'Yes' THEN 'unsure' END)), 'support') "
        "THEN 'support_issue' ELSE 'disengagement' END AS risk_type FROM panel"
    ),
)
def _(spark, sf):
    answers = one_reply_per_key(replies(spark, sf), KEY, "reply")
    rows = snapshots(spark, sf).select(KEY).join(answers, KEY, "left")
    return rows.select(KEY, classify_reply(F.col("reply")).alias("risk_type"))


_PROMPT_ROWS = f"SELECT customerID, {classify_prompt()} AS prompt FROM typed WHERE rule_type IS NULL"


@query("i03_classification_prompts", sql(_PROMPT_ROWS))
def _(spark, sf):
    return classification_prompts(flagged(spark, sf), KEY)


@query(
    "i04_detect_behavior",
    sql(
        "SELECT customerID, risk_type, method, confidence, reasons_text, CASE risk_type WHEN 'support_issue' THEN 'email_generator:support_template' "
        "ELSE 'email_generator:reengagement_template' END AS routing FROM typed"
    ),
)
def _(spark, sf):
    return decisions(spark, sf).select(
        KEY, "risk_type", "method", "confidence", F.array_join("reasons", ", ").alias("reasons_text"), "routing"
    )


@query("i05_ltv", sql(f"SELECT customerID, {exact('tenure * MonthlyCharges', 2)} AS ltv FROM panel"))
def _(spark, sf):
    return snapshots(spark, sf).select(KEY, ltv(F.col("tenure"), F.col("MonthlyCharges")).alias("ltv"))


@query("i06_assess_discount", sql("SELECT customerID, eligible, discount_pct, strategy, ltv FROM decided"))
def _(spark, sf):
    rows = with_profile(spark, sf).where(is_flagged(F.col("churn_prob")))
    d = assess_discount(F.col("tenure"), F.col("MonthlyCharges"), F.col("Contract"), F.col("churn_prob"))
    return rows.select(KEY, d.alias("d")).select(KEY, "d.eligible", "d.discount_pct", "d.strategy", "d.ltv")


@query("i07_discount_reason", sql("SELECT customerID, discount_reason, monthly_savings, annual_savings FROM decided"))
def _(spark, sf):
    return decisions(spark, sf).select(KEY, "discount_reason", "monthly_savings", "annual_savings")


@query("i08_message_context", sql("SELECT customerID, reasons_text, discount_section, cta_instruction FROM context"))
def _(spark, sf):
    return message_context(decisions(spark, sf)).select(KEY, "reasons_text", "discount_section", "cta_instruction")


_OPEN = f"SELECT customerID, {message_prompt()} AS prompt FROM context WHERE PaperlessBilling <> 'Yes'"


@query("i09_message_prompts", sql(_OPEN))
def _(spark, sf):
    """Prompts for everyone who has no written message yet."""
    return message_prompts(decisions(spark, sf), KEY, texts(spark, sf))


@query(
    "i10_generate",
    sql(f"SELECT customerID, 'Subject: ' || length(prompt) || ' characters' || chr(10) || chr(10) || prompt AS text FROM ({_OPEN})"),
)
def _(spark, sf):
    prompts = message_prompts(decisions(spark, sf), KEY, texts(spark, sf))
    return generate(prompts, KEY, lambda: (lambda prompt: f"Subject: {len(prompt)} characters\n\n{prompt}"))


_LINES = f"string_split({strip('raw')}, chr(10))"
_PARSED = f"""
, src AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN 'Subject: about ' || source || chr(10) || text
                         ELSE ' ' || text || chr(10) || 'SUBJECT: ' || lang || ': x ' END AS raw FROM documents),
cut AS (SELECT doc_id, raw, list_filter({_LINES}, lambda l: starts_with(lower(l), 'subject:')) AS heads,
        list_filter({_LINES}, lambda l: NOT starts_with(lower(l), 'subject:')) AS rest FROM src),
named AS (SELECT *, {strip("substring(heads[-1], 9)")} AS s FROM cut)
SELECT doc_id, CASE WHEN length(s) > 0 THEN s ELSE 'We''d love to keep you with us' END AS subject,
       {strip("array_to_string(rest, chr(10))")} AS body, {strip('raw')} AS full_text FROM named
"""


@query("i11_parse_message", sql(_PARSED))
def _(spark, sf):
    """Whole documents read as messages, with subject lines in three shapes."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kind = F.col("doc_id") % 3
    raw = (
        F.when(kind == 0, F.col("text"))
        .when(kind == 1, F.concat(F.lit("Subject: about "), F.col("source"), F.lit("\n"), F.col("text")))
        .otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\nSUBJECT: "), F.col("lang"), F.lit(": x ")))
    )
    return d.select("doc_id", parse_message(raw).alias("m")).select(
        "doc_id", "m.subject", "m.body", F.col("m.full").alias("full_text")
    )


@query(
    "i12_message_records",
    sql(
        "SELECT user_id, churn_prob, risk_type, discount_pct, eligible, email_subject AS subject, body, reasons_text, strategy, 'simulated' AS status "
        "FROM outcomes WHERE action = 'email_sent'"
    ),
)
def _(spark, sf):
    return records(spark, sf).select(
        "user_id", "churn_prob", "risk_type", "discount_pct", "eligible", "subject", "body",
        F.array_join("top_reasons", ", ").alias("reasons_text"), "strategy", "status",
    )


_OUTCOME = "user_id, churn_prob, risk_type, confidence, discount_pct, eligible, email_subject, strategy, reasons_text, action, reason"


@query("i13_decide", sql(f"SELECT {_OUTCOME} FROM outcomes"))
def _(spark, sf):
    return outcomes(spark, sf).withColumn("reasons_text", F.array_join("top_reasons", ", ")).drop("top_reasons")


@query(
    "i14_decide_totals",
    sql(
        "SELECT action, count(*) AS n, count(*) FILTER (eligible) AS eligible, count(DISTINCT strategy) AS strategies FROM outcomes GROUP BY action"
    ),
)
def _(spark, sf):
    return outcomes(spark, sf).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("eligible").alias("eligible"),
        F.countDistinct("strategy").alias("strategies"),
    )


@query(
    "i14_flagship",
    sql(
        "SELECT customerID, churn_prob, CASE WHEN churn_prob >= 0.80 THEN 'High' ELSE 'Medium' END AS risk_level, f1 AS top_feature, l1 AS top_reason, "
        "coalesce(rule_type, 'disengagement') AS risk_type, eligible, discount_pct, strategy, discount_reason, ltv FROM decided"
    ),
)
def _(spark, sf):
    """Flagged customers with reason, risk type and offer, riskiest first."""
    rows = flagged_decisions(with_profile(spark, sf), KEY)
    first = F.get("top_reasons", F.lit(0))
    return rows.select(
        KEY, "churn_prob", risk_level(F.col("churn_prob")).alias("risk_level"),
        first["feature"].alias("top_feature"), first["reason"].alias("top_reason"),
        "risk_type", "eligible", "discount_pct", "strategy", "discount_reason", "ltv",
    ).orderBy(F.desc("churn_prob"), KEY)


@query(
    "i15_log_view",
    sql(
        "SELECT user_id, " + fixed("churn_prob * 100.0::DOUBLE", 1) + " || '%' AS churn_risk, risk_type, discount_pct || '%' AS discount, "
        "CASE WHEN churn_prob * 100 >= 80 THEN 'High' ELSE 'Medium' END AS color_class, substring(email_subject, 1, 50) AS title_subject, "
        "substring(email_subject, 1, 45) AS preview_subject, substring(email_subject, 1, 40) AS report_subject, "
        "replace(body, chr(10), '<br>') AS body_html, 'simulated' AS status FROM outcomes WHERE action = 'email_sent'"
    ),
)
def _(spark, sf):
    return log_view(records(spark, sf))
