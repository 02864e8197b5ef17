"""SQL side of the shared tables: one chain of common table expressions.

Written independently of the Spark plans: range joins instead of exploded dates, plain window
ranks instead of bucketed ones. A query names the parts it needs; unused ones cost nothing.
"""

from __future__ import annotations

from string import Formatter

from keepline.roles import TELCO

# Fixed values, written out here as expected values: nothing below comes from the code under test.
INTERCEPT = -0.8
WEIGHTS = {
    "is_monthly": 1.2, "no_security": 0.9, "is_fiber": 0.8, "is_echeck": 0.5,
    "recency_score": 2.0, "active_services": -0.1, "MonthlyCharges": 0.005, "tenure": -0.01,
}
OTHER_INTERCEPT = -0.2
OTHER_WEIGHTS = {"is_monthly": 1.0, "tenure": -0.02}
SUPPORT_SIGNALS = ("no_security", "TechSupport", "OnlineSecurity", "OnlineBackup", "DeviceProtection")
DISENGAGE_SIGNALS = (
    "tenure", "recency_score", "active_services", "is_monthly", "lifetime_value", "charge_per_service",
)
REASON_LABELS = {
    "tenure": "very short account tenure",
    "recency_score": "recently joined (high recency risk)",
    "MonthlyCharges": "high monthly charges",
    "is_monthly": "month-to-month contract (no commitment)",
    "is_fiber": "fiber optic internet (high churn segment)",
    "is_echeck": "electronic check payment method",
    "no_security": "no online security add-on",
    "charge_per_service": "paying high price for few services",
    "active_services": "low number of active services",
    "lifetime_value": "low total lifetime spend",
    "Contract_Month-to-month": "month-to-month contract",
    "Contract_Two year": "long-term contract (retention factor)",
}
STRATEGY_TEXT = {
    "free_trial_extension": "Offer a 2-week free trial extension",
    "feature_upsell": "Highlight 2 premium features they aren't using",
    "loyalty_reward": "Mention an exclusive loyalty reward",
    "engagement_campaign": "Invite them to a free onboarding session",
}
WHITESPACE_CODES = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288,
)
CLASSIFY_TEMPLATE = """Pick the cause behind a likely cancellation.

tenure_months={tenure} | monthly_charge={monthly_charges} | contract={contract} | active_services={active_services}
Evidence from the model, strongest first:
{reasons}

Causes to choose from, one word as the whole reply:
support_issue = something about the service is missing or fails
disengagement = too little ties the customer to it
"""
_LETTER = """tenure_months={tenure} | monthly_charge={monthly_charges} | contract={contract_type} | active_services={active_services}
evidence: {top_reasons}
offer:
{discount_section}
ask at the end: {cta_instruction}

Plain text. Line one is "Subject: " and a subject of under ten words, the rest is the letter, under 150 words.
Mention no score and no model. """
REENGAGE_TEMPLATE = (
    "Letter to a customer whose interest has faded.\n\n"
    + _LETTER
    + "Show one concrete use of what the customer already pays for.\n"
)
SUPPORT_TEMPLATE = (
    "Letter to a customer whose service has gaps.\n\n" + _LETTER + "Name each gap in the evidence and the remedy for it.\n"
)

RAW = [
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
]


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name + '"'


def case(col: str, values: dict, default: str) -> str:
    arms = " ".join(f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in values.items())
    return f"CASE {col} {arms} ELSE {default} END"


def margin(weights: dict[str, float], intercept: float) -> str:
    out = f"CAST({intercept} AS DOUBLE)"
    for f, w in weights.items():
        out = f"({out} + CAST({w} AS DOUBLE) * CAST({f} AS DOUBLE))"
    return out


def scaled_round(expr: str, digits: int) -> str:
    """Scale, round half to even, scale back."""
    f = 10**digits
    return f"CAST(round_even(({expr}) * {f}.0::DOUBLE, 0) AS DOUBLE) / {f}.0::DOUBLE"


def prob(weights: dict[str, float], intercept: float) -> str:
    return scaled_round(f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{margin(weights, intercept)}))", 6)


def fixed(expr: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', CAST({expr} AS DOUBLE))"


def exact(expr: str, digits: int) -> str:
    return f"CAST({fixed(expr, digits)} AS DOUBLE)"


def signed(expr: str, digits: int) -> str:
    return f"(CASE WHEN {expr} < 0 THEN '' ELSE '+' END || {fixed(expr, digits)})"


def strip(expr: str) -> str:
    chars = " || ".join(f"chr({c})" for c in WHITESPACE_CODES)
    return f"trim({expr}, {chars})"


def number(expr: str) -> str:
    s = strip(expr)
    pattern = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    return f"CASE WHEN regexp_matches({s}, '{pattern}') THEN TRY_CAST({s} AS DOUBLE) END"


def rendered(template: str, values: dict[str, str]) -> str:
    parts = []
    for piece, name, _, _ in Formatter().parse(template):
        if piece:
            parts.append(text(piece))
        if name is not None:
            parts.append(values[name])
    return "(" + " || ".join(parts) + ")"


def _yes(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'Yes' ELSE 'No' END"


def _online(cond: str) -> str:
    return f"CASE WHEN InternetService = 'No' THEN 'No internet service' WHEN {cond} THEN 'Yes' ELSE 'No' END"


_SERVICES = " + ".join(f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END" for c in TELCO.services)

_CONTRIB = ", ".join(
    f"{{'f': '{f}', 'c': " + scaled_round(f"CAST({w} AS DOUBLE) * (CAST({f} AS DOUBLE) - m_{f})", 6) + f", 'o': {i}}}"
    for i, (f, w) in enumerate(WEIGHTS.items())
)
_MEANS = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m_{f}" for f in WEIGHTS)
_BASE = "round(CAST(%r AS DOUBLE) + %s, 6)" % (
    INTERCEPT, " + ".join(f"CAST({w} AS DOUBLE) * m_{f}" for f, w in WEIGHTS.items())
)


def ranked(list_expr: str, value: str, desc: bool) -> str:
    """Sorted list of {v, o, f, c}; equal values keep feature order."""
    sign = "-" if desc else ""
    keyed = f"list_transform({list_expr}, lambda x: {{'v': {value}, 'o': {sign}x.o, 'f': x.f, 'c': x.c}})"
    return f"{'list_reverse_sort' if desc else 'list_sort'}({keyed})"


def label_of(f: str) -> str:
    return case(f, REASON_LABELS, f"replace({f}, '_', ' ')")


def _hits(signals) -> str:
    names = ", ".join(text(s) for s in signals)
    return " + ".join(f"CASE WHEN f{i} IN ({names}) THEN 1 ELSE 0 END" for i in (1, 2, 3))


_LTV = exact("tenure * MonthlyCharges", 2)
_RISK = fixed("churn_prob * 100.0::DOUBLE", 0) + " || '%'"
_MONEY = fixed("ltv", 0)

CHAIN = f"""
q AS (
  SELECT CAST(unnest(generate_series(DATE '1996-01-01', DATE '2000-10-01', INTERVAL 3 MONTH)) AS DATE) AS as_of
),
ord AS (
  SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS prio
  FROM orders
),
flags AS (
  SELECT l_orderkey,
         coalesce(bool_or(split_part(p_type, ' ', 1) = 'STANDARD'), false) AS k_standard,
         coalesce(bool_or(split_part(p_type, ' ', 1) = 'ECONOMY'), false) AS k_economy,
         coalesce(bool_or(split_part(p_type, ' ', 1) = 'MEDIUM'), false) AS k_medium,
         coalesce(bool_or(split_part(p_type, ' ', 1) = 'SMALL'), false) AS k_small,
         coalesce(bool_or(split_part(p_type, ' ', 1) = 'LARGE'), false) AS k_large,
         coalesce(bool_or(split_part(p_type, ' ', 1) = 'PROMO'), false) AS k_promo,
         coalesce(bool_or(l_returnflag = 'R'), false) AS k_returned
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
  GROUP BY l_orderkey
),
firsts AS (SELECT o_custkey, min(day) AS first_order FROM ord GROUP BY o_custkey),
base AS (
  SELECT c.*, first_order, as_of
  FROM firsts JOIN customer c ON c_custkey = o_custkey JOIN q ON first_order < as_of
),
win AS (
  SELECT b.c_custkey AS w_cust, b.as_of AS w_as_of,
         CAST(sum(cents) AS BIGINT) AS cents,
         count(*) FILTER (o_orderstatus = 'F') AS n_f,
         count(*) FILTER (o_orderstatus = 'P') AS n_p,
         count(*) FILTER (o_orderstatus = 'O') AS n_o,
         bool_or(k_standard) AS k_standard, bool_or(k_economy) AS k_economy,
         bool_or(k_medium) AS k_medium, bool_or(k_small) AS k_small,
         bool_or(k_large) AS k_large, bool_or(k_promo) AS k_promo,
         bool_or(k_returned) AS k_returned, bool_or(prio = 1) AS k_urgent,
         arg_max(prio, {{'d': day, 'k': o_orderkey}}) AS prio
  FROM base b
  JOIN ord ON o_custkey = c_custkey AND day < as_of AND as_of - day <= 365
  LEFT JOIN flags ON l_orderkey = o_orderkey
  GROUP BY 1, 2
),
fut AS (
  SELECT DISTINCT b.c_custkey AS f_cust, b.as_of AS f_as_of
  FROM base b JOIN ord ON o_custkey = c_custkey AND day >= as_of AND day < as_of + 270
),
joined AS (
  SELECT *,
         CASE WHEN n_f >= n_p AND n_f >= n_o THEN 'Fiber optic' WHEN n_p >= n_o THEN 'DSL' ELSE 'No' END AS InternetService,
         coalesce(cents, 0) AS spent
  FROM base
  LEFT JOIN win ON w_cust = c_custkey AND w_as_of = as_of
  LEFT JOIN fut ON f_cust = c_custkey AND f_as_of = as_of
),
panel AS (
  SELECT CAST(c_custkey AS VARCHAR) || '|' || CAST(as_of AS VARCHAR) AS customerID,
         CAST(c_custkey * 100 + (year(as_of) - 1996) * 4 + quarter(as_of) - 1 AS BIGINT) AS customer_no,
         as_of,
         CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
         CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS SeniorCitizen,
         {_yes("c_nationkey % 2 = 1")} AS Partner,
         {_yes("c_nationkey % 3 = 0")} AS Dependents,
         CAST((as_of - first_order) // 30 AS INTEGER) AS tenure,
         {_yes("k_standard")} AS PhoneService,
         CASE WHEN NOT coalesce(k_standard, false) THEN 'No phone service' WHEN k_economy THEN 'Yes' ELSE 'No' END AS MultipleLines,
         InternetService,
         {_online("k_medium")} AS OnlineSecurity,
         {_online("k_small")} AS OnlineBackup,
         {_online("k_large")} AS DeviceProtection,
         {_online("k_promo")} AS TechSupport,
         {_online("k_returned")} AS StreamingTV,
         {_online("k_urgent")} AS StreamingMovies,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Month-to-month' WHEN 'BUILDING' THEN 'Month-to-month'
              WHEN 'FURNITURE' THEN 'One year' WHEN 'HOUSEHOLD' THEN 'One year' WHEN 'MACHINERY' THEN 'Two year' END AS Contract,
         {_yes("c_custkey % 2 = 1")} AS PaperlessBilling,
         CASE WHEN prio = 1 THEN 'Electronic check' WHEN prio = 2 OR prio IS NULL THEN 'Mailed check'
              WHEN prio = 3 THEN 'Bank transfer' ELSE 'Credit card' END AS PaymentMethod,
         CAST((spent + 3000) // 6000 AS DOUBLE) / 100.0::DOUBLE AS MonthlyCharges,
         CASE WHEN spent = 0 THEN ' '
              ELSE CAST(CAST(CAST(spent AS DECIMAL(20, 0)) * CAST('0.00002' AS DECIMAL(6, 5)) AS DECIMAL(28, 5)) AS VARCHAR) END AS TotalCharges,
         CASE WHEN f_cust IS NOT NULL THEN 'No' ELSE 'Yes' END AS Churn
  FROM joined
),
feat0 AS (
  SELECT * REPLACE (coalesce({number("TotalCharges")}, 0.0::DOUBLE) AS TotalCharges),
         CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS Churn_Binary,
         {_SERVICES} AS active_services
  FROM panel
),
feat AS (
  SELECT *,
         1.0::DOUBLE / (tenure + 1) AS recency_score,
         MonthlyCharges * tenure AS lifetime_value,
         MonthlyCharges / (active_services + 1) AS charge_per_service,
         CASE WHEN Contract = 'Month-to-month' THEN 1 ELSE 0 END AS is_monthly,
         SeniorCitizen AS is_senior,
         CASE WHEN OnlineSecurity = 'No' THEN 1 ELSE 0 END AS no_security,
         CASE WHEN InternetService = 'Fiber optic' THEN 1 ELSE 0 END AS is_fiber,
         CASE WHEN PaymentMethod = 'Electronic check' THEN 1 ELSE 0 END AS is_echeck,
         CASE WHEN tenure <= 12 THEN 0 WHEN tenure <= 36 THEN 1 ELSE 2 END AS tenure_bucket
  FROM feat0
),
scored AS (
  SELECT *, {prob(WEIGHTS, INTERCEPT)} AS churn_prob, {prob(OTHER_WEIGHTS, OTHER_INTERCEPT)} AS other_prob
  FROM feat
),
means AS (SELECT {_MEANS} FROM scored),
explained AS (
  SELECT s.*, [{_CONTRIB}] AS contributions, {_BASE} AS base_value
  FROM scored s, means
),
long AS (
  SELECT customerID, Churn_Binary, u.f AS feature, u.c AS contribution, u.o AS ordinal
  FROM (SELECT customerID, Churn_Binary, unnest(contributions) AS u FROM explained)
),
topped AS (
  SELECT *, {ranked("contributions", "x.c", True)} AS top, {ranked("contributions", "x.c", False)} AS bottom,
         {ranked("contributions", "abs(x.c)", True)} AS biggest
  FROM explained
),
reasons AS (
  SELECT *, top[1].f AS f1, top[2].f AS f2, top[3].f AS f3,
         {exact("top[1].c", 4)} AS v1, {exact("top[2].c", 4)} AS v2, {exact("top[3].c", 4)} AS v3,
         {label_of("top[1].f")} AS l1, {label_of("top[2].f")} AS l2, {label_of("top[3].f")} AS l3
  FROM topped
),
ruled AS (
  SELECT *, {_hits(SUPPORT_SIGNALS)} AS s_hits, {_hits(DISENGAGE_SIGNALS)} AS d_hits,
         CASE TechSupport WHEN 'No' THEN ' Support_issue.' || chr(10) WHEN 'Yes' THEN 'unsure' END AS reply
  FROM reasons WHERE churn_prob >= 0.65
),
behaved AS (
  SELECT *,
         CASE WHEN s_hits >= 2 AND s_hits > d_hits THEN 'support_issue'
              WHEN d_hits >= 2 AND d_hits > s_hits THEN 'disengagement' END AS rule_type
  FROM ruled
),
typed AS (
  SELECT *,
         coalesce(rule_type, CASE WHEN contains(lower(trim(reply)), 'support') THEN 'support_issue' ELSE 'disengagement' END) AS risk_type,
         CASE WHEN rule_type IS NULL THEN 'llm' ELSE 'rule_based' END AS method,
         CASE WHEN rule_type IS NULL THEN 'medium' ELSE 'high' END AS confidence,
         l1 || ', ' || l2 || ', ' || l3 AS reasons_text,
         Contract AS contract_type,
         {_LTV} AS ltv
  FROM behaved
),
assessed AS (
  SELECT *,
         CASE WHEN tenure < 3 THEN 'free_trial_extension' WHEN MonthlyCharges < 30 THEN 'feature_upsell'
              WHEN Contract = 'Two year' THEN 'loyalty_reward'
              WHEN churn_prob >= 0.80 AND ltv >= 100 THEN 'discount_offer'
              WHEN churn_prob >= 0.65 AND ltv >= 500 THEN 'discount_offer'
              ELSE 'engagement_campaign' END AS strategy
  FROM typed
),
priced AS (
  SELECT *,
         strategy = 'discount_offer' AS eligible,
         CASE WHEN strategy <> 'discount_offer' THEN 0
              WHEN churn_prob >= 0.80 AND ltv >= 500 THEN 10
              WHEN churn_prob >= 0.80 THEN 8 ELSE 5 END AS discount_pct,
         CASE strategy
           WHEN 'free_trial_extension' THEN 'tenure too short (' || {fixed("tenure", 0)} || ' months < 3 minimum)'
           WHEN 'feature_upsell' THEN 'monthly charge too low ($' || {fixed("MonthlyCharges", 0)} || ' < $30)'
           WHEN 'loyalty_reward' THEN 'already on two-year contract'
           WHEN 'discount_offer' THEN
             CASE WHEN churn_prob >= 0.80 AND ltv >= 500 THEN 'high churn risk (' || {_RISK} || ') + high LTV ($' || {_MONEY} || ')'
                  WHEN churn_prob >= 0.80 THEN 'high churn risk (' || {_RISK} || ') + moderate LTV ($' || {_MONEY} || ')'
                  ELSE 'moderate churn risk (' || {_RISK} || ') + high LTV ($' || {_MONEY} || ')' END
           ELSE 'churn risk (' || {_RISK} || ') + LTV ($' || {_MONEY} || ') below thresholds' END AS discount_reason
  FROM assessed
),
decided AS (
  SELECT *,
         CASE WHEN eligible THEN {exact("MonthlyCharges * discount_pct / 100", 2)} END AS monthly_savings,
         CASE WHEN eligible THEN {exact("MonthlyCharges * discount_pct / 100 * 12", 2)} END AS annual_savings
  FROM priced
),
context AS (
  SELECT *,
         CASE WHEN eligible THEN '- Special Offer: ' || discount_pct || '% discount approved (saves $' || CAST(monthly_savings AS VARCHAR) || '/month)'
              ELSE '- No discount (alternative: ' || {case("strategy", STRATEGY_TEXT, "'personalized offer'")} || ')' END AS discount_section,
         CASE WHEN eligible THEN 'Include the ' || discount_pct || '% discount offer with a clear call-to-action to claim it'
              ELSE {case("strategy", STRATEGY_TEXT, "'Include a clear next step call-to-action'")} END AS cta_instruction
  FROM decided
),
written AS (
  SELECT customerID AS t_id, 'We value you, customer number ' || customer_no || ', on your ' || coalesce(Contract, 'current') || ' plan' AS subject,
         'Hello,' || chr(10) || 'thank you for ' || tenure || ' months.' AS body
  FROM panel WHERE PaperlessBilling = 'Yes'
),
outcomes AS (
  SELECT customerID AS user_id, {exact("churn_prob", 4)} AS churn_prob, risk_type, confidence, discount_pct, eligible,
         subject AS email_subject, body, strategy, reasons_text,
         CASE WHEN t_id IS NULL THEN 'pending' ELSE 'email_sent' END AS action, CAST(NULL AS VARCHAR) AS reason
  FROM decided LEFT JOIN written ON t_id = customerID
  UNION ALL
  SELECT customerID, churn_prob, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no_action',
         'churn_prob ' || {fixed("churn_prob * 100.0::DOUBLE", 1)} || '% < threshold 0.65'
  FROM scored WHERE churn_prob < 0.65
),
risk AS (
  SELECT customerID, 'USR_' || CASE WHEN customer_no < 1000 THEN lpad(CAST(customer_no AS VARCHAR), 4, '0') ELSE CAST(customer_no AS VARCHAR) END AS user_id,
         churn_prob, {scaled_round("churn_prob * 100", 1)} AS risk_score_pct,
         CASE WHEN churn_prob >= 0.65 THEN 1 ELSE 0 END AS flagged, Churn_Binary AS true_label,
         tenure, MonthlyCharges, active_services,
         CASE WHEN churn_prob >= 0.80 THEN 'High' WHEN churn_prob >= 0.65 THEN 'Medium' ELSE 'Low' END AS risk_level
  FROM scored
),
hashed AS (
  SELECT *, CAST(('0x' || substr(md5('42:' || customerID), 1, 8)) AS BIGINT) AS h FROM feat
),
class_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY Churn_Binary ORDER BY h, customerID) AS class_rank FROM hashed
),
class_sizes AS (SELECT Churn_Binary AS y, count(*) AS n_c FROM feat GROUP BY 1),
sizes AS (SELECT sum(n_c) AS n, sum(n_c) - CAST(ceil(0.2::DOUBLE * sum(n_c)) AS BIGINT) AS n_train FROM class_sizes),
shares AS (
  SELECT y, n_c, CAST(n_c * n_train AS DOUBLE) / n AS exact_share,
         CAST(floor(CAST(n_c * n_train AS DOUBLE) / n) AS BIGINT) AS whole, n_train
  FROM class_sizes, sizes
),
quotas AS (
  SELECT y, n_c - whole - CASE WHEN row_number() OVER (ORDER BY exact_share - whole DESC, y) <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS n_test
  FROM shares
),
parted AS (
  SELECT c.*, CASE WHEN class_rank <= n_test THEN 'test' ELSE 'train' END AS split
  FROM class_ranked c JOIN quotas ON y = Churn_Binary
)
"""


def sql(body: str) -> str:
    """A body over the chain; one that starts with a comma adds parts of its own first."""
    return f"WITH {CHAIN.strip()}\n{body.strip()}"


def classify_prompt() -> str:
    lines = " || chr(10) || ".join(f"'  - ' || l{i} || ' (SHAP: ' || {signed(f'v{i}', 3)} || ')'" for i in (1, 2, 3))
    return rendered(
        CLASSIFY_TEMPLATE,
        {
            "tenure": "CAST(CAST(tenure AS INTEGER) AS VARCHAR)",
            "monthly_charges": "CAST(MonthlyCharges AS VARCHAR)",
            "contract": "coalesce(contract_type, 'unknown')",
            "active_services": "CAST(active_services AS VARCHAR)",
            "reasons": f"({lines})",
        },
    )


def message_prompt() -> str:
    values = {
        "tenure": "CAST(tenure AS VARCHAR)",
        "monthly_charges": "CAST(MonthlyCharges AS VARCHAR)",
        "contract_type": "coalesce(contract_type, 'Month-to-month')",
        "active_services": "CAST(active_services AS VARCHAR)",
        "top_reasons": "reasons_text",
        "discount_section": "discount_section",
        "cta_instruction": "cta_instruction",
    }
    return (
        f"CASE WHEN risk_type = 'support_issue' THEN {rendered(SUPPORT_TEMPLATE, values)} "
        f"ELSE {rendered(REENGAGE_TEMPLATE, values)} END"
    )


# ---- all features, under the names of the feature table --------------------------------------

LEVELS = {
    "gender": ["Female", "Male"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": ["Bank transfer", "Credit card", "Electronic check", "Mailed check"],
}
_WIDE = {
    **{c: c for c in TELCO.numeric},
    **{c: f"CASE WHEN {c} = 'Yes' THEN 1 ELSE 0 END" for c in TELCO.binary},
    **{c: c for c in TELCO.engineered},
    **{f"{c}_{v}": f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END" for c, vs in LEVELS.items() for v in vs},
}
WIDE = list(_WIDE)
#: The feature table before scaling, and the mean and deviation of each feature on the training side.
FITTED = (
    f""", med AS (SELECT median(x) AS m FROM (SELECT {number("p.TotalCharges")} AS x FROM panel p JOIN parted USING (customerID) WHERE split = 'train')),
    filled AS (SELECT d.* REPLACE (coalesce({number("p.TotalCharges")}, m) AS TotalCharges) FROM parted d JOIN panel p USING (customerID), med),
    wide AS (SELECT customerID, Churn_Binary, split, """
    + ", ".join(f'CAST({x} AS DOUBLE) AS "{n}"' for n, x in _WIDE.items())
    + " FROM filled), fitted AS (SELECT "
    + ", ".join(f'avg("{n}") AS "m_{n}", stddev_pop("{n}") AS "s_{n}"' for n in WIDE)
    + " FROM wide WHERE split = 'train') "
)
RAW_WIDE = ", ".join(f'round("{n}", 6) AS "{n}"' for n in WIDE)
SCALED_WIDE = ", ".join(f'round(("{n}" - "m_{n}") / CASE WHEN "s_{n}" = 0 THEN 1 ELSE "s_{n}" END, 6) AS "{n}_scaled"' for n in WIDE)
