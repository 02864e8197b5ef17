"""Column roles, thresholds and the fixed lookup values the operators share."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Which column of a customer table plays which part."""

    key: str
    target: str
    positive: str
    label: str
    numeric: tuple[str, ...]
    text_numeric: tuple[str, ...]
    binary: tuple[str, ...]
    services: tuple[str, ...]
    categorical: tuple[str, ...]
    engineered: tuple[str, ...]
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class DecisionConfig:
    """Thresholds of the retention rules."""

    flag_threshold: float = 0.65
    high_risk: float = 0.80
    discount_max_pct: int = 10
    discount_min_pct: int = 5
    min_tenure: int = 3
    min_monthly: float = 30.0
    min_ltv: float = 100.0
    high_ltv: float = 500.0

    @property
    def discount_mid_pct(self) -> int:
        return round((self.discount_min_pct + self.discount_max_pct) / 2)


# ---------------------------------------------------------------------------
# Column names, category spellings, labels and texts that have to
# be exactly these for results to agree with existing churn tables and logs.
# ---------------------------------------------------------------------------

TELCO = Roles(
    key="customerID",
    target="Churn",
    positive="Yes",
    label="Churn_Binary",
    numeric=("SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges"),
    text_numeric=("TotalCharges",),
    binary=(
        "Partner", "Dependents", "PhoneService", "PaperlessBilling", "MultipleLines",
        "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
        "StreamingTV", "StreamingMovies",
    ),
    services=(
        "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
    ),
    categorical=("gender", "InternetService", "Contract", "PaymentMethod"),
    engineered=(
        "recency_score", "active_services", "lifetime_value", "charge_per_service",
        "is_monthly", "is_senior", "no_security", "is_fiber", "is_echeck", "tenure_bucket",
    ),
)

# flag column -> (source column, value that sets the flag)
EQUALS_FLAGS = {
    "is_monthly": ("Contract", "Month-to-month"),
    "no_security": ("OnlineSecurity", "No"),
    "is_fiber": ("InternetService", "Fiber optic"),
    "is_echeck": ("PaymentMethod", "Electronic check"),
}

BINARY_VALUES = {"Yes": 1, "No": 0, "No phone service": 0, "No internet service": 0}

TENURE_EDGES = (12, 36)

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

SUPPORT_SIGNALS = (
    "no_security", "TechSupport", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
)
DISENGAGE_SIGNALS = (
    "tenure", "recency_score", "active_services", "is_monthly", "lifetime_value",
    "charge_per_service",
)
SUPPORT_HINT_FEATURES = ("no_security", "TechSupport", "OnlineSecurity")

RISK_TYPES = ("disengagement", "support_issue")
ROUTING = {
    "support_issue": "email_generator:support_template",
    "disengagement": "email_generator:reengagement_template",
}
RULE_METHOD = "rule_based"
REPLY_METHOD = "llm"

STRATEGY_TEXT = {
    "free_trial_extension": "Offer a 2-week free trial extension",
    "feature_upsell": "Highlight 2 premium features they aren't using",
    "loyalty_reward": "Mention an exclusive loyalty reward",
    "engagement_campaign": "Invite them to a free onboarding session",
}
DEFAULT_SUBJECT = "We'd love to keep you with us"
NO_REASONS_TEXT = "general disengagement"
DEFAULT_ALTERNATIVE = "personalized offer"
DEFAULT_CTA = "Include a clear next step call-to-action"

# text formats; names in braces are filled per customer
DISCOUNT_REASONS = {
    "too_new": "tenure too short ({tenure} months < {min_tenure} minimum)",
    "low_charge": "monthly charge too low (${monthly} < ${min_monthly})",
    "two_year": "already on two-year contract",
    "max": "high churn risk ({risk}) + high LTV (${ltv})",
    "mid": "high churn risk ({risk}) + moderate LTV (${ltv})",
    "min": "moderate churn risk ({risk}) + high LTV (${ltv})",
    "none": "churn risk ({risk}) + LTV (${ltv}) below thresholds",
}
OFFER_LINE = "- Special Offer: {pct}% discount approved (saves ${savings}/month)"
OFFER_CTA = "Include the {pct}% discount offer with a clear call-to-action to claim it"
NO_OFFER_LINE = "- No discount (alternative: {alternative})"
REASON_LINE = "  - {reason} (SHAP: {value})"
IDLE_REASON = "churn_prob {prob} < threshold {threshold}"

RISK_LEVELS = ("High", "Medium", "Low")

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")

# What counts as whitespace when a text is stripped (the Unicode space characters).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
