"""keepline: customer-churn analytics and retention decisions as Spark DataFrame operators."""
