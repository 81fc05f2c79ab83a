"""Names and domains of the loan data.

Fixed values: every list below is part of the data contract and keeps its natural order.
"""

from __future__ import annotations

TARGET = "default"

BAD_STATUSES = ("Charged Off", "Default", "Does not meet the credit policy. Status:Charged Off")
GOOD_STATUSES = ("Fully Paid", "Does not meet the credit policy. Status:Fully Paid")
UNRESOLVED_STATUSES = ("Current", "In Grace Period", "Late (16-30 days)", "Late (31-120 days)", "Issued", "")

NUMERIC_FEATURES = (
    "loan_amnt", "int_rate", "annual_inc", "dti", "fico_range_low", "fico_range_high",
    "delinq_2yrs", "inq_last_6mths", "open_acc", "pub_rec", "revol_bal", "revol_util",
    "total_acc", "mort_acc", "acc_open_past_24mths", "pub_rec_bankruptcies",
)
CATEGORICAL_FEATURES = (
    "grade", "sub_grade", "emp_length", "home_ownership", "verification_status",
    "purpose", "addr_state", "application_type", "initial_list_status",
)
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

PERCENT_FEATURES = ("int_rate", "revol_util")
LOG_FEATURES = ("loan_amnt", "annual_inc", "revol_bal", "total_acc")
CLIP_RANGES = {"dti": (0.0, 100.0)}

KEY_COLUMNS = ("id", "loan_status", "issue_d", "term")

FORBIDDEN_FEATURES = (
    "default", "loan_status",
    "total_pymnt", "total_pymnt_inv", "recoveries", "collection_recovery_fee",
    "last_pymnt_d", "last_pymnt_amnt", "next_pymnt_d", "last_credit_pull_d",
    "out_prncp", "out_prncp_inv", "total_rec_prncp", "total_rec_int", "total_rec_late_fee",
    "settlement_status",
    "hardship_flag", "hardship_type", "hardship_reason", "hardship_status", "hardship_loan_status",
    "debt_settlement_flag", "debt_settlement_flag_date",
    "settlement_date", "settlement_amount", "settlement_percentage", "settlement_term",
)

SPLITS = ("train", "calibration", "validation", "test")
SPLIT_RATIOS = (0.6, 0.15, 0.15, 0.10)

REJECTED_COLUMNS = {
    "Amount Requested": "amount_requested",
    "Application Date": "application_date",
    "Loan Title": "loan_title",
    "Risk_Score": "risk_score",
    "Debt-To-Income Ratio": "dti",
    "Zip Code": "zip_code",
    "State": "state",
    "Employment Length": "employment_length",
}

# Scoring requests: field -> (lower bound, lower bound is exclusive, upper bound).
REQUEST_BOUNDS = {
    "loan_amnt": (0.0, True, None),
    "fico_range_low": (300.0, False, 900.0),
    "fico_range_high": (300.0, False, 900.0),
    **{name: (0.0, False, None) for name in NUMERIC_FEATURES if name not in ("loan_amnt", "fico_range_low", "fico_range_high")},
}
REQUIRED_REQUEST_FIELDS = (
    "loan_amnt", "int_rate", "annual_inc", "dti", "fico_range_low", "fico_range_high",
    "grade", "sub_grade", "emp_length", "home_ownership", "verification_status", "purpose", "addr_state",
)

SCORE_COLUMNS = ("p_default", "p_non_default", "risk_band", "model_version", "model_type", "calibration_method")
DEFAULT_LOW_MAX = 0.10
DEFAULT_MEDIUM_MAX = 0.20

MODEL_NAMES = ("logistic_balanced", "logistic", "random_forest", "hist_gradient_boosting")
MODEL_ALIASES = {
    "logistic_regression": "logistic",
    "histogram_gradient_boosting": "hist_gradient_boosting",
}
CALIBRATION_METHODS = ("isotonic", "sigmoid")
MODEL_VERSION = "accepted-default-v1"
COMPACT_FEATURE_COUNT = 5

# Data context of a bundle -> label shown in reports.
DATA_CONTEXTS = {
    "full_lendingclub_local": "Full LendingClub local data",
    "smoke_sample": "Smoke-test sample",
    "synthetic_test_fixture": "Synthetic/test fixture",
}
UNLABELED_CONTEXT = "Unlabeled artifact"

REQUIRED_METADATA = (
    "bundle_schema_version", "model_version", "source_fingerprint", "split_manifest", "split_summary",
    "target_definition", "forbidden_feature_columns", "training_timestamp", "package_versions",
)
LIMITATIONS = (
    "fitted on approved loans only, so applicants who were turned down are not represented",
    "applications that were turned down carry no outcome and take no part in training",
    "neither lending decisions nor equal treatment of applicants have been examined with it",
)
