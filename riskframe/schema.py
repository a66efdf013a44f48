"""Column names and fixed values of the application table.

Fixed values (must equal the analysed dashboard's for equal results), stated
plainly and in natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEY = "SK_ID_CURR"
LABEL = "TARGET"

# --- fixed values -----------------------------------------------------------
# Numeric sentinel meaning "missing" in DAYS_EMPLOYED, string sentinel in CODE_GENDER.
DAYS_EMPLOYED_SENTINEL = 365243
GENDER_SENTINEL = "XNA"
# Label text for the 0/1 outcome.
LABEL_TEXT = {0: "No Default", 1: "Default"}
# What the form shows for a predicted class.
RISK_TITLE = {0: "LOW RISK — NO DEFAULT", 1: "HIGH RISK — DEFAULT LIKELY"}
RISK_TEXT = {0: "This applicant is predicted to repay the loan successfully.",
             1: "This applicant is predicted to default. Further review recommended."}
# Fields of the applicant form in table units; age and employment come in years.
FORM_NUMERIC = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "EXT_SOURCE_1",
                "EXT_SOURCE_2", "EXT_SOURCE_3", "REGION_RATING_CLIENT", "CNT_CHILDREN"]
FORM_CATEGORICAL = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "NAME_FAMILY_STATUS",
                    "NAME_HOUSING_TYPE", "NAME_CONTRACT_TYPE", "WEEKDAY_APPR_PROCESS_START"]
# Weekday order of the application-start chart.
WEEKDAY_ORDER = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]
# Columns of the correlation heat map, in display order.
CORRELATION_COLUMNS = [
    "TARGET", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY",
    "AMT_GOODS_PRICE", "DAYS_BIRTH", "DAYS_EMPLOYED",
    "EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3",
    "REGION_RATING_CLIENT", "CNT_CHILDREN", "CNT_FAM_MEMBERS",
]
# External score columns of the violin chart.
EXT_SCORE_COLUMNS = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
# Split and subsample parameters, seeds and model settings.
TEST_FRACTION = "0.2"
SUBSAMPLE_FRACTION = "0.05"
SCATTER_SAMPLE_SIZE = 4000
AGE_BINS = 40
EMPLOYMENT_BINS = 35
EMPLOYMENT_YEARS_CAP = 40
CHILDREN_CAP = 5
INCOME_QUANTILE = 0.99
IQR_FACTOR = 1.5
PCA_VARIANCE = 0.95
SVM_C = 1.0
MISSING_TOP = 20
PREVIEW_ROWS = 10
KDE_GRID_POINTS = 100
KDE_CUT = 2.0
# --- end of fixed values ----------------------------------------------------

# Salts of the hash orders that replace the seeded random draws.
SPLIT_SALT = "rf-split-42:"
SUBSAMPLE_SALT = "rf-subsample-42:"
SCATTER_SALT = "rf-scatter-42:"
FOLD_SALT = "rf-fold-42:"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = (KEY, LABEL)) -> list[str]:
    """Numeric feature columns, in schema order (PRJ3)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = (KEY, LABEL)) -> list[str]:
    """String feature columns, in schema order (PRJ3)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """Columns of a wish list that exist, in wish-list order (PRJ4)."""
    have = set(df.columns)
    return [c for c in wanted if c in have]
