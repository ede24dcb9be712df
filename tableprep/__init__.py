"""tableprep: check, clean and de-identify tables of any size on Spark.

Statistics are gathered in a few Spark aggregations ("fit") and applied as native column
expressions ("transform"), so a fitted preparation can be reused on other tables and, for its
row-wise parts, on streams.

    from tableprep import run, PrepOptions
    res = run(df, PrepOptions(order_by="id"))
"""

from .operators.features import FeatureOptions, extract_features
from .operators.impute import FillOptions, fill_missing
from .operators.masking import MaskOptions, MaskSpec, mask_columns
from .operators.ordered_fill import ordered_fill
from .operators.quality import quality_report
from .operators.sensitive import detect_sensitive, mask_decision
from .operators.standardize import convert_types, infer_types, rename_columns
from .operators.validate import validate
from .plans.options import MaskingOptions, PrepOptions, StandardizeOptions
from .plans.pipeline import FittedPrep, PrepError, RunResult, fit, run, run_path
from .sources.io import read_table, write_table

__all__ = [
    "FeatureOptions", "FillOptions", "MaskOptions", "MaskSpec", "MaskingOptions", "PrepOptions", "StandardizeOptions",
    "FittedPrep", "PrepError", "RunResult", "fit", "run", "run_path", "validate", "infer_types", "convert_types",
    "rename_columns", "fill_missing", "ordered_fill", "detect_sensitive", "mask_decision", "mask_columns",
    "extract_features", "quality_report", "read_table", "write_table",
]
