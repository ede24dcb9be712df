"""Batch job: prepare one table from a path and write the result.

    python -m tableprep SRC DST --order-by id [--format csv] [--out-format parquet] [--features]

On a cluster, submit a two-line driver script that imports ``tableprep.__main__`` and calls ``main()``
(``spark-submit --py-files tableprep.zip job.py SRC DST --order-by id``). The session comes from
``SparkSession.builder.getOrCreate()``, so the cluster's own settings apply (``spark.checkpoint.dir`` must name
a shared folder); the run log can be appended to a table with ``--log``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.features import FeatureOptions
from .operators.impute import FillOptions
from .operators.validate import preview, validate
from .plans.options import MaskingOptions, PrepOptions, StandardizeOptions
from .plans.pipeline import PrepError, run_path
from .sources.io import read_table


def _pairs(args: list[str]) -> dict[str, str]:
    """COLUMN=VALUE arguments."""
    return dict(x.split("=", 1) for x in args)


def _value(text: str):
    """A fill value: a number where the text is one."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text.lower(), text)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tableprep", description="validate, clean and de-identify one table")
    p.add_argument("src")
    p.add_argument("dst")
    p.add_argument("--order-by", required=True, help="unique key column(s), comma separated")
    p.add_argument("--format", default=None, help="input format (csv, json, parquet, orc); default from the extension")
    p.add_argument("--out-format", default="parquet")
    p.add_argument("--features", action="store_true", help="add numeric, text and date features")
    p.add_argument("--fill", default="mean", help="default missing-value strategy")
    p.add_argument("--max-rows", type=int, default=None, help="refuse tables with more rows")
    p.add_argument("--validate-only", action="store_true", help="print the validation report and a preview, write nothing")
    p.add_argument("--fill-column", action="append", default=[], metavar="COLUMN=STRATEGY")
    p.add_argument("--type", action="append", default=[], metavar="COLUMN=TYPE", help="force a column's type")
    p.add_argument("--mask", action="append", default=[], metavar="COLUMN=TYPE[:STRATEGY]", help="mask rule of a column")
    p.add_argument("--fill-value", action="append", default=[], metavar="COLUMN=VALUE", help="fill a column's gaps with a value")
    p.add_argument("--missing-threshold", type=float, default=0.9, help="drop columns with a larger share of gaps")
    p.add_argument("--naming", default="snake_case", help="naming convention of the columns")
    p.add_argument("--verdicts", default=None, help="table (column, is_sensitive, suggested_type) of columns to mask as well")
    p.add_argument("--strict", action="store_true", help="fail on malformed input records instead of leaving them out")
    p.add_argument("--threshold", type=float, default=0.7, help="sensitivity threshold")
    p.add_argument("--log", default=None, help="append the run log to this Parquet table")
    a = p.parse_args(argv)
    keys = [k.strip() for k in a.order_by.split(",") if k.strip()]
    rules = {c: dict(zip(("type", "strategy"), r.split(":"))) for c, r in _pairs(a.mask).items()}
    opts = PrepOptions(order_by=keys if len(keys) > 1 else keys[0],
                       standardization=StandardizeOptions(custom_type_mapping=_pairs(a.type), naming_convention=a.naming),
                       missing_handling=FillOptions(default_strategy=a.fill, column_strategies=_pairs(a.fill_column), missing_threshold=a.missing_threshold,
                                                    custom_fill_values={c: _value(v) for c, v in _pairs(a.fill_value).items()}),
                       masking_rules=MaskingOptions(column_rules=rules, sensitivity_threshold=a.threshold),
                       feature_extraction=FeatureOptions(enable_extraction=a.features), max_rows=a.max_rows)
    spark = SparkSession.builder.appName("tableprep").getOrCreate()
    if a.validate_only:
        df = read_table(spark, a.src, a.format)
        v = validate(df, max_rows=a.max_rows)
        v.report(spark).show(100, truncate=False)
        preview(df, opts.order_by).show(truncate=False)
        return 0 if v.valid else 1
    try:
        verdicts = read_table(spark, a.verdicts) if a.verdicts else None
        if verdicts is not None:
            verdicts = verdicts.select("column", F.col("is_sensitive").cast("boolean").alias("is_sensitive"), "suggested_type")
        res = run_path(spark, a.src, a.dst, opts, fmt=a.format, out_fmt=a.out_format, verdicts=verdicts,
                       on_malformed="error" if a.strict else "split")
    except PrepError as e:
        print(f"failed: {e}", file=sys.stderr)
        for step in e.log:
            print(f"  {step[0]}: {step[1]} {step[2]}", file=sys.stderr)
        return 1
    print(res.text_report)
    if res.n_malformed:
        print(f"{res.n_malformed} malformed input records left out", file=sys.stderr)
    if a.log:
        res.append_log(spark, a.log)
    return 0


if __name__ == "__main__":
    sys.exit(main())
