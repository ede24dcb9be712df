"""The preparation pipeline (P1-P7): validate, standardize, fill, mask, features, report.

``fit`` runs a handful of small jobs (profile, datetime sample, fill statistics, detection
sample) and returns a ``FittedPrep`` of plain constants. ``FittedPrep.transform`` turns any table
with the same input columns into one lazy plan; ``run`` does both, writes the result to the
checkpoint folder once (lineage cut, executor loss safe) and reports on the written copy.
"""

from __future__ import annotations

import secrets
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import DATETIME_FORMATS, INTEGRAL_TYPES, col, is_blank, is_missing, parses_as_number, to_datetime
from ..operators.features import extract_features, feature_columns
from ..operators.impute import FillPlan, apply_fills, fit_fills
from ..operators.masking import MaskOptions, MaskSpec, mask_columns, mask_summary
from ..operators.profile import Profile, profile
from ..operators.quality import CHECK_SAMPLE, QualityReport, consistency_gain, quality_report, sketch_estimates, sketch_frame
from ..operators.sample import first_values
from ..operators.sensitive import SAMPLE_SIZE, VALUE_RATE, classify, mask_decision, name_candidates, sample_rates
from ..operators.standardize import (
    CATEGORICAL_META,
    TypeDecision,
    cast_expr,
    drop_duplicate_columns,
    infer_types,
)
from ..functions.naming import convert_names
from ..functions.predicates import is_id_card, is_phone
from ..session import remove_folder, write_and_read
from ..operators.validate import Validation, validate
from .options import PrepOptions

IDENTIFIERS = ("phone", "id_card")     # sensitive types made of digits
LOG_SCHEMA = "step string, status string, message string, details map<string,string>, seconds double"


class PrepError(Exception):
    """A failed run (P7): carries the run log; no partial output is returned."""

    def __init__(self, message: str, log: list[tuple]):
        super().__init__(message)
        self.log = log


@dataclass
class Cast:
    column: str
    logical: str
    fmt: str | None = None
    integral: bool | None = None


@dataclass
class FittedPrep:
    input_columns: list[str]
    dropped_empty: list[str]
    renames: dict[str, str]
    auto_casts: list[Cast]
    custom_casts: list[Cast]
    text_booleans: bool
    fill_plan: FillPlan
    masks: dict[str, MaskSpec]
    mask_opts: MaskOptions
    features: list[str]
    feature_opts: object
    has_values: dict[str, bool]
    order_by: list[str] | None
    partition_by: list[str]
    type_decisions: list[TypeDecision] = field(default_factory=list)
    detections: list[dict] = field(default_factory=list)
    validation: Validation | None = None
    cast_loss: dict[str, int] = field(default_factory=dict)     # text values that don't parse, by column
    consistency: dict | None = None     # Q20: of the raw and of the converted table, and the gain, in percent

    # -- transform pieces (each a lazy projection / filter) --
    def standardize(self, df: DataFrame) -> DataFrame:
        x = drop_duplicate_columns(df)
        missing = [c for c in self.input_columns if c not in x.columns]
        if missing:
            raise ValueError(f"input lacks columns {missing}")
        x = x.select(*[col(c) for c in self.input_columns])
        if self.dropped_empty:
            x = x.drop(*self.dropped_empty)
        if self.renames:
            x = x.toDF(*[self.renames.get(c, c) for c in x.columns])
        x = self._casts(x, self.auto_casts)
        return self._casts(x, self.custom_casts)

    def _casts(self, x: DataFrame, casts: list[Cast]) -> DataFrame:
        if not casts:
            return x
        by = {c.column: c for c in casts}
        out = []
        for f in x.schema.fields:
            c = by.get(f.name)
            e = None if c is None else cast_expr(x, f.name, c.logical, c.fmt, c.integral, self.text_booleans)
            if e is None:
                out.append(col(f.name))
            elif c.logical == "categorical":
                out.append(e.alias(f.name, metadata=CATEGORICAL_META))
            else:
                out.append(e.alias(f.name))
        return x.select(*out)

    def fill(self, df: DataFrame) -> DataFrame:
        return apply_fills(df, self.fill_plan, self.order_by, self.partition_by or None)

    def mask(self, df: DataFrame) -> DataFrame:
        return mask_columns(df, self.masks, self.mask_opts) if self.masks else df

    def add_features(self, df: DataFrame) -> DataFrame:
        if not self.features:
            return df
        feats = dict(feature_columns(df, self.has_values, self.feature_opts))
        return df.select(*[col(c) for c in df.columns], *[feats[n].alias(n) for n in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        """The whole preparation as one lazy plan."""
        return self.add_features(self.mask(self.fill(self.standardize(df))))

    def transform_stream(self, stream: DataFrame) -> DataFrame:
        """Row-wise parts on a streaming DataFrame (renames, casts, literal fills, drops, masks, features)."""
        from ..streaming.stream import check_streamable

        check_streamable(self)
        return self.transform(stream)

    def unchanged_columns(self) -> frozenset:
        """Input columns whose values the preparation leaves exactly as they are (same name, no cast,
        fill or mask, and no row dropped)."""
        if any(st.kind == "drop" for st in self.fill_plan.steps):
            return frozenset()
        touched = {c.column for c in self.auto_casts + self.custom_casts}
        touched |= {st.column for st in self.fill_plan.steps} | set(self.masks)
        out = set()
        for c in self.input_columns:
            if c in self.dropped_empty or c in self.fill_plan.dropped_columns:
                continue
            if self.renames.get(c, c) == c and c not in touched:
                out.add(c)
        return frozenset(out)

    # -- P5 pieces --
    def masked_columns(self, spark) -> DataFrame:
        return spark.createDataFrame([(c, s.masking_type, s.strategy) for c, s in self.masks.items()],
                                     "column string, masking_type string, strategy string")


def _map_order(order_by, renames: dict[str, str]):
    if order_by is None:
        return None
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return [renames.get(k, k) for k in keys]


def fit(df: DataFrame, opts: PrepOptions = PrepOptions(), log: list | None = None,
        validation: Validation | None = None, verdicts: DataFrame | None = None) -> FittedPrep:
    """Gather the constants of a preparation. ``verdicts`` is an optional caller-supplied frame
    ``(column, is_sensitive, suggested_type)`` that marks more columns as sensitive (D13)."""
    spark = df.sparkSession
    log = log if log is not None else []
    so, mo, fo = opts.standardization, opts.masking_rules, opts.feature_extraction

    # 1. validation (profile job with type evidence)
    t0 = time.time()
    v = validation
    if v is None:
        base = drop_duplicate_columns(df) if so.remove_duplicate_columns else df
        v = validate(df, max_rows=opts.max_rows, max_columns=opts.max_columns, max_missing_rate=opts.max_missing_rate,
                     prof=profile(base, text_evidence=so.auto_detect_types) if df.columns else None)
    log.append(("data_validation", "success" if v.valid else "failed",
                "validation passed" if v.valid else "validation failed",
                {"errors": str(v.errors), "warnings": str(v.warnings), "stats": str(v.stats)}, time.time() - t0))
    if not v.valid:
        raise PrepError(f"validation failed: {v.errors}", log)
    raw_prof: Profile = v.prof

    # 2. standardization
    t0 = time.time()
    x = drop_duplicate_columns(df) if so.remove_duplicate_columns else df
    input_columns = list(x.columns)
    dropped_empty = raw_prof.empty_columns() if so.remove_empty_columns else []
    kept = [c for c in input_columns if c not in dropped_empty]
    renames = {}
    if so.enable_column_rename:
        new = convert_names(kept, so.naming_convention)
        renames = {o: n for o, n in zip(kept, new) if o != n}
    order_by = _map_order(opts.order_by, renames)
    ruled = {c for c, r in mo.column_rules.items() if r.get("type") in IDENTIFIERS} if so.protect_identifiers else set()
    x = x.drop(*dropped_empty) if dropped_empty else x
    x = x.toDF(*[renames.get(c, c) for c in x.columns]) if renames else x
    auto_casts, decisions, lost = [], [], {}
    # reuse the raw profile (same rows; columns renamed)
    p = Profile(raw_prof.rows, [renames.get(c, c) for c in kept],
                {renames.get(c, c): raw_prof.dtypes[c] for c in kept},
                {renames.get(c, c): raw_prof.missing[c] for c in kept},
                {renames.get(c, c): raw_prof.stats.get(c, {}) for c in kept})
    fmts, rates, checks = _shared_sample(x, p, order_by)
    if so.auto_detect_types:
        decisions = infer_types(x, order_by, p, categorical=False,
                                datetime_formats=fmts if order_by is not None else None)
        for d in decisions:
            if p.dtypes[d.column] != T.StringType() or d.detected not in ("numeric", "datetime", "boolean"):
                continue
            if d.detected == "boolean" and not so.text_booleans:
                continue
            auto_casts.append(Cast(d.column, d.detected, d.fmt, d.target == "bigint"))
        if so.protect_identifiers and order_by is not None:
            # Text columns whose values look like phone or ID numbers are not turned into numbers
            keep_text = {c for c, (ph, idc) in rates.items() if (ph or 0) > VALUE_RATE or (idc or 0) > VALUE_RATE}
            auto_casts = [c for c in auto_casts if not (c.logical == "numeric" and c.column in keep_text)]
        auto_casts = [c for c in auto_casts if not (c.logical == "numeric" and c.column in ruled)]
        auto_casts = _without_loss(x, auto_casts, so.max_cast_loss, lost)
    fitted = FittedPrep(input_columns, dropped_empty, renames, auto_casts, [], so.text_booleans,
                        FillPlan([], [], 0), {}, MaskOptions(secrets.randbits(62) if mo.seed is None else mo.seed, mo.salt, mo.hash_len), [], fo, {},
                        order_by, list(opts.partition_by), decisions, validation=v, cast_loss=lost)
    std = fitted._casts(x, auto_casts)
    custom = [Cast(c, t) for c, t in so.custom_type_mapping.items() if c in std.columns]
    if custom:
        from ..operators.standardize import _datetime_formats

        text_dt = [c.column for c in custom if c.logical == "datetime" and isinstance(std.schema[c.column].dataType, T.StringType)]
        fmts = _datetime_formats(std, text_dt, order_by) if (text_dt and order_by) else {}
        text_num = [c.column for c in custom if c.logical == "numeric" and isinstance(std.schema[c.column].dataType, T.StringType)]
        integral = {}
        if text_num:
            pp = profile(std.select(*[col(c) for c in text_num]), text_evidence=True)
            integral = {c: pp.stats[c].get("not_long", 1) == 0 for c in text_num}
        for c in custom:
            c.fmt = fmts.get(c.column)
            c.integral = integral.get(c.column)
            if c.logical == "datetime" and c.fmt is None:
                c.fmt = DATETIME_FORMATS[5] if c.column in text_dt else None
        custom = _without_loss(std, custom, so.max_cast_loss, lost)
        fitted.custom_casts = custom
        std = fitted._casts(std, custom)
    changes = {f0.name: (f0.dataType.simpleString(), f1.dataType.simpleString())
               for f0, f1 in zip(x.schema.fields, std.schema.fields) if f0.dataType != f1.dataType}
    details = {"dropped_empty": str(dropped_empty), "renamed": str(renames), "type_changes": str(changes),
               "values_not_parsed": str({c: n for c, n in lost.items() if n})}
    log.append(("table_standardization", "success", "table standardized", details, time.time() - t0))

    # 3. missing values (one statistics job, plus mode / median jobs when used)
    t0 = time.time()
    std_prof = None
    if so.auto_detect_types and not fitted.custom_casts and all(c.logical in ("numeric", "boolean") for c in auto_casts):
        # number and boolean casts add no gaps beyond blank text, so the raw profile still holds
        miss = {renames.get(c, c): raw_prof.missing[c] for c in kept}
        for c in auto_casts:
            if c.logical == "numeric":
                st = p.stats.get(c.column, {})
                miss[c.column] += int(st.get("blank", 0) or 0) + (0 if c.integral else int(st.get("nan_text", 0) or 0))
        std_prof = Profile(raw_prof.rows, list(std.columns), {f.name: f.dataType for f in std.schema.fields}, miss)
    std_prof = std_prof or profile(std)
    if order_by is not None:
        fitted.consistency = consistency_gain(raw_prof, std_prof, checks, renames)
        details["consistency"] = f"{fitted.consistency['original']} -> {fitted.consistency['processed']}, gain {fitted.consistency['gain']}"
    ids = set(ruled)
    if so.protect_identifiers and order_by is not None:
        ids |= _number_identifiers(std, std_prof, opts.missing_handling, order_by)
    fitted.fill_plan = fit_fills(std, opts.missing_handling, prof=std_prof, identifiers=frozenset(ids))
    filled = fitted.fill(std)
    log.append(("missing_data_handling", "success", "missing values handled",
                {"plan": str(fitted.fill_plan.log())}, time.time() - t0))

    # 4. masking: one ordered sample of every column of the filled table
    t0 = time.time()
    cols = list(filled.columns)
    rules = {c: r for c, r in mo.column_rules.items() if c in cols}
    need_detect = [c for c in cols if c not in rules] if mo.enable_auto_detection else []
    if order_by is not None:
        counts, rows = _filled_counts(std_prof, fitted.fill_plan, cols)
        samples = first_values(filled, cols, order_by, SAMPLE_SIZE, counts=counts, rows=rows)
        rates = sample_rates(samples)
        det = classify(rates, name_candidates(spark, cols))
        dec = mask_decision(det, threshold=mo.sensitivity_threshold, column_rules=rules, verdicts=verdicts,
                            default_strategy=mo.default_strategy, enable_auto_detection=mo.enable_auto_detection)
        drows = dec.collect()
        fitted.detections = [r.asDict() for r in drows]
        fitted.has_values = {r["column"]: (r["detected_type"] is not None) for r in drows}
        fitted.masks = {r["column"]: MaskSpec(r["masking_type"], r["strategy"]) for r in drows if r["should_mask"]}
    else:
        if need_detect:
            raise ValueError("sensitive-column detection reads the first values in row order: pass order_by")
        fitted.masks = {c: MaskSpec(r.get("type", "text"), r.get("strategy", mo.default_strategy)) for c, r in rules.items()}
        p = profile(filled)
        fitted.has_values = {c: p.non_missing(c) > 0 for c in p.columns}
    # keep rule order = column order
    fitted.masks = {c: fitted.masks[c] for c in cols if c in fitted.masks}
    log.append(("data_masking", "success", f"masked {len(fitted.masks)} sensitive columns",
                {"masked": str({c: (s.masking_type, s.strategy) for c, s in fitted.masks.items()})}, time.time() - t0))

    # 5. features (plan time only)
    if fo.enable_extraction:
        t0 = time.time()
        masked = fitted.mask(filled)
        fitted.features = [n for n, _ in feature_columns(masked, fitted.has_values, fo) if n not in masked.columns]
        log.append(("feature_extraction", "success", f"extracted {len(fitted.features)} features",
                    {"features": str(fitted.features)}, time.time() - t0))
    return fitted


def _filled_counts(p: Profile, plan: FillPlan, cols: list[str]):
    """Non-missing counts and rows after the fills, where the profile before them tells: no row dropped, and constants or nothing
    filled (an ordered fill may leave the first gaps)."""
    kinds = {st.column: st.kind for st in plan.steps}
    if set(kinds.values()) & {"drop", "forward_fill", "backward_fill"} or any(st.value is None for st in plan.steps):
        return None, None
    return {c: p.rows if c in kinds else p.non_missing(c) for c in cols}, p.rows


def _without_loss(x: DataFrame, casts: list[Cast], most: float, lost: dict[str, int]) -> list[Cast]:
    """The casts without those to datetime by which more than the share ``most`` of a text column's values would become
    null; ``lost`` gets the number of values that don't parse, by column (one job for all)."""
    text = [c for c in casts if c.logical == "datetime" and c.fmt and isinstance(x.schema[c.column].dataType, T.StringType)]
    if not text:
        return casts
    aggs = []
    for i, c in enumerate(text):
        has = ~is_missing(col(c.column), T.StringType()) & ~is_blank(col(c.column))
        aggs += [F.count(F.when(has, 1)).alias(f"n{i}"), F.count(F.when(has & to_datetime(col(c.column), c.fmt).isNull(), 1)).alias(f"b{i}")]
    r = x.agg(*aggs).first()
    bad = set()
    for i, c in enumerate(text):
        lost[c.column] = r[f"b{i}"]
        if r[f"b{i}"] > most * r[f"n{i}"]:
            bad.add(c.column)
    return [c for c in casts if not (c in text and c.column in bad)]


def _number_identifiers(std: DataFrame, p: Profile, fo, order_by) -> set[str]:
    """Whole-number columns with gaps whose first values look like phone or ID numbers: a mean would turn them into
    fractions, which no longer look like it and would stay unmasked."""
    gappy = [c for c in p.columns if p.missing[c] > 0 and p.non_missing(c) > 0 and isinstance(p.dtypes[c], INTEGRAL_TYPES)
             and c not in fo.custom_fill_values and fo.column_strategies.get(c, fo.default_strategy) in ("mean", "median")]
    if not gappy:
        return set()
    rates = first_values(std, gappy, order_by, SAMPLE_SIZE, counts={c: p.non_missing(c) for c in gappy}, rows=p.rows).groupBy("column").agg(
        F.avg(is_phone(F.col("value")).cast("double")).alias("ph"), F.avg(is_id_card(F.col("value")).cast("double")).alias("idc"))
    return {r["column"] for r in rates.collect() if max(r["ph"] or 0, r["idc"] or 0) > VALUE_RATE}


def _shared_sample(x: DataFrame, p: Profile, order_by):
    """One sample for all text columns: datetime formats (first 10 values, S9) of those that may convert, phone / ID rates
    (first 20 values, A6) of number-like ones, and the checks of consistency (first 10 values, Q12, Q13) of all."""
    from ..operators.standardize import DATETIME_SAMPLE

    cands = [c for c in p.columns if p.dtypes[c] == T.StringType() and p.non_missing(c) > 0]
    if order_by is None or not cands:
        return {}, {}, {}
    s = first_values(x, cands, order_by, SAMPLE_SIZE, counts={c: p.non_missing(c) for c in cands}, rows=p.rows)
    v = F.col("value")
    head = F.col("pos") <= DATETIME_SAMPLE
    aggs = [F.min(F.when(head, to_datetime(v, f).isNotNull().cast("int"))).alias(f"f{i}") for i, f in enumerate(DATETIME_FORMATS)]
    aggs += [F.avg(is_phone(v).cast("double")).alias("ph"), F.avg(is_id_card(v).cast("double")).alias("idc")]
    few = F.col("pos") <= CHECK_SAMPLE
    aggs += [F.min(F.when(few, F.coalesce(parses_as_number(v), F.lit(True)).cast("int"))).alias("number"),
             *(F.min(F.when(few, to_datetime(v, f).isNotNull().cast("int"))).alias(f"c{i}") for i, f in enumerate(DATETIME_FORMATS))]
    fmts, rates, checks = {}, {}, {}
    for r in s.groupBy("column").agg(*aggs).collect():
        c = r["column"]
        st = p.stats.get(c, {})
        checks[c] = (r["number"] == 1, any(r[f"c{i}"] == 1 for i in range(len(DATETIME_FORMATS))))
        if any(st.get(f"bool_{i}") == 1 for i in range(5)):
            continue
        for i, f in enumerate(DATETIME_FORMATS):
            if r[f"f{i}"] == 1:
                fmts[c] = f
                break
        if st.get("bad_number", 1) == 0:
            rates[c] = (r["ph"], r["idc"])
    return fmts, rates, checks


def log_frame(spark, log: list[tuple]) -> DataFrame:
    """A run's log, one row per step; also of a failed run (``PrepError.log``)."""
    return spark.createDataFrame([(s, st, m, {k: str(v) for k, v in d.items()}, float(t)) for s, st, m, d, t in log], LOG_SCHEMA)


def log_summary(log: DataFrame, masked: int = 0, features: int = 0) -> DataFrame:
    """Q19: steps of a log by status, beside the numbers of masked columns and of features."""
    return log.agg(
        F.count(F.lit(1)).alias("total_steps"),
        F.count(F.when(F.col("status") == "success", 1)).alias("successful_steps"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed_steps"),
    ).withColumn("masked_columns_count", F.lit(masked).cast("bigint")).withColumn("extracted_features_count", F.lit(features).cast("bigint"))


def united_distinct(spark, path: str, run_ids: list[str] | None = None) -> DataFrame:
    """Distinct values of each column over several runs whose logs are at ``path`` (all of them without ``run_ids``): rows
    (side, column, n_distinct), estimated from the united sketches; no run's table is read again."""
    s = spark.read.parquet(path.rstrip("/") + "_sketches")
    return sketch_estimates(s if run_ids is None else s.where(F.col("run_id").isin(list(run_ids))))


@dataclass
class RunResult:
    """P5: data and reports of one run."""
    data: DataFrame
    fitted: FittedPrep
    validation: Validation
    report: QualityReport | None
    log: list[tuple]
    source: DataFrame | None = None      # the input, for previews
    opts: PrepOptions = PrepOptions()
    written: str | None = None           # folder of the written (masked) table, if there is one
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    malformed: DataFrame | None = None   # rows (record, problem) of the input that aren't in the table, where a file was read
    n_malformed: int = 0

    def cleanup(self) -> None:
        """Removes the written table below the checkpoint folder; ``data`` can't be read afterwards."""
        if self.written:
            remove_folder(self.data.sparkSession, self.written)
            self.written = None

    def log_frame(self, spark) -> DataFrame:
        return log_frame(spark, self.log)

    def append_log(self, spark, path: str, run_id: str | None = None) -> str:
        """Put this run's log into a Parquet table, one row per step, in the run's own folder: written again (a retried job)
        it replaces itself and no other run. The distinct-count sketches of the report go beside it (see ``united_distinct``).
        Returns the run id."""
        rid = run_id or self.run_id
        frames = {path: self.log_frame(spark)}
        if self.report is not None and self.report.sketches:
            frames[path.rstrip("/") + "_sketches"] = sketch_frame(spark, self.report.sketches)
        for where, frame in frames.items():
            (frame.withColumn("run_id", F.lit(rid)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("run_id").parquet(where))
        return rid

    def run_summary(self, spark) -> DataFrame:
        """Q19: step counts by status, masked columns, features."""
        return log_summary(self.log_frame(spark), len(self.fitted.masks), len(self.fitted.features))

    def masking_summary(self, spark, n: int = 3) -> DataFrame:
        """Column, type, strategy and the first ``n`` masked values, with the clear ones beside them only where
        ``include_originals`` asks for it."""
        f, mo = self.fitted, self.opts.masking_rules
        if not f.masks or f.order_by is None or self.source is None:
            return f.masked_columns(spark)
        filled = f.fill(f.standardize(self.source))
        return mask_summary(filled, f.masks, f.order_by, include_originals=mo.include_originals, n=n, opts=f.mask_opts)

    @property
    def text_report(self) -> str:
        return self.report.text() if self.report else ""


def run(df: DataFrame, opts: PrepOptions = PrepOptions(), *, report: bool = True, materialize: bool = True,
        verdicts: DataFrame | None = None) -> RunResult:
    """Fit, transform, (checkpoint), report. Raises ``PrepError`` with the log on failure."""
    log: list = []
    try:
        fitted = fit(df, opts, log, verdicts=verdicts)
        folder = None
        if materialize and any(s.kind in ("forward_fill", "backward_fill") for s in fitted.fill_plan.steps):
            # an ordered fill shuffles and sorts, so it is written once - masked, no clear value is left behind
            data, folder = write_and_read(fitted.mask(fitted.fill(fitted.standardize(df))))
            data = fitted.add_features(data)
        else:
            data = fitted.transform(df)
        rep = None
        if report:
            t0 = time.time()
            ob = opts.order_by if opts.order_by is not None else None
            ob_after = fitted.order_by
            rep = _report(df, data, ob, ob_after, opts.report_exact_distinct, fitted.unchanged_columns())
            log.append(("quality_report", "success", "quality report done",
                        {"scores": str(rep.scores())}, time.time() - t0))
        return RunResult(data, fitted, fitted.validation, rep, log, df, opts, folder)
    except PrepError:
        raise
    except Exception as e:  # P7: an exception is a failed run with its log
        log.append(("error", "failed", str(e), {}, 0.0))
        raise PrepError(f"processing failed: {e}", log) from e


def _report(before: DataFrame, after: DataFrame, ob_before, ob_after, exact_distinct: bool = False,
            unchanged: frozenset = frozenset()) -> QualityReport:
    if ob_before is None or ob_after is None:
        raise ValueError("the quality report checks first values in row order: pass order_by")
    return quality_report(before, after, ob_before, order_by_after=ob_after, exact_distinct=exact_distinct,
                          unchanged=unchanged)


def run_path(spark, src: str, dst: str, opts: PrepOptions = PrepOptions(), fmt: str | None = None,
             out_fmt: str = "parquet", verdicts: DataFrame | None = None, on_malformed: str = "split") -> RunResult:
    """Read a file or folder, run, write the result (overwrite) to ``dst`` and remove what the run wrote
    below the checkpoint folder: afterwards read ``dst``, not ``data``.

    Records that don't fit the table (see ``sources.io.read_checked``) aren't in it; the result has them and their number, the log
    a step for them. With ``on_malformed="error"`` one such record fails the run."""
    from ..sources.io import check_export_format, read_checked, write_table

    check_export_format(out_fmt)
    if on_malformed not in ("split", "error"):
        raise ValueError("on_malformed is split or error")
    source = read_checked(spark, src, fmt)
    bad = source.count_malformed()
    step = ("reading", "failed" if bad and on_malformed == "error" else "success", f"{bad} malformed records", {"malformed": str(bad)}, 0.0)
    if bad and on_malformed == "error":
        raise PrepError(f"{bad} malformed records in {src}", [step])
    res = run(source.data, opts, verdicts=verdicts)
    if bad:
        res.log.insert(0, step)
    res.malformed, res.n_malformed = source.malformed, bad
    write_table(res.data, dst, out_fmt)
    res.cleanup()
    return res


__all__ = ["fit", "run", "run_path", "log_frame", "log_summary", "united_distinct", "FittedPrep", "RunResult", "PrepError", "PrepOptions", "mask_summary",
           "extract_features", "quality_report"]
