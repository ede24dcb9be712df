"""Operator 10 - quality rules: cross-document line frequency per host, with per-document base counts.

Lines are normalised (A-Z lower-cased, digits to 0, white space collapsed) and hashed. For each host the distinct
documents (distinct texts, so exact copies count once) that hold a line are counted; a line is removed where it is
in at least ``min_docs`` of them and in more than ``max_share`` of the host's distinct documents, or in ``max_docs`` of
them whatever their share. The query keeps to the limits of its SQL, which has no ``max_docs``; the pipeline takes
``HOSTS``, which holds for hosts of any size. A document that loses more than ``max_removed`` of its words is depleted and rejected.

Built from DataFrame functions only. The per-document counts never shuffle a text; the frequency part shuffles
hashes (host, line, text), with partial aggregation, so a line or host with a third of all rows is a few rows a task.

Defined results: null text is an empty text (no words, so the base rule rejects it); a null host is a host of its
own; rows with equal id, host and text get equal results, one output row each; any further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, WS_RUN, ascii_lower, table, words

SYMBOLS = "#*$%&|<>"   # fixed by the contract
POS_BITS = 31


@dataclass(frozen=True)
class LineLimits:
    max_share: float = 0.10     # of the distinct documents of the host
    min_docs: int = 20          # below this many documents no line is frequent
    max_removed: float = 0.5    # share of a document's words; above it the document is depleted
    max_docs: int | None = None     # from this many distinct documents of the host on, a line is frequent at any share


HOSTS = LineLimits(min_docs=5, max_docs=100)    # small hosts have frequent lines, and so do hot ones


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from the column ``w``: words covered by a 3-word window found twice or more.

    Each window is one long: 33 bits of its hash and its position. Sorting the longs puts equal hashes side by side;
    the few windows whose hash bits are shared are compared again by their words, so the count is exact."""
    n = F.size("w")
    at = lambda i: F.get(F.col("w"), i)
    low = F.lit((1 << POS_BITS) - 1).cast("long")
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(at(i), at(i + 1), at(i + 2)), POS_BITS).bitwiseOR(i.cast("long")))
    df = df.withColumn("s", F.sort_array(F.when(n >= 3, packed).otherwise(F.array().cast("array<bigint>"))))
    near = lambda x, y: x.bitwiseXOR(y).between(0, (1 << POS_BITS) - 1)
    cand = F.filter("s", lambda x, i: near(x, F.get(F.col("s"), i - 1)) | near(x, F.get(F.col("s"), i + 1)))
    df = df.withColumn("p", F.transform(cand, lambda x: x.bitwiseAND(low).cast("int")))
    named = F.transform("p", lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("k"), i.alias("i")))
    df = df.withColumn("e", F.sort_array(named))
    key = lambda i: F.get(F.col("e"), i)["k"]
    same = F.filter("e", lambda x, i: (x["k"] == key(i - 1)) | (x["k"] == key(i + 1)))
    df = df.withColumn("r", F.sort_array(F.transform(same, lambda x: x["i"])))
    spans = F.transform("r", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("r"), i + 1) - x, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)).drop("s", "p", "e", "r")


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(WS)) != ""


def normal_line(line: Column) -> Column:
    t = F.btrim(F.regexp_replace(ascii_lower(line), WS_RUN, " "), F.lit(" "))
    return F.translate(t, "123456789", "000000000")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word_chars, n_symbols, n_dup_lines, n_words, n_repeat_words and base_failed (no shuffle)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("w", words(F.col(text)))
    df = df.withColumn("ln", F.filter(F.split(t, "\n"), has_word))
    df = _repeat_words(df)
    n = F.size("w").cast("long")
    return (df.withColumn("n_words", n)
            .withColumn("word_chars", F.length(F.translate(t, WS, "")).cast("long"))
            .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long"))
            .withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
            .drop("w", "ln"))


def frequent_lines(docs: DataFrame, limits: LineLimits, id_col: str, text: str, host: str) -> DataFrame:
    """Rows (id, host key, text hash, position, words) of every line that goes."""
    lines = _keyed(docs, id_col, text, host).select(
        "_id", "_h", "_t", F.posexplode(F.split(F.coalesce("_text", F.lit("")), "\n")).alias("pos", "line"))
    lines = lines.where(has_word(F.col("line"))).select(
        "_id", "_h", "_t", "pos", F.xxhash64(normal_line(F.col("line"))).alias("_l"),
        F.size(F.split(F.btrim("line", F.lit(WS)), WS_RUN)).alias("lw"))
    seen = lines.select("_h", "_l", "_t").distinct().groupBy("_h", "_l").agg(F.count("*").alias("n"))
    hosts = _keyed(docs, id_col, text, host).select("_h", "_t").distinct().groupBy("_h").agg(F.count("*").alias("n_docs"))
    often = (F.col("n") >= limits.min_docs) & (F.col("n") > limits.max_share * F.col("n_docs"))
    if limits.max_docs is not None:
        often |= F.col("n") >= limits.max_docs
    least = min(limits.min_docs, limits.max_docs or limits.min_docs)
    seen = seen.where(F.col("n") >= least).join(hosts, "_h").where(often)
    return lines.join(seen.select("_h", "_l"), ["_h", "_l"], "leftsemi").dropDuplicates(["_id", "_h", "_t", "pos"])


def _host(host: str) -> Column:
    return F.when(F.col(host).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(host).cast("string")))


def _keyed(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), _host(host).alias("_h"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))


def quality_rules(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", text: str = "text",
                  host: str = "source") -> DataFrame:
    """One row per row of ``docs``: the id, the base counts, ``n_removed_words`` and ``kept``."""
    df = docs.select(F.col(id_col).alias("_kid"), _host(host).alias("_kh"), F.col(text).alias("_ktext"))
    return _judged(df, docs, limits, id_col, text, host).drop("_pos").withColumnRenamed("_kid", id_col)


def kept_documents(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", text: str = "text",
                   host: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and without the frequent lines in their text."""
    df = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_kid"), _host(host).alias("_kh"), F.col(text).alias("_ktext"))
    out = _judged(df, docs, limits, id_col, text, host).where("kept")
    t = F.col("_row")[text]
    left = F.array_join(F.filter(F.split(t, "\n"), lambda x, i: ~F.array_contains("_pos", i)), "\n")
    out = out.withColumn("_left", F.when(F.col("_pos").isNull(), t).otherwise(left))
    return out.select(*(F.col("_left").alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns))


def _judged(df: DataFrame, docs: DataFrame, limits: LineLimits, id_col: str, text: str, host: str) -> DataFrame:
    gone = frequent_lines(docs, limits, id_col, text, host).groupBy("_id", "_h", "_t").agg(
        F.sum("lw").cast("long").alias("_rw"), F.collect_list("pos").alias("_pos"))
    out = base_counts(df, "_ktext").withColumn("_kt", F.xxhash64("_ktext")).drop("_ktext")
    on = F.col("_kid").eqNullSafe(F.col("_id")) & (F.col("_kh") == F.col("_h")) & (F.col("_kt") == F.col("_t"))
    out = out.join(gone, on, "left").drop("_id", "_h", "_t", "_kh", "_kt")
    out = out.withColumn("n_removed_words", F.coalesce("_rw", F.lit(0).cast("long"))).drop("_rw")
    # one comparison over both sides of the join: as two, a filter on it would be pushed below and repeat the counts' plans
    most = F.when(F.col("base_failed"), F.lit(-1.0)).otherwise(limits.max_removed * F.col("n_words"))
    return out.withColumn("kept", F.col("n_removed_words") <= most)


def op10_line_frequency(spark, sf_dir):
    df = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     "n_removed_words", "kept")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('+' || source, '-') AS h, text FROM documents),
w AS (SELECT doc_id, t, h, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
pos AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, x || ' ' || lead(x) OVER p || ' ' || lead(x, 2) OVER p AS k FROM pos
        WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win WHERE k IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, h, t, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT doc_id, h, t, l, translate(trim(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '123456789', '000000000') AS k,
         len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS lw
       FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
freq AS (SELECT h, k, count(DISTINCT t) AS n FROM lw GROUP BY h, k),
hosts AS (SELECT h, count(DISTINCT t) AS n_docs FROM d GROUP BY h),
bad AS (SELECT h, k FROM freq JOIN hosts USING (h) WHERE n >= 20 AND n > 0.10 * n_docs),
rem AS (SELECT doc_id, sum(lw) AS n FROM lw JOIN bad USING (h, k) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lw GROUP BY doc_id),
f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept FROM f
"""

QUERIES = {"op10_line_frequency": op10_line_frequency}
ORACLE = {"op10_line_frequency": OP10_SQL}
