"""Key joins of the corpus: withholding, validation, alignment, lookups, label swaps.

No join here is hinted. The small sides (evaluation rows, vocabularies) are broadcast
by Spark itself when their measured size allows, otherwise AQE runs a sort-merge join
and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scanned_bytes
from .ranking import first_per_key

NATURAL_KEY = ("docid", "subject", "predicate", "object")
KEY_BYTES = 16 << 20  # scanned for one part of a set of keys
GLUE = "||"


def glued_key(*cols: str) -> Column:
    return F.concat_ws(GLUE, *[F.col(c).cast("string") for c in cols])


def withhold_and_dedupe(
    df: DataFrame, gold: DataFrame, keys: Sequence[str] = NATURAL_KEY, row_id: str = "row_id"
) -> DataFrame:
    """Rows whose key is not in ``gold``, first occurrence (by ``row_id``) of each key."""
    held_out = gold.select(*keys).distinct()
    return first_per_key(df.join(held_out, list(keys), "left_anti"), keys, [row_id])


def withhold_counts(df: DataFrame, gold: DataFrame, keys: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """One row (n_total, n_gold_removed, n_duplicates, n_kept), aggregated per key first."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    flag = gold.select(*keys).distinct().withColumn("in_gold", F.lit(True))
    d = per_key.join(flag, list(keys), "left")
    held, free = F.col("in_gold").isNotNull(), F.col("in_gold").isNull()
    zero = F.lit(0)
    return d.agg(
        F.sum("n").alias("n_total"),
        F.coalesce(F.sum(F.when(held, F.col("n"))), zero).alias("n_gold_removed"),
        F.coalesce(F.sum(F.when(free, F.col("n") - 1)), zero).alias("n_duplicates"),
        F.count(F.when(free, 1)).alias("n_kept"),
    )


def strip_links(col: str) -> Column:
    return F.regexp_replace(F.col(col).cast("string"), r"\[\[([^\]]*)\]\]", "$1")


def evaluation_mask(
    df: DataFrame,
    gold: DataFrame,
    keys: Sequence[str] = NATURAL_KEY,
    linked: Sequence[str] = ("subject",),
    out: str = "is_eval",
) -> DataFrame:
    """Add a boolean column: the row's key, link markup removed, is an evaluation key."""

    def normal(c: str) -> Column:
        return strip_links(c) if c in linked else F.col(c).cast("string")

    held_out = gold.select(*[normal(c).alias(f"__{c}") for c in keys]).distinct()
    held_out = held_out.withColumn("__hit", F.lit(True))
    cond = reduce(lambda a, b: a & b, [normal(c) == F.col(f"__{c}") for c in keys])
    return (
        df.join(held_out, cond, "left")
        .withColumn(out, F.col("__hit").isNotNull())
        .drop("__hit", *[f"__{c}" for c in keys])
    )


def withhold_evaluation(df: DataFrame, gold: DataFrame, **kwargs) -> DataFrame:
    return evaluation_mask(df, gold, out="__eval", **kwargs).filter(~F.col("__eval")).drop("__eval")


def one_to_one_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: duplicate keys on either side and left keys without a partner."""
    keys = list(keys)
    lc = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__l"))
    rc = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"))
    both = lc.join(rc, keys, "full")
    return both.agg(
        F.count(F.when(F.col("__l") > 1, 1)).alias("n_left_duplicates"),
        F.count(F.when(F.col("__r") > 1, 1)).alias("n_right_duplicates"),
        F.coalesce(F.sum(F.when(F.col("__r").isNull(), F.col("__l"))), F.lit(0)).alias("n_unmatched"),
    )


def one_to_one_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that fails when a key repeats on either side or finds no partner."""
    report = one_to_one_report(left, right, keys).first()
    if any(report):
        raise ValueError(f"join is not one-to-one: {report.asDict()}")
    return left.join(right, list(keys), "left")


def in_key_parts(rows: DataFrame, keys: Sequence[str], least: int | None = None) -> DataFrame:
    """Rows dealt by key into as many parts as the scanned tables ask for, so that a part keeps its size."""
    size = scanned_bytes(rows)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = least if least and size else n
    return rows.repartition(max(few, -(-size // KEY_BYTES)), *keys)


def key_set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """One row with the number of keys only in ``a`` and only in ``b`` (0, 0 = equal sets).

    Both sides are grouped together once, in as many parts as the scanned tables ask for, so that
    a part keeps its size. A key with a null equals no other side's key, as in a join.
    """
    side = lambda d, c: d.select(*keys, F.lit(c).alias("__side"))
    rows = side(a, 1).unionByName(side(b, 2))
    lone = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in keys])
    has = lambda c: F.max(F.col("__side") == c)
    seen = in_key_parts(rows, keys).groupBy(*keys).agg(has(1).alias("__a"), has(2).alias("__b"))
    return seen.agg(
        F.count_if(F.col("__a") & (~F.col("__b") | lone)).alias("only_left"),
        F.count_if(F.col("__b") & (~F.col("__a") | lone)).alias("only_right"),
    )


def version_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], text: str, words) -> DataFrame:
    """Rows changed between two versions of a table and mean words before and after."""
    a = old.select(*keys, F.col(text).alias("__old"))
    b = new.select(*keys, F.col(text).alias("__new"))
    return a.join(b, list(keys)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(~F.col("__old").eqNullSafe(F.col("__new")), 1)).alias("n_changed"),
        F.avg(words("__old")).alias("mean_words_old"),
        F.avg(words("__new")).alias("mean_words_new"),
    )


def attach_scores(base: DataFrame, scores: DataFrame, name: str, row_id: str = "row_id") -> DataFrame:
    """Score column of a positional score table; a missing position stays null."""
    s = scores.select(row_id, F.col("score").cast("float").alias(f"{name}__score"))
    return base.join(s, row_id, "left")


def alignment_report(
    base: DataFrame, other: DataFrame, verify: Sequence[str], row_id: str = "row_id"
) -> DataFrame:
    """One row: positions in both tables, missing in the other, extra in it, key mismatches."""
    a = base.select(row_id, *[F.col(c).alias(f"__a_{c}") for c in verify], F.lit(1).alias("__a"))
    b = other.select(row_id, *[F.col(c).alias(f"__b_{c}") for c in verify], F.lit(1).alias("__b"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    same = reduce(
        lambda x, y: x & y, [F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")) for c in verify]
    )
    return a.join(b, row_id, "full").agg(
        F.count(F.when(both, 1)).alias("n_aligned"),
        F.count(F.when(F.col("__b").isNull(), 1)).alias("n_missing"),
        F.count(F.when(F.col("__a").isNull(), 1)).alias("n_extra"),
        F.count(F.when(both & ~same, 1)).alias("n_mismatch"),
    )


def merge_sources(
    base: DataFrame,
    sources: dict[str, DataFrame | None],
    columns: dict[str, Sequence[str]],
    verify: Sequence[str] = NATURAL_KEY,
    row_id: str = "row_id",
) -> DataFrame:
    """Merge per-source columns by row id.

    A source that is absent, or too short to hold the row, gives empty strings; a row
    whose verification key differs from the base stops the job.
    """
    out = base
    for name, cols in columns.items():
        src = sources.get(name)
        if src is None:
            out = out.withColumns({c: F.lit("") for c in cols})
            continue
        s = src.select(
            F.col(row_id).alias("__id"),
            *[F.col(c).alias(f"__v_{c}") for c in verify],
            *[F.col(c).cast("string").alias(f"__s_{c}") for c in cols],
        )
        joined = out.join(s, F.col(row_id) == F.col("__id"), "left")
        differs = reduce(
            lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"__v_{c}")) for c in verify]
        )
        guard = F.col("__id").isNotNull() & differs
        message = F.concat(F.lit(f"{name}: key mismatch at row "), F.col(row_id).cast("string"))
        filled = {
            c: F.when(guard, F.raise_error(message)).otherwise(F.coalesce(f"__s_{c}", F.lit("")))
            for c in cols
        }
        out = joined.withColumns(filled).drop(
            "__id", *[f"__v_{c}" for c in verify], *[f"__s_{c}" for c in cols]
        )
    return out


def attach_signal(
    base: DataFrame, signal: DataFrame, columns: Sequence[str], keys: Sequence[str] = NATURAL_KEY
) -> DataFrame:
    """Left join of a signal table by key; a right key that repeats multiplies rows."""
    return base.join(signal.select(*keys, *columns), list(keys), "left")


def attach_first(
    base: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence
) -> DataFrame:
    """Left join to the right side reduced to its first row per key."""
    return base.join(first_per_key(other, keys, order).select(*keys, *columns), list(keys), "left")


def recover_text(
    items: DataFrame,
    corpus: DataFrame,
    item_id: str = "item_id",
    alternate: str = "alt_subject",
    row_id: str = "row_id",
    keys: Sequence[str] = NATURAL_KEY,
) -> DataFrame:
    """Text of the earliest corpus row matching an item on its subject or alternate subject.

    Adds ``text`` (falling back to the item's own) and ``text_found``.
    """
    rest = [k for k in keys if k != "subject"]
    subjects = F.array_distinct(
        F.filter(F.array("subject", alternate), lambda s: s.isNotNull() & (s != ""))
    )
    wanted = items.select(item_id, *rest, F.explode(subjects).alias("subject"))
    hits = corpus.select(*keys, row_id, F.col("text").alias("__text"))
    found = (
        hits.join(wanted, list(keys)).groupBy(item_id).agg(F.min_by("__text", row_id).alias("__found"))
    )
    joined = items.join(found, item_id, "left")
    return joined.withColumns(
        {"text_found": F.col("__found").isNotNull(), "text": F.coalesce("__found", "text")}
    ).drop("__found")


def swap_labels(
    df: DataFrame,
    labels: DataFrame,
    keys: Sequence[str] = ("docid", "predicate", "object"),
    label: str = "label",
    new_label: str = "new_label",
    row_id: str = "row_id",
) -> DataFrame:
    """Replace ``label`` by the joined one; the last row wins on a repeated key and a row
    without a match keeps its label. Adds ``label_joined`` and ``label_changed``."""
    known = labels.filter(F.col(new_label).isNotNull())
    last = known.groupBy(*keys).agg(F.max_by(new_label, row_id).cast("int").alias("__new"))
    joined = df.join(last, list(keys), "left")
    hit = F.col("__new").isNotNull()
    return (
        joined.withColumn("label_joined", hit)
        .withColumn("label_changed", hit & ~F.col("__new").eqNullSafe(F.col(label)))
        .withColumn(label, F.coalesce("__new", label))
        .drop("__new")
    )


def swap_counts(swapped: DataFrame) -> DataFrame:
    return swapped.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("label_joined").alias("n_joined"),
        F.count_if("label_changed").alias("n_changed"),
        F.count_if(~F.col("label_joined")).alias("n_missing"),
    )


def resume_columns(base: DataFrame, earlier: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Bring over only the columns ``base`` lacks, if both tables hold equally many rows.

    ``resume_status`` says what was done: ``merged``, ``nothing new`` or ``row counts differ``
    (then no column is taken).
    """
    new = [c for c in earlier.columns if c not in base.columns]
    if not new:
        return base.withColumn("resume_status", F.lit("nothing new"))
    if base.count() != earlier.count():
        return base.withColumn("resume_status", F.lit("row counts differ"))
    merged = base.join(earlier.select(row_id, *new), row_id, "left")
    return merged.withColumn("resume_status", F.lit("merged"))


def join_predictions(
    predictions: DataFrame, gold: DataFrame, labels: Sequence[str], pred: str = "prediction"
) -> DataFrame:
    """Predictions with their non-empty gold label by id, and whether the text maps to a label."""
    g = gold.filter(F.col("gold").isNotNull() & (F.col("gold") != "")).select("id", "gold")
    return predictions.join(g, "id").withColumn("mappable", F.col(pred).isin(*labels))


def restrict_to_vocabulary(df: DataFrame, vocabulary: DataFrame, column: str = "predicate"):
    return df.join(vocabulary.select(column).distinct(), column, "left_semi")
