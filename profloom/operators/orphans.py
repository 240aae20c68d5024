"""References to records that do not exist: missing, withdrawn or later-loaded parents.

References are grouped by their null mask (which of their key columns are null); each mask is
looked up on its non-null columns only, under a declared match semantics:

``simple``   a reference with any null column is no reference;
``partial``  a reference must match a parent on its non-null columns, all null is no reference;
``full``     a reference must be null in all columns or in none; a mixed one is ``missing``.

Defined cases: empty child tables give no rows; with an empty parent table every reference is
``missing``; repeated child rows count once, by the earliest load (ties: the smallest reference);
rows without a load time are used only if a key has no other, have a null period and are never
``late``; columns that are not named are not read, so clashing names do no harm.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def earliest_children(df: DataFrame, key: list[str], reference: list[str], time: str) -> DataFrame:
    """One row per ``key``: its row of earliest ``time``, with ``reference`` columns as loaded then.

    Partial aggregation runs before the shuffle, so a key repeated very often costs one row per task.
    """
    extra = [c for c in reference if c not in key]
    first = F.min(F.struct(F.col(time).isNull(), F.col(time).alias("t"), *(F.col(c).alias(f"r{i}") for i, c in enumerate(extra))))
    return (
        df.groupBy(*key).agg(first.alias("__first"))
        .select(*key, F.col("__first.t").alias(time), *(F.col(f"__first.r{i}").alias(c) for i, c in enumerate(extra)))
    )


def parent_states(df: DataFrame, key: list[str], time: str, removed: str | None = None) -> DataFrame:
    """One row per parent key: ``live_from`` (earliest load of a row not removed) and ``is_live``."""
    live = F.lit(True) if removed is None else F.col(removed).isNull()
    return df.groupBy(*key).agg(F.min(F.when(live, F.col(time))).alias("live_from"), F.max(live).alias("is_live"))


def _state(time: Column) -> Column:
    return (
        F.when(F.col("is_live").isNull(), "missing")
        .when(~F.col("is_live"), "removed")
        .when(F.col("live_from") > time, "late")
    )


def find_orphans(
    children: DataFrame,
    parents: DataFrame,
    on: list[tuple[str, str]],
    time: str,
    match: str = "simple",
    never_null: tuple[str, ...] = (),
) -> DataFrame:
    """The rows of ``children`` whose reference is broken, with ``state`` added.

    ``never_null`` names columns of ``children`` that hold no nulls, so that no mask needs to tell them.

    ``parents`` is the result of :func:`parent_states`, ``on`` pairs child with parent columns.
    The one large shuffle carries narrow child rows by reference; a parent with very many children
    is split at run time by adaptive skew handling, as nothing after the join needs its partitioning.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    names = children.columns
    bit = lambda c: F.lit("1") if c in never_null else F.when(F.col(c).isNull(), "0").otherwise("1")
    masked = children.withColumns({"__mask": F.concat(*(bit(c) for c, _ in on))})
    branches = []
    for bits in product(*("1" if c in never_null else "01" for c, _ in on)):
        mask, used = "".join(bits), [pair for pair, bit in zip(on, bits) if bit == "1"]
        if not used or (match == "simple" and len(used) < len(on)):
            continue
        rows = masked.where(F.col("__mask") == mask)
        if len(used) == len(on):
            known = parents
        elif match == "full":
            branches.append(rows.select(*names, F.lit("missing").alias("state")))
            continue
        else:
            known = parents.groupBy(*(p for _, p in used)).agg(F.min("live_from").alias("live_from"), F.max("is_live").alias("is_live"))
        side = known.select(*(F.col(p).alias(f"__p{i}") for i, (_, p) in enumerate(used)), F.xxhash64(*(p for _, p in used)).alias("__hash"), "live_from", "is_live")
        condition = [F.col(c) == F.col(f"__p{i}") for i, (c, _) in enumerate(used)]
        # the hash as a further key: parents are exchanged anew and not taken as their reduction left them, as only
        # a join of two plain exchanges is split by adaptive skew handling
        condition.append(F.xxhash64(*(c for c, _ in used)) == F.col("__hash"))
        branches.append(
            rows.join(side, condition, "left").withColumn("state", _state(F.col(time))).where(F.col("state").isNotNull()).select(*names, "state")
        )
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per child table, parent table, state and period."""
    return orphans.groupBy("child_name", "parent_name", "state", "period").agg(F.count("*").alias("n_orphans"))


def profile_orphans(image: DataFrame, nuclei: DataFrame, ph3: DataFrame) -> DataFrame:
    """Broken references among the three profile tables, one row per child key and parent table.

    ph3 and nuclei refer to image by (TableNumber, ImageNumber); ph3 refers to nuclei by these and
    Parent_Nuclei, where null and 0 are no reference. nuclei is reduced once and serves both as child
    and as parent.
    """
    image_key, object_key = ["TableNumber", "ImageNumber"], ["TableNumber", "ImageNumber", "ObjectNumber"]
    keyed = "TableNumber IS NOT NULL AND ImageNumber IS NOT NULL"  # under simple match all others refer to nothing
    images = parent_states(image, image_key, "loaded_at", "removed_at")
    # Both uses of nuclei and both of ph3 have the same filters, so each is read, reduced and exchanged once. Nuclei
    # without object number are children only; where there are none, the files' statistics tell so.
    objects = parent_states(nuclei.where(f"{keyed} AND ObjectNumber IS NOT NULL"), object_key, "loaded_at", "removed_at")
    nameless = parent_states(nuclei.where(f"{keyed} AND ObjectNumber IS NULL"), object_key, "loaded_at", "removed_at")
    marks = earliest_children(ph3.where(keyed), object_key, ["Parent_Nuclei"], "loaded_at")

    shape = [F.col("TableNumber").alias("t"), F.col("ImageNumber").alias("i"), F.col("ObjectNumber").alias("o")]
    from_ph3 = marks.select(F.lit("ph3").alias("child_name"), *shape, F.col("loaded_at").alias("at"))
    from_nuclei = [df.where("is_live").select(F.lit("nuclei").alias("child_name"), *shape, F.col("live_from").alias("at")) for df in (objects, nameless)]
    to_image = find_orphans(
        from_ph3.unionByName(from_nuclei[0]).unionByName(from_nuclei[1]), images, [("t", "TableNumber"), ("i", "ImageNumber")], "at", never_null=("t", "i")
    ).withColumn("parent_name", F.lit("image"))

    refs = marks.select(F.lit("ph3").alias("child_name"), *shape, F.col("loaded_at").alias("at"), F.when(F.col("Parent_Nuclei") != 0, F.col("Parent_Nuclei")).alias("ref"))
    to_nuclei = find_orphans(
        refs, objects, [("t", "TableNumber"), ("i", "ImageNumber"), ("ref", "ObjectNumber")], "at", never_null=("t", "i")
    ).drop("ref").withColumn("parent_name", F.lit("nuclei"))

    return to_image.unionByName(to_nuclei).select(
        "child_name", "parent_name",
        F.col("t").alias("table_number"), F.col("i").alias("image_number"), F.col("o").alias("object_number"),
        "state", F.date_format("at", "yyyy-MM").alias("period"),
    )
