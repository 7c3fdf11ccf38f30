"""What changed between consecutive full snapshots.

`bag_residues` is EXCEPT ALL in both directions in one aggregate: every row counts +1 in the later and -1 in the earlier
snapshot, and only rows whose counts do not cancel stay. `label_residues` full-joins the two residues by key. Rows that are
alike in both snapshots, nearly all of them, end in the aggregate and never reach the join.

Defined cases: rows repeated alike in both snapshots cancel one by one; a key that is null is a key like any other; an empty
snapshot yields only additions or only removals; columns other than keys and values are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.core.runtime import broadcast_checked, durable


def bag_residues(signed: DataFrame, columns: list[str], sign: str) -> DataFrame:
    """`columns` plus `copies`: by how many the later (> 0) or the earlier (< 0) snapshot has more of the row."""
    return signed.groupBy(*columns).agg(F.sum(sign).alias("copies")).filter(F.col("copies") != 0)


def label_residues(residues: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key that differs: `keys`, `change_kind`, of each value its `old_` and `new_` side, and how many rows of a side are in no pair (`old_rows`, `new_rows`).

    With several rows of one key on a side, the greatest counts; the others show in `old_rows` and `new_rows`.
    The residues are few and read twice, so they are cut off from the plan that makes them.
    """
    residues = durable(residues)

    def side(wanted: Column, name: str) -> DataFrame:
        rows = residues.filter(wanted).groupBy(*keys).agg(F.max(F.struct(F.lit(1).alias("_there"), *values)).alias(name), F.sum(F.abs("copies")).alias(f"{name}_rows"))
        return rows.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], name, f"{name}_rows")

    new, old = side(F.col("copies") > 0, "new"), side(F.col("copies") < 0, "old")
    met = new.join(old, [F.col(f"_new_{k}").eqNullSafe(F.col(f"_old_{k}")) for k in keys], "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return met.select(
        *[F.when(F.col("new").isNotNull(), F.col(f"_new_{k}")).otherwise(F.col(f"_old_{k}")).alias(k) for k in keys],
        kind.alias("change_kind"),
        *[F.col(f"{s}.{v}").alias(f"{s}_{v}") for v in values for s in ("old", "new")],
        *[F.coalesce(f"{s}_rows", F.lit(0)).alias(f"{s}_rows") for s in ("old", "new")],
    )


def snapshot_diff(earlier: DataFrame, later: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Added, removed and changed keys between two full snapshots."""
    both = later.select(*keys, *values, F.lit(1).alias("_sign")).unionAll(earlier.select(*keys, *values, F.lit(-1).alias("_sign")))
    return label_residues(bag_residues(both, [*keys, *values], "_sign"), keys, values)


def latest_runs(runs: DataFrame) -> DataFrame:
    """One row per `run_id`: the delivery with the greatest `loaded_at` (on a tie the one with the greatest fingerprints)."""
    kept = ["loaded_at", "fingerprints", "run_ts", "source", "label"]
    return runs.groupBy("run_id").agg(F.max(F.struct(*kept)).alias("r")).select("run_id", *[f"r.{c}" for c in kept[1:]])


def ordered_runs(runs: DataFrame) -> DataFrame:
    """`run_id, source, label, seq, earlier_run, later_run`: the runs of one (source, label) in order of time."""
    by_time = Window.partitionBy("source", "label").orderBy("run_ts", "run_id")
    return runs.select(
        "run_id", "source", "label", F.row_number().over(by_time).alias("seq"), F.lag("run_id").over(by_time).alias("earlier_run"), F.lead("run_id").over(by_time).alias("later_run")
    )


def known_revision(revision: Column) -> Column:
    """The revision without what does not count in a comparison; null where it says nothing (null, blank, `error: ...`)."""
    bare = F.regexp_replace(F.lower(revision), r'^[\s"]*(?:w/)?[\s"]*|[\s"]+$', "")
    return F.when((bare != "") & ~bare.startswith("error:"), bare)


def shifted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as +1 of its own run and as -1 of the next one, so that both snapshots of every pair come from one scan.

    A first run has nothing to be compared with and gives no +1.
    """
    at = F.array(
        F.struct(F.when(F.col("earlier_run").isNotNull(), F.col("run_id")).alias("run_id"), F.lit(1).alias("sign")),
        F.struct(F.col("later_run").alias("run_id"), F.lit(-1).alias("sign")),
    )
    return rows.select(*columns, F.inline(at)).filter(F.col("run_id").isNotNull())


def page_changes(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """`run_id, path, change_kind, old_revision, new_revision` between consecutive runs of one (source, label).

    Hashing once by (source, path) serves every step: the choice among several rows of a path, the window that carries the last
    known revision along while the page stays, and the aggregate of the signed rows. A row whose run is not in `runs` has no
    place in time and is left out. On equal `fetched_at` the greatest `loaded_at`, then revision, counts.
    """
    order = broadcast_checked(ordered_runs(latest_runs(runs)))
    rows = snapshots.select("run_id", "path", "fetched_at", "loaded_at", "revision").join(order, "run_id")
    rows = rows.repartition("source", "path")
    one = rows.groupBy("source", "path", "label", "run_id", "seq", "earlier_run", "later_run").agg(F.max(F.struct("fetched_at", "loaded_at", "revision")).alias("r"))
    one = one.withColumn("known", known_revision(F.col("r.revision")))
    history = Window.partitionBy("source", "path", "label").orderBy("seq")
    one = one.withColumn("stay", F.col("seq") - F.row_number().over(history))
    carried = Window.partitionBy("source", "path", "label", "stay").orderBy("seq")
    one = one.withColumn("revision", F.last("known", ignorenulls=True).over(carried))
    signed = shifted(one, ["source", "path", "revision"])
    found = label_residues(bag_residues(signed, ["source", "path", "run_id", "revision"], "sign"), ["source", "run_id", "path"], ["revision"])
    return found.filter("change_kind <> 'changed' OR (old_revision IS NOT NULL AND new_revision IS NOT NULL)").drop("source", "old_rows", "new_rows")


def fingerprint_changes(runs: DataFrame) -> DataFrame:
    """`run_id, fingerprint, change_kind` against the nearest earlier run whose checks finished."""
    done = latest_runs(runs).filter(F.col("fingerprints").isNotNull())
    rows = done.select("run_id", F.explode("fingerprints").alias("fingerprint")).distinct()
    return run_set_changes(rows, done, "fingerprint")


def finding_changes(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """`run_id, fingerprint, change_kind` from the findings themselves; runs without finished checks do not take part."""
    done = latest_runs(runs).filter(F.col("fingerprints").isNotNull())
    rows = findings.select("run_id", F.concat_ws(":", F.coalesce("kind", F.lit("")), F.coalesce("check_id", F.lit("")), F.coalesce("page", F.lit(""))).alias("fingerprint")).distinct()
    return run_set_changes(rows, done, "fingerprint")


def run_set_changes(rows: DataFrame, runs: DataFrame, item: str) -> DataFrame:
    """Items of (`run_id`, item) that appeared or vanished between consecutive runs."""
    signed = shifted(rows.join(broadcast_checked(ordered_runs(runs)), "run_id"), [item])
    return label_residues(bag_residues(signed, ["run_id", item], "sign"), ["run_id", item], []).select("run_id", item, "change_kind")


def found_changes(snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """`run_id, entity, record_key, change_kind` of pages and fingerprints."""
    pages = page_changes(snapshots, runs).select("run_id", F.lit("page").alias("entity"), F.col("path").alias("record_key"), "change_kind")
    prints = fingerprint_changes(runs).select("run_id", F.lit("fingerprint").alias("entity"), F.col("fingerprint").alias("record_key"), "change_kind")
    return pages.unionByName(prints)
