"""The batch tools and the recipe as functions from profile to profile. Job boundaries are where the list of features depends on the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import functions as F

from phenogrid.functions import expr as X
from phenogrid.functions.scratch import cut
from phenogrid.operators import clean, features, group, models, scale, threshold
from phenogrid.profile import Profile


def clean_data(p: Profile, min_share: float | None = None, freq_thresh: float = 0.05, unique_thresh: float = 0.01) -> Profile:
    """Missing features, then rows; duplicate features, then rows; constant features, then rows; features of near-zero variance."""
    p = replace(p, df=X.ingest(p.df, p.features))
    gone = clean.missing_features(p.df, p.features, min_share)
    p = p.select([f for f in p.features if f not in gone])
    p = p.pipe(clean.drop_missing_rows, p.features)
    twice = [r.feature for r in clean.duplicate_features(p.df, p.features, p.row_id).collect()]
    p = p.select([f for f in p.features if f not in twice])
    p = p.pipe(clean.drop_duplicate_rows, p.features, p.row_id).pipe(cut)  # the scans that follow read what is left
    same = clean.invariant_features(p.df, p.features)
    p = p.select([f for f in p.features if f not in same])
    p = p.pipe(clean.drop_invariant_rows, p.features)
    df, left = features.project(p.df, p.features, features.near_zero_variance(p.df, p.features, freq_thresh, unique_thresh))
    flat = [f for f in p.features if f not in left]
    return replace(p, df=df, features=left).note(missing=gone, duplicates=twice, invariant=same, near_zero_variance=flat)


def plate_profiles(p: Profile, by: Sequence[str], well: str, pop_var: str, control: object, min_cells: int) -> Profile:
    """Control-normalised profiles: complete rows, robust MAD against each plate's controls, median by well with counts, wells with enough objects."""
    df = clean.drop_missing_rows(p.df, p.features)
    df = scale.normalize(df, p.features, by, "mad_robust", pop_var, control)
    return replace(p, df=group.aggregate(df, [*by, well], p.features, "median", count=True, min_cells=min_cells, row_id=p.row_id), row_id=well)


def profile_recipe(p: Profile, by: Sequence[str], well: str, treat: str, dose: str, area: str, nucleus: str, dna: str, dna_total: str, control: object = "ctrl", min_cells: int = 200, k: int | str = "estimate") -> Profile:
    """The recipe: clean, drop poor wells and debris, keep one cell type, label the cycle, aggregate, normalise, select by mixed model, pool features."""
    df = clean.drop_missing_rows(X.ingest(p.df, p.features), p.features, 0.5)
    gone = clean.missing_features(df, p.features)
    p = replace(p, df=df).select([f for f in p.features if f not in gone])
    p = p.pipe(clean.drop_low_count, [*by, well], min_cells)
    df = clean.ratio(p.df, area, nucleus, "_ratio")
    df = threshold.assign_by_threshold(df, "_ratio", by, "Vital", "otsu", max_val=4.0).filter(F.col("Vital") == 0).drop("_ratio", "Vital")
    df = threshold.assign_by_threshold(df, dna, by, "CellType", "otsu").filter(F.col("CellType") == 0).drop("CellType")
    df = threshold.assign_by_threshold(df, dna_total, by, "Cycle", "otsu")
    wells = group.aggregate(df, [*by, well], p.features, "median", obs=[treat, dose, "Cycle"], row_id=p.row_id, count=True)
    wells = wells.withColumn("row_id", F.concat_ws("-", *[F.col(c).cast("string") for c in (*by, well)]))
    wells = scale.normalize(wells, p.features, by, "mad_robust", treat, control)
    wells = cut(wells)
    usable = [f for f in p.features if f not in clean.missing_features(wells, p.features, 0.5)]
    chosen = models.feature_lmem(wells, usable, treat, dose, by[0], control)
    wells, kept = features.project(wells, p.features, chosen)
    wells = clean.drop_missing_rows(wells, kept)
    if len(kept) > 3:
        wells, pools = models.feature_agglo(wells, kept, k)
        return Profile(wells, list(pools), meta={"agglo": pools})
    return Profile(wells, kept)


def split(p: Profile, test_size: float = 0.2, stratify: str | None = None, group_by: str | None = None, seed: int = 0) -> tuple[Profile, Profile]:
    """(train, test)."""
    df = group.group_shuffle_split(p.df, group_by, test_size, stratify, seed) if group_by else group.train_test_split(p.df, test_size, stratify, p.row_id, seed)
    return replace(p, df=df.filter(~F.col("is_test")).drop("is_test")), replace(p, df=df.filter("is_test").drop("is_test"))
