"""The batch tools: python -m phenogrid TOOL ... reads a profile store (or plates) and writes a profile store.

Each tool is one job of the library; options are named as the operators' parameters."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from phenogrid.operators import batch, group, scale, tracking
from phenogrid.plans import pipelines
from phenogrid.profile import Profile
from phenogrid.sources import plates

Args = argparse.Namespace


def store_plates(spark: SparkSession, a: Args) -> Profile:
    return plates.load_plates(spark, a.inp, a.files, a.suffix, a.delimiter, a.layout)


def collect(spark: SparkSession, a: Args) -> Profile:
    """The rows of several stores, with the columns that all have."""
    held = [plates.read_profile(spark, path) for path in a.inp]
    feats = [f for f in held[0].features if all(f in p.features for p in held)]
    return Profile(plates.concat([p.df for p in held]), feats, [r for r in held[0].reps if all(r in p.reps for p in held)], held[0].row_id)


def clean(spark: SparkSession, a: Args) -> Profile:
    return pipelines.clean_data(plates.read_profile(spark, a.inp), a.min_share, a.freq_thresh, a.unique_thresh)


def normalize(spark: SparkSession, a: Args) -> Profile:
    p = plates.read_profile(spark, a.inp)
    return p.pipe(scale.normalize, p.features, a.by, a.method, a.pop_var, a.norm_pop, drop_missing=a.drop_missing)


def aggregate(spark: SparkSession, a: Args) -> Profile:
    p = plates.read_profile(spark, a.inp)
    if a.method.startswith("modz"):
        return replace(p, df=group.aggregate_modz(p.df, a.by, p.features, "spearman" if a.method == "modz-spearman" else "pearson", row_id=p.row_id), reps=[], row_id=a.by[-1])
    df = group.aggregate(p.df, a.by, p.features, a.method, obs=a.keep, count=True, min_cells=a.min_cells, row_id=p.row_id)
    return replace(p, df=df, reps=[], row_id=a.by[-1])


def subsample(spark: SparkSession, a: Args) -> Profile:
    p = plates.read_profile(spark, a.inp)
    return p.pipe(group.subsample, a.by, a.perc, p.row_id, a.seed, a.grouped)


def pseudostitch(spark: SparkSession, a: Args) -> Profile:
    p = plates.read_profile(spark, a.inp)
    return p.pipe(batch.pseudostitch, a.tile, a.x, a.y, tuple(a.grid), tuple(a.image), a.overlap, a.reading)


def track(spark: SparkSession, a: Args) -> Profile:
    p = plates.read_profile(spark, a.inp)
    found = tracking.track(p.df, a.time, a.by, a.x, a.y, p.row_id)
    return replace(p, df=p.df.join(found.drop(*[c for c in found.columns if c != p.row_id and c in p.df.columns]), p.row_id, "left"))


def split(spark: SparkSession, a: Args) -> Profile:
    """Writes the test part beside, at OUT-test; returns the training part."""
    train, test = pipelines.split(plates.read_profile(spark, a.inp), a.test_size, a.stratify, a.group_by, a.seed)
    plates.write_profile(test, f"{a.out}-test", mode=a.mode)
    return train


def recipe(spark: SparkSession, a: Args) -> Profile:
    with open(a.config) as f:
        options = json.load(f)
    return pipelines.profile_recipe(plates.read_profile(spark, a.inp), **options)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="phenogrid", description=__doc__)
    tools = out.add_subparsers(dest="tool", required=True)

    def tool(name: str, run: Callable, *options: tuple, many: bool = False) -> None:
        one = tools.add_parser(name, description=run.__doc__)
        one.add_argument("inp", nargs="+" if many else None, help="stores" if many else "store, or folder of plates")
        one.add_argument("out", help="store to write")
        one.add_argument("--mode", default="error", choices=["error", "overwrite"])
        one.add_argument("--partition-by", nargs="*", default=[])
        for flag, settings in options:
            one.add_argument(flag, **settings)
        one.set_defaults(run=run)

    by = ("--by", {"nargs": "+", "default": ["BatchNumber", "PlateNumber"]})
    seed = ("--seed", {"type": int, "default": 0})
    at = [("--x", {"default": "Cells_Location_Center_X"}), ("--y", {"default": "Cells_Location_Center_Y"})]
    tool("store-plates", store_plates, ("--files", {"nargs": "+", "default": ["Cells", "Primarieswithoutborder", "Cytoplasm"]}), ("--suffix", {"default": ".csv"}), ("--delimiter", {"default": ","}), ("--layout", {}))
    tool("collect", collect, many=True)
    tool("clean", clean, ("--min-share", {"type": float}), ("--freq-thresh", {"type": float, "default": 0.05}), ("--unique-thresh", {"type": float, "default": 0.01}))
    tool("normalize", normalize, by, ("--method", {"default": "standard", "choices": ["standard", "robust", "mad_robust", "min_max"]}), ("--pop-var", {}), ("--norm-pop", {}), ("--drop-missing", {"action": "store_true"}))
    tool("aggregate", aggregate, by, ("--method", {"default": "median", "choices": ["mean", "median", "modz", "modz-spearman"]}), ("--keep", {"nargs": "*", "default": []}), ("--min-cells", {"type": int}))
    tool("subsample", subsample, by, ("--perc", {"type": float, "default": 0.1}), ("--grouped", {}), seed)
    tool("pseudostitch", pseudostitch, ("--tile", {"default": "Metadata_Field"}), *at, ("--grid", {"type": int, "nargs": 2, "default": [5, 5]}), ("--image", {"type": int, "nargs": 2, "default": [2048, 2048]}), ("--overlap", {"type": float, "default": 0.2}), ("--reading", {"default": "horizontal", "choices": list(batch.READINGS)}))
    tool("track", track, by, ("--time", {"default": "Metadata_Timepoint"}), *at)
    tool("split", split, ("--test-size", {"type": float, "default": 0.2}), ("--stratify", {}), ("--group-by", {}), seed)
    tool("recipe", recipe, ("--config", {"required": True, "help": "JSON file of the recipe's options"}))
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"phenogrid {args.tool}").getOrCreate()
    plates.write_profile(args.run(spark, args), args.out, args.partition_by, args.mode)


if __name__ == "__main__":
    main()
