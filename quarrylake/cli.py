"""Commands: python -m quarrylake.cli manifest | shard | evaluate --help."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F


def manifest(args) -> int:
    """Groups, split, weights and audit of the reports below a folder; train.jsonl, valid.jsonl and audit below the output folder."""
    from quarrylake.operators import split
    from quarrylake.plans.manifest import build
    from quarrylake.session import session
    from quarrylake.sources import files, tables

    spark = session()
    cases = files.discover(spark, args.data_root).withColumn("feature_path", F.concat(F.lit(f"{args.feature_root.rstrip('/')}/"), "case_id", F.lit(args.feature_ending)))
    features = tables.listed(spark, args.feature_root, f"*{args.feature_ending}").select(files.stem(F.col("path"), args.feature_ending).alias("case_id"))
    reports = cases.select("case_id", F.explode("texts").alias("text"))
    problem = tables.discovery_problems(cases, reports, features).first()
    if problem:
        raise ValueError(f"{problem.problem} in case {problem.case_id}")
    m, audit = build(cases, args.valid_fraction, args.seed, args.near_threshold, args.beta, args.min_weight, args.max_weight)
    for part in ("train", "valid"):
        files.write_manifest(m.where(F.col("split") == part), f"{args.output_dir}/{part}.jsonl")
    histograms = split.label_histograms(m)
    tables.write_json(audit.join(histograms, "split", "left"), f"{args.output_dir}/audit.json")
    return 0


def shard(args) -> int:
    """Prints the cases of one shard of the inputs, those done left out."""
    from quarrylake.operators.sampling import shard as part
    from quarrylake.session import session
    from quarrylake.sources import files, tables

    spark = session()
    found = None
    for k, path in enumerate(args.input):
        f = tables.listed(spark, path, "*.nii.gz").select(F.lit(k).alias("input"), "path")
        found = f if found is None else found.unionByName(f)
    rows = part(files.resolve_inputs(tables.expanded(found)), ["case_id", "path"], args.shard_index, args.num_shards).orderBy("case_id")
    if args.limit:
        rows = rows.limit(args.limit)
    for r in rows.toLocalIterator():
        print(r.case_id, r.path, sep="\t")
    return 0


def evaluate(args) -> int:
    """Dice and IoU of predicted against reference label maps, both Parquet of (case_id, z, y, x, label), for each label."""
    from quarrylake.operators import segmentation as S
    from quarrylake.session import session
    from quarrylake.sources import tables

    spark = session()
    v = S.align(*(spark.read.parquet(p) for p in (args.reference, args.predicted)))
    regions = spark.createDataFrame([(k, [k]) for k in args.labels], "region int, labels array<int>")
    tables.write_json(S.mean_per_region(S.confusion(v, regions)), args.output)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylake")
    sub = p.add_subparsers(required=True)
    m = sub.add_parser("manifest", help=manifest.__doc__)
    for name in ("--data-root", "--feature-root", "--output-dir"):
        m.add_argument(name, required=True)
    m.add_argument("--feature-ending", default=".pt")
    for name, kind, value in (("--valid-fraction", float, 0.2), ("--seed", int, 42), ("--near-threshold", float, 0.85), ("--beta", float, 0.99), ("--min-weight", float, 0.25), ("--max-weight", float, 4.0)):
        m.add_argument(name, type=kind, default=value)
    m.set_defaults(run=manifest)
    s = sub.add_parser("shard", help=shard.__doc__)
    s.add_argument("--input", nargs="+", required=True)
    for name, value in (("--num-shards", 1), ("--shard-index", 0), ("--limit", 0)):
        s.add_argument(name, type=int, default=value)
    s.set_defaults(run=shard)
    e = sub.add_parser("evaluate", help=evaluate.__doc__)
    for name in ("--reference", "--predicted", "--output"):
        e.add_argument(name, required=True)
    e.add_argument("--labels", nargs="+", type=int, required=True)
    e.set_defaults(run=evaluate)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
