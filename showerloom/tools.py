"""Command lines: ``python -m showerloom.tools dbscan|clue|grid|store|validate|view``.

Each reads steps (Parquet, or HDF5 where h5py is there), runs the operators and writes Parquet: a point
cloud with its parameters in its schema, the tables of a comparison, those of a picture, or the steps
themselves stored by event.  Reports are printed.  The session comes from the usual Spark settings (``spark-submit`` or the environment).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators import clue as cl
from .operators import dbscan as db
from .operators import grid as gr
from .operators import reduce as rd
from .operators import select as se
from .operators import validate as va
from .operators import view as vw
from .operators.graph import cut_lineage
from .sources.by_event import BUCKETS, store_by_event
from .sources.steps import CARRIER, exists, output_name, read_steps, write_cloud


#: optional columns that a tool can't do without
NEEDED = {"dbscan": ("cell_id", "time", "subdetector"), "clue": ("cell_id", "subdetector"), "grid": ("time",)}
#: what a stored cloud tells beside its parameters
LAYERS = {"layer_bits": {"start": 19, "width": 9}}
FEATURES = {
    "dbscan": LAYERS | {"xy_scale_mm": db.MM, "time_scale_ns": db.NS, "features": "[(x/5mm),(y/5mm),(time-median)/1ns]"},
    "clue": LAYERS | {"xy_scale_mm": cl.MM, "features": "[(x/5mm),(y/5mm)]"},
    "grid": {"features": "[axis layer,(u),(v)]"},
}


def printed(df: DataFrame) -> None:
    """The few rows of a report, one per line."""
    for row in df.collect():
        print(", ".join(f"{k} {v:.6g}" if isinstance(v, float) else f"{k} {v}" for k, v in row.asDict().items() if v is not None))


def clustered(spark: SparkSession, args, tool: str, run, params: dict) -> str:
    """Labels per layer, their cloud and its report; the path written."""
    path = target(spark, args, tool, params)
    steps = read_steps(spark, args.input, need=NEEDED[tool.split("_")[0]])
    names = steps.schema[CARRIER].metadata.get("subdetector_names")
    if args.n_events is not None:
        steps = se.first_n_events(steps, args.n_events)
    labelled = cut_lineage(run(steps))
    cloud = cut_lineage(rd.point_cloud(labelled, se.LAYER_KEYS, ["label"]))
    printed(rd.noise_report(labelled))
    printed(rd.compression_report(labelled, cloud))
    return stored(cloud, path, {"algorithm": tool} | FEATURES[tool.split("_")[0]] | params, names)


def target(spark: SparkSession, args, tool: str, params: dict) -> str:
    """Where the cloud goes; told before any work if something is there already."""
    path = args.output or output_name(args.input, tool, **params, n=args.n_events)
    if exists(spark, path):
        raise FileExistsError(path)
    return path


def stored(cloud: DataFrame, path: str, params: dict, names: dict | None) -> str:
    write_cloud(cloud, path, {k: v for k, v in params.items() if v is not None}, names)
    print(f"written {path}")
    return path


def run_dbscan(spark: SparkSession, args) -> str:
    params = {"eps": args.eps, "min_samples": args.min_samples}
    if args.adaptive:
        params |= {"quantile": args.quantile, "k_core": args.k_core, "k_tail": args.k_tail}
        return clustered(spark, args, "dbscan_adaptive", lambda s: db.dbscan_adaptive(s, **params), params)
    return clustered(spark, args, "dbscan", lambda s: db.dbscan(s, **params), params)


def run_clue(spark: SparkSession, args) -> str:
    params = {k: getattr(args, k) for k in ("dc", "rhoc", "deltac", "outlier_factor", "min_points")}
    params["outlier_factor"] = params["outlier_factor"] or None  # 0: off
    return clustered(spark, args, "clue", lambda s: cl.clue(s, **params, exact=args.exact), params)


def run_grid(spark: SparkSession, args) -> str:
    gate = {k: getattr(args, k) for k in ("bridge_energy_factor", "similarity_ratio", "bridge_min_hits")}
    params = {k: getattr(args, k) for k in ("second_stage", "grid_mm", "fd_min", "fd_max", "axis_quantile")}
    every = params | ({} if args.second_stage == "none" else gate)
    path = target(spark, args, "grid", every)
    steps = read_steps(spark, args.input, need=NEEDED["grid"])
    names = steps.schema[CARRIER].metadata.get("subdetector_names")
    steps = cut_lineage(se.ecal_only(steps) if args.n_events is None else se.grid_scan(steps, args.n_events))
    cloud = cut_lineage(gr.grid_cloud(steps, **every))
    printed(rd.compression_report(steps, cloud))
    return stored(cloud, path, {"algorithm": "grid"} | FEATURES["grid"] | every, names)


def run_store(spark: SparkSession, args) -> str:
    if args.buckets < 1:
        raise ValueError("a table has at least one bucket")
    store_by_event(read_steps(spark, args.input), args.output, args.buckets)
    print(f"written {args.output}")
    return args.output


def comparison(spark: SparkSession, before: str, after: str, ecal_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """The steps (of the barrel only, if asked for) of a table and the points of a cloud, numbered within their event by their values."""
    rows, points = read_steps(spark, before), read_steps(spark, after)
    if ecal_only:
        rows, points = se.ecal_only(rows), se.ecal_only(points)
    order = W.partitionBy("event_id").orderBy("x", "y", "z", "energy")
    return rows, points.select("event_id", F.row_number().over(order).cast("long").alias("step_id"), *"xyz", "energy")


def run_validate(spark: SparkSession, args) -> str:
    before, after = comparison(spark, args.before, args.after, args.ecal_only)
    if se.common_events(before, after).isEmpty():
        raise ValueError("the two tables have no event in common")
    direction = tuple(args.direction) if args.direction else None
    rows, kept = va.prepared(before, after, direction, args.qlo, args.qhi, args.anchor, args.n_events)
    tables = {"report": cut_lineage(va.report(rows, kept)), "profiles": va.average_profiles(kept), "edges": va.profile_edges(kept), "histograms": va.histograms(kept), "moments": va.moments(kept), "containment": va.containment(kept)}
    tables["moment_histograms"] = va.moment_histograms(tables["moments"])
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{args.output}/{name}")
    printed(tables["report"])
    return args.output


def run_view(spark: SparkSession, args) -> str:
    before, after = read_steps(spark, args.before), read_steps(spark, args.after)
    common = se.common_events(before, after)
    event = args.event if args.event is not None else common.agg(F.min("event_id")).first()[0]
    if event is None:
        raise ValueError("the two tables have no event in common")
    if common.where(F.col("event_id") == event).isEmpty():
        raise ValueError(f"event {event} is not on both sides")
    side = lambda df, name: df.where(F.col("event_id") == event).select(F.lit(name).alias("side"), "event_id", "subdetector", *"xyz", "energy")
    both = side(before, va.BEFORE).unionByName(side(after, va.AFTER))
    if args.subdetector is not None:
        both = both.where(F.col("subdetector") == args.subdetector)
    number = F.row_number().over(W.partitionBy("event_id").orderBy("side", *"xyz", "energy")).cast("long")  # one event
    points = cut_lineage(both.drop("subdetector").withColumn("step_id", number))
    if points.isEmpty():
        raise ValueError(f"event {event} has no steps of subdetector {args.subdetector}")
    tables = {"points": vw.view_points(points), "config": vw.view_config(points, event, args.subdetector, args.qlo, args.qhi), "colours": vw.color_range(points)}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{args.output}/{name}")
    return args.output


def quantile(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a quantile lies in 0 .. 1")
    return value


def positive(text: str) -> float:
    value = float(text)
    if not value > 0:
        raise argparse.ArgumentTypeError("must be above 0")
    return value


def events(text: str) -> int | None:
    """A number of events, or all."""
    if text == "all":
        return None
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("a number of events is at least 1")
    return value


def factor(text: str) -> float:
    value = float(text)
    if not value >= 0:
        raise argparse.ArgumentTypeError("must not be below 0")
    return value


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="showerloom.tools", description="Shower compression, comparison and picture tables.")
    tools = out.add_subparsers(dest="tool", required=True)

    def tool(name, run, compares=False):
        p = tools.add_parser(name)
        p.set_defaults(run=run)
        for c in ("before", "after") if compares else ("input",):
            p.add_argument(c)
        p.add_argument("--output", required=compares)
        return p

    for name, run in (("dbscan", run_dbscan), ("clue", run_clue), ("grid", run_grid)):
        p = tool(name, run)
        p.add_argument("--n-events", type=events, default=100)
        if name == "dbscan":
            p.add_argument("--eps", type=positive, default=1.5)
            p.add_argument("--min-samples", type=int, default=5)
            p.add_argument("--adaptive", action="store_true")
            p.add_argument("--quantile", type=quantile, default=0.68)
            p.add_argument("--k-core", type=positive, default=1.8)
            p.add_argument("--k-tail", type=positive, default=0.6)
        elif name == "clue":
            for key, default in cl.PARAMS.items():
                p.add_argument("--" + key.replace("_", "-"), type={"min_points": int, "outlier_factor": factor}.get(key, positive), default=default)
            p.add_argument("--exact", action="store_true")
        else:
            p.add_argument("--second-stage", choices=("none", "ccl4", "ccl8"), default=gr.PARAMS["second_stage"])
            for key in ("grid_mm", "fd_min", "fd_max", "bridge_energy_factor", "similarity_ratio"):
                p.add_argument("--" + key.replace("_", "-"), type=positive, default=gr.PARAMS[key])
            p.add_argument("--axis-quantile", type=quantile, default=gr.PARAMS["axis_quantile"])
            p.add_argument("--bridge-min-hits", type=int, default=gr.PARAMS["bridge_min_hits"])
    p = tools.add_parser("store")
    p.set_defaults(run=run_store)
    p.add_argument("input")
    p.add_argument("--output", required=True)
    p.add_argument("--buckets", type=int, default=BUCKETS)
    p = tool("validate", run_validate, True)
    p.add_argument("--n-events", type=int)
    p.add_argument("--direction", type=float, nargs=3)
    p.add_argument("--no-ecal-only", dest="ecal_only", action="store_false")
    p.add_argument("--anchor", choices=("before_min", "none"), default="before_min")
    p.add_argument("--qlo", type=quantile, default=va.Q_LOW)
    p.add_argument("--qhi", type=quantile, default=va.Q_HIGH)
    p = tool("view", run_view, True)
    p.add_argument("--event", type=int)
    p.add_argument("--subdetector", type=int)
    p.add_argument("--qlo", type=quantile, default=0.02)
    p.add_argument("--qhi", type=quantile, default=0.98)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
