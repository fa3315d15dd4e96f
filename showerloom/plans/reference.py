"""One query per operator on the stand-in steps, each with its SQL counterpart.

Floats are rounded in both engines after all thresholds and bins, as sums run in another order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import layer_of, wrapped
from ..functions.stats import circular_mean, covariance, weighted_mean, weighted_quantiles, with_axis
from ..operators import clue as cl
from ..operators import dbscan as db
from ..operators import grid as gr
from ..operators import reduce as rd
from ..operators import select as se
from ..operators import validate as va
from ..operators import view as vw
from ..operators.graph import on_disk, shared_folder
from ..sources.by_event import read_by_event, store_by_event
from ..sources.steps import run_params, steps_view, subdetector_names, write_cloud
from .oracle import _wq, with_ctes

QUERIES: dict = {}
ORACLE: dict = {}
XYZ = ("x", "y", "z")


def query(sql: str | None = None, ctes: bool = True):
    """Registers a function (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = with_ctes(sql) if ctes else sql
        return f

    return add


def near(c, digits: int = 4):
    """Rounding by plain arithmetic, the same in both engines."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def rs(c: str, digits: int = 4) -> str:
    return f"floor(({c}) * CAST({10**digits} AS DOUBLE) + 0.5) / CAST({10**digits} AS DOUBLE)"


def rounded(df: DataFrame, keep: list, cols: list[str], digits: int = 4) -> DataFrame:
    """keep as they are, cols rounded (and without negative zeros)."""
    return df.select(*keep, *(near(F.col(c), digits).alias(c) for c in cols))


def r(*cols: str, digits: int = 4) -> str:
    return ", ".join(f"{rs(c, digits)} AS {c}" for c in cols)


def ecal(spark: SparkSession, d: str) -> DataFrame:
    return se.ecal_only(steps_view(spark, d))


def after(spark: SparkSession, d: str) -> DataFrame:
    """The grid cloud without merging, with a step_id per event."""
    cloud = gr.grid_cloud(steps_view(spark, d).where("subdetector = 0"), "none")
    number = F.row_number().over(W.partitionBy("event_id").orderBy("w_layer", "gi", "gj")).cast("long")
    return on_disk(cloud.select("event_id", number.alias("step_id"), *XYZ, "energy"))


def prepared(spark: SparkSession, d: str):
    return va.prepared(ecal(spark, d), after(spark, d))


def kept(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d)[1]


def cell_rows(spark: SparkSession, d: str) -> DataFrame:
    return gr.celled(ecal(spark, d))


# scans, selection, simple projections

@query(f'SELECT event_id, step_id, {r("x", "y", "z", "energy", digits=6)}, floor(("time") * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS "time", subdetector, cell_id, pdg FROM steps')
def scan_steps(spark, d):
    return rounded(steps_view(spark, d), ["event_id", "step_id", "subdetector", "cell_id", "pdg"], ["x", "y", "z", "energy", "time"], 6)


def stored_cloud(spark: SparkSession, d: str, params: dict) -> DataFrame:
    """A grid cloud and the steps' own subdetectors, written with what they are and read back."""
    path = f"{shared_folder(spark)}/described-{uuid.uuid4().hex}"
    write_cloud(gr.grid_cloud(ecal(spark, d), **params), path, params)
    return spark.read.parquet(path)


@query("SELECT subdetector, CASE subdetector WHEN 0 THEN 'ECAL barrel' WHEN 1 THEN 'ECAL endcap' END AS name, count(*) AS n_rows FROM steps GROUP BY subdetector")
def metadata_scan(spark, d):
    path = f"{shared_folder(spark)}/described-{uuid.uuid4().hex}"
    write_cloud(steps_view(spark, d), path)
    return subdetector_names(spark.read.parquet(path))


@query("""SELECT 'mm, MeV, ns' AS units, '{"grid_mm": 3.0, "second_stage": "none"}' AS cluster_params, count(*) AS n_rows FROM none_cloud""")
def run_parameters(spark, d):
    return run_params(stored_cloud(spark, d, {"second_stage": "none", "grid_mm": 3.0}))


@query("SELECT event_id, step_id, cell_id, layer FROM lay")
def layer_decode(spark, d):
    return steps_view(spark, d).select("event_id", "step_id", "cell_id", layer_of(F.col("cell_id")).alias("layer"))


@query("SELECT event_id, step_id FROM steps WHERE event_id IN (SELECT DISTINCT event_id FROM steps ORDER BY event_id LIMIT 5)")
def first_n_events(spark, d):
    return se.first_n_events(steps_view(spark, d), 5).select("event_id", "step_id")


@query("SELECT event_id, step_id, subdetector FROM ecal")
def ecal_filter(spark, d):
    return ecal(spark, d).select("event_id", "step_id", "subdetector")


@query("SELECT event_id, step_id FROM ecal WHERE event_id IN (SELECT DISTINCT event_id FROM steps ORDER BY event_id LIMIT 7)")
def grid_scan(spark, d):
    return se.grid_scan(steps_view(spark, d), 7).select("event_id", "step_id")


@query("SELECT event_id, step_id, layer FROM feat")
def min_group_filter(spark, d):
    rows = steps_view(spark, d).withColumn("layer", layer_of(F.col("cell_id")))
    return se.min_group(rows, se.LAYER_KEYS, 5).select("event_id", "step_id", "layer")


@query("SELECT event_id, step_id FROM steps WHERE event_id = 1 AND subdetector = 0")
def event_pick(spark, d):
    return se.one_event(steps_view(spark, d), 1, 0).select("event_id", "step_id")


@query(f'SELECT event_id, step_id, {r("fx", "fy", "ft", digits=6)} FROM feat')
def dbscan_features(spark, d):
    return rounded(db.features(steps_view(spark, d)), ["event_id", "step_id"], db.FEATURES, 6)


@query(f'SELECT event_id, step_id, {r("fx", "fy", digits=6)} FROM cfeat')
def clue_features(spark, d):
    return rounded(cl.features(steps_view(spark, d)), ["event_id", "step_id"], ["fx", "fy"], 6)


@query(f'SELECT event_id, {r("x", "y", "z")} FROM (SELECT event_id, {", ".join(f"CASE WHEN sum(energy) > 0 THEN sum(energy * {c}) / sum(energy) ELSE avg({c}) END AS {c}" for c in XYZ)} FROM steps GROUP BY event_id)')
def weighted_centroid(spark, d):
    return rounded(steps_view(spark, d).groupBy("event_id").agg(*(weighted_mean(c, "energy").alias(c) for c in XYZ)), ["event_id"], list(XYZ))


# axis frame and grid

@query("SELECT event_id, step_id FROM hot")
def energy_quantile_mask(spark, d):
    return gr.energetic(ecal(spark, d)).select("event_id", "step_id")


COV = ("sxx", "sxy", "sxz", "syy", "syz", "szz")


@query(f"""SELECT event_id, n, {r(*COV)} FROM (SELECT event_id, n, {", ".join(f"sum(energy * ({a} - c{a}) * ({b} - c{b})) / sum(energy) AS s{a}{b}" for a, b in (c[1:] for c in COV))}
 FROM hot JOIN (SELECT event_id, n, cx, cy, cz FROM frame) USING (event_id) GROUP BY event_id, n)""".replace("SELECT event_id, n, cx, cy, cz FROM frame", "SELECT event_id, n AS n, cx, cy, cz FROM frame"))
def pca_covariance(spark, d):
    return rounded(covariance(gr.energetic(ecal(spark, d)).select("event_id", *XYZ, "energy"), ["event_id"]), ["event_id", "n"], list(COV))


AX = ("ax", "ay", "az")


@query(f"SELECT event_id, {r(*AX, digits=6)} FROM frame")
def pca_axis(spark, d):
    return rounded(gr.frames(ecal(spark, d)), ["event_id"], list(AX), 6)


@query(f"SELECT event_id, {r('cx', 'cy', 'cz')}, {r(*AX, digits=6)} FROM refined")
def refined_axis(spark, d):
    frame = va.refined_axis(ecal(spark, d))
    return frame.select("event_id", *(near(F.col(c), 4).alias(c) for c in ("cx", "cy", "cz")), *(near(F.col(c), 6).alias(c) for c in AX))


@query(f"SELECT event_id, step_id, {r('w', 'u', 'v')} FROM proj")
def axis_projection(spark, d):
    rows = ecal(spark, d)
    return rounded(gr.projected(rows, gr.frames(rows)), ["event_id", "step_id"], ["w", "u", "v"])


@query(f"SELECT event_id, {r('raw_width', 'w_width')} FROM width")
def fd_width(spark, d):
    rows = ecal(spark, d)
    return rounded(gr.layer_widths(gr.projected(rows, gr.frames(rows))), ["event_id"], ["raw_width", "w_width"])


@query("SELECT event_id, step_id, w_layer FROM celled")
def pseudo_layers(spark, d):
    return cell_rows(spark, d).select("event_id", "step_id", "w_layer")


CELL = "event_id, w_layer, i, j"


@query(f"SELECT {CELL}, hits, {r('energy')} FROM cells")
def grid_cells(spark, d):
    return rounded(gr.cells(cell_rows(spark, d)), [*gr.CELL, "hits"], ["energy"])


def _median(stage):
    def run(spark, d):
        return rounded(gr.local_medians(gr.cells(cell_rows(spark, d)), stage), gr.CELL, ["med"])

    run.__name__ = f"cell_local_median_{stage}"
    return query(f"SELECT {CELL}, {r('med')} FROM {stage}_med")(run)


def _edges(stage):
    def run(spark, d):
        return gr.cell_edges(gr.cells(cell_rows(spark, d)), stage)

    run.__name__ = f"grid_edges_{stage}"
    return query(f"SELECT * FROM {stage}_edge")(run)


def _cloud(name, cte, **kw):
    def run(spark, d):
        return rounded(gr.grid_cloud(ecal(spark, d), **kw), ["event_id", "w_layer", "gi", "gj", "n_steps"], [*XYZ, "energy", "time"])

    run.__name__ = name
    return query(f'SELECT event_id, w_layer, gi, gj, n_steps, {r(*XYZ, "energy")}, floor(("time") * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS "time" FROM {cte}')(run)


for _s in ("ccl4", "ccl8"):
    _median(_s)
    _edges(_s)
    _cloud(f"grid_cloud_{_s}", f"{_s}_cloud", second_stage=_s)
_cloud("grid_cloud_none", "none_cloud", second_stage="none")
_cloud("grid_hits_gate", "gate_cloud", second_stage="ccl4", bridge_min_hits=6)


# density clustering

LAYER = "event_id, subdetector, layer"


@query("SELECT event_id, layer, step_id, other AS other_step_id FROM db_pairs")
def eps_neighbors(spark, d):
    return db.neighbour_pairs(db.features(steps_view(spark, d))).select("event_id", "layer", "step_id", "other_step_id")


@query("SELECT event_id, step_id, neighbours, neighbours >= 5 AS is_core FROM db_count")
def dbscan_core_flags(spark, d):
    return db.core_flags(db.neighbour_pairs(db.features(steps_view(spark, d))), se.LAYER_KEYS, 5).select("event_id", "step_id", "neighbours", "is_core")


def _labels(name, cte, f):
    def run(spark, d):
        return f(steps_view(spark, d)).select(*se.LAYER_KEYS, "step_id", "label")

    run.__name__ = name
    return query(f"SELECT {LAYER}, step_id, label FROM {cte}")(run)


def _layer_cloud(name, cte, f, time=True):
    def run(spark, d):
        return rounded(rd.point_cloud(f(steps_view(spark, d)), se.LAYER_KEYS, ["label"], time), [*se.LAYER_KEYS, "label", "n_steps"], [*XYZ, "energy", *["time"] * time])

    run.__name__ = name
    return query(f'SELECT {LAYER}, label, n_steps, {r(*XYZ, "energy")}' + ', floor(("time") * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS "time"' * time + f" FROM {cte}")(run)


for _n, _f, _c in (("dbscan", db.dbscan, "db"), ("dbscan_adaptive", db.dbscan_adaptive, "ad")):
    _labels(f"{_n}_labels", f"{_c}_label", _f)
    _layer_cloud(f"{_n}_cloud", f"{_c}_cloud", _f)


def whole_clue(steps: DataFrame) -> DataFrame:
    """Every step within the search radius is looked at, not only the nearest."""
    return cl.clue(steps, exact=True)


_labels("clue_labels", "cl_label", cl.clue)
_labels("clue_exact", "cx_label", whole_clue)
_layer_cloud("clue_cloud", "cx_cloud", whole_clue, False)


@query(f"SELECT {LAYER}, {r('rq')} FROM rq")
def layer_rq(spark, d):
    return rounded(db.layer_radius(db.features(steps_view(spark, d)))[1], se.LAYER_KEYS, ["rq"])


@query("SELECT event_id, step_id, rho FROM cl_rho")
def clue_rho(spark, d):
    return cl.density(cl.features(steps_view(spark, d)), 15.3).select("event_id", "step_id", "rho")


@query(f"SELECT event_id, step_id, coalesce(nh, -1) AS nh, {r('delta')} FROM cx_peak")
def clue_delta_nh(spark, d):
    return rounded(cl.nearest_higher(cl.features(steps_view(spark, d)), 15.3, exact=True), ["event_id", "step_id", F.coalesce("nh", F.lit(-1)).alias("nh")], ["delta"])


@query("SELECT event_id, step_id, kind FROM cx_kind")
def clue_types(spark, d):
    return cl.classify(cl.nearest_higher(cl.features(steps_view(spark, d)), 15.3, exact=True), 15.3, 5.0).select("event_id", "step_id", "kind")


@query("SELECT event_id, step_id, kind FROM co_kind")
def clue_outlier_types(spark, d):
    return cl.classify(cl.nearest_higher(cl.features(steps_view(spark, d)), 5.0, 2.0, exact=True), 5.0, 3.0, None, 2.0).select("event_id", "step_id", "kind")


# validation

@query("SELECT DISTINCT event_id FROM ecal")
def common_events(spark, d):
    return se.common_events(ecal(spark, d), after(spark, d))


@query(f"SELECT side, event_id, step_id, {r('long', 'r')} FROM cyl")
def cylindrical(spark, d):
    rows = va.both_sides(ecal(spark, d), after(spark, d))
    return rounded(va.cylindrical(rows, va.refined_axis(rows.where("side = 'before'"))), ["side", "event_id", "step_id"], ["long", "r"])


@query("SELECT event_id, floor((cos(centre)) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS c, floor((sin(centre)) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS s FROM phi0")
def circular_mean_phi(spark, d):
    rows = va.both_sides(ecal(spark, d), after(spark, d))
    centre = va.phi_centres(va.cylindrical(rows, va.refined_axis(rows.where("side = 'before'"))))
    return centre.select("event_id", near(F.cos("centre"), 4).alias("c"), near(F.sin("centre"), 4).alias("s"))


@query("SELECT side, event_id, step_id, kept FROM flagged")
def shared_cuts(spark, d):
    return prepared(spark, d)[0].select("side", "event_id", "step_id", "kept")


@query(f"SELECT side, event_id, step_id, {r('long', 'r', 'phi')} FROM kept")
def reanchor(spark, d):
    return rounded(kept(spark, d), ["side", "event_id", "step_id"], ["long", "r", "phi"])


@query(f"SELECT side, event_id, step_id, {r('long', 'r', 'phi')} FROM flagged WHERE kept")
def reanchor_none(spark, d):
    return rounded(va.prepared(ecal(spark, d), after(spark, d), anchor="none")[1], ["side", "event_id", "step_id"], ["long", "r", "phi"])


@query(f"""SELECT event_id, observable, bin, {r('lo', 'hi')} FROM (SELECT event_id, observable, bin, a + (b - a) * bin / n AS lo, a + (b - a) * (bin + 1) / n AS hi FROM (
 SELECT event_id, observable, n, unnest(range(n)) AS bin, CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM (
 SELECT event_id, 'long' AS observable, {va.LONG_BINS} AS n, long_a AS a, long_b AS b FROM lims UNION ALL SELECT event_id, 'r', {va.R_BINS}, r_a, r_b FROM lims
 UNION ALL SELECT event_id, 'log_energy', {va.LOGE_BINS}, CAST(-8 AS DOUBLE), CAST(2 AS DOUBLE) FROM lims)))""")
def profile_edges(spark, d):
    return rounded(va.profile_edges(kept(spark, d)), ["event_id", "observable", "bin"], ["lo", "hi"])


def _profile(name, observable):
    def run(spark, d):
        return rounded(va.histograms(kept(spark, d)).where(F.col("observable") == observable), ["event_id", "side", "bin"], ["value"])

    run.__name__ = name
    return query(f"SELECT event_id, side, bin, {r('value')} FROM hist WHERE observable = '{observable}'")(run)


_profile("long_profile", "long")
_profile("radial_profile", "r")
_profile("loge_profile", "log_energy")


@query(f"SELECT side, observable, bin, {r('value', digits=6)} FROM avgp")
def avg_profiles(spark, d):
    return rounded(va.average_profiles(kept(spark, d)), ["side", "observable", "bin"], ["value"], 6)


@query(f"SELECT event_id, side, {r(*va.MOMENTS)} FROM mom")
def moments(spark, d):
    return rounded(va.moments(kept(spark, d)), ["event_id", "side"], list(va.MOMENTS))


@query(f"SELECT observable, side, bin, {r('density')} FROM momhist")
def moment_hist(spark, d):
    return rounded(va.moment_histograms(va.moments(kept(spark, d))), ["observable", "side", "bin"], ["density"])


Q = ("r50", "r80", "r90", "w10", "w50", "w90")


@query(f"SELECT event_id, side, {r(*Q)} FROM cont")
def containment(spark, d):
    return rounded(va.containment(kept(spark, d)), ["event_id", "side"], list(Q))


@query(f"""SELECT observable, floor((b) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS "before", floor((a) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS "after", floor((a - b) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS delta FROM (
 SELECT observable, median(CASE WHEN side = 'before' THEN v END) AS b, median(CASE WHEN side = 'after' THEN v END) AS a FROM contl GROUP BY observable)""")
def containment_delta(spark, d):
    return rounded(va.containment_delta(va.containment(kept(spark, d))), ["observable"], ["before", "after", "delta"])


@query(f"SELECT event_id, {r('q10', 'q50', 'q90')} FROM (" + _wq("ecal", "event_id", "z", {"q10": 0.1, "q50": 0.5, "q90": 0.9}) + ")")
def weighted_quantile(spark, d):
    return rounded(weighted_quantiles(ecal(spark, d), ["event_id"], "z", "energy", {"q10": 0.1, "q50": 0.5, "q90": 0.9}), ["event_id"], ["q10", "q50", "q90"])


@query(f"SELECT event_id, {r('closure', digits=6)} FROM closure")
def energy_closure(spark, d):
    return rounded(va.energy_closure(va.both_sides(ecal(spark, d), after(spark, d))), ["event_id"], ["closure"], 6)


@query(f"SELECT event_id, {r('closure', digits=6)} FROM closure")
def stored_closure(spark, d):
    """The closure of two tables stored by event."""
    at = f"{shared_folder(spark)}/by_event-{uuid.uuid4().hex}"
    for df, side in ((ecal(spark, d), "before"), (after(spark, d), "after")):
        store_by_event(df, f"{at}/{side}")
    return rounded(va.closure_by_event(read_by_event(spark, f"{at}/before"), read_by_event(spark, f"{at}/after")), ["event_id"], ["closure"], 6)


@query("SELECT event_id, side, floor((CASE WHEN sum(energy) > 0 THEN coalesce(sum(CASE WHEN kept THEN energy END), 0) / sum(energy) END) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS f_keep FROM flagged GROUP BY event_id, side")
def f_keep(spark, d):
    return rounded(va.kept_fraction(prepared(spark, d)[0]), ["event_id", "side"], ["f_keep"], 6)


@query("SELECT count(*) AS n, floor((avg(closure)) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS mean, floor((stddev_samp(closure)) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS rms FROM closure")
def closure_mean_rms(spark, d):
    return rounded(va.mean_rms(va.energy_closure(va.both_sides(ecal(spark, d), after(spark, d))), "closure"), ["n"], ["mean", "rms"], 6)


@query("""SELECT (SELECT count(DISTINCT event_id) FROM ecal) AS n_events, b AS n_before, a AS n_after, floor((CAST(b AS DOUBLE) / a) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS ratio, floor(((1 - CAST(a AS DOUBLE) / b) * 100) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS reduction_pct
 FROM (SELECT (SELECT count(*) FROM ecal) AS b, (SELECT count(*) FROM none_cloud) AS a)""")
def compression_report(spark, d):
    rows = ecal(spark, d)
    return rounded(rd.compression_report(rows, gr.grid_cloud(rows, "none")), ["n_events", "n_before", "n_after"], ["ratio", "reduction_pct"], 6)


@query("SELECT count(*) AS n_steps, count(*) FILTER (label = -1) AS n_noise, floor((count(*) FILTER (label = -1) * CAST(100 AS DOUBLE) / count(*)) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS noise_pct FROM db_label")
def noise_report(spark, d):
    return rounded(rd.noise_report(db.dbscan(steps_view(spark, d))), ["n_steps", "n_noise"], ["noise_pct"], 6)


@query("SELECT event_id, count(DISTINCT (layer, label)) FILTER (label <> -1) AS n_clusters FROM db_label GROUP BY event_id")
def cluster_counts(spark, d):
    return db.dbscan(steps_view(spark, d)).groupBy("event_id").agg(F.countDistinct(F.when(F.col("label") != -1, F.struct("layer", "label"))).alias("n_clusters"))


def _validated(name, prefix, f):
    """The report of a comparison with a cluster cloud of the barrel."""
    def run(spark, d):
        rows = ecal(spark, d)
        cloud = rd.point_cloud(f(rows), se.LAYER_KEYS, ["label"], False)
        cloud = on_disk(cloud.withColumn("step_id", F.row_number().over(W.partitionBy("event_id").orderBy("layer", "label")).cast("long")))
        out = va.report(*va.prepared(rows, cloud))
        return rounded(out, ["quantity", "n"], ["mean", "rms", "before", "after", "delta"])

    run.__name__ = name
    half = lambda c: rs(c, 4)
    stats = lambda q, c, src: f"SELECT '{q}' AS quantity, count({c}) AS n, {half(f'avg({c})')} AS mean, {half(f'stddev_samp({c})')} AS rms, CAST(NULL AS DOUBLE) AS \"before\", CAST(NULL AS DOUBLE) AS \"after\", CAST(NULL AS DOUBLE) AS delta FROM {src}"
    shares = f"(SELECT event_id, side, CASE WHEN sum(energy) > 0 THEN coalesce(sum(CASE WHEN kept THEN energy END), 0) / sum(energy) END AS f FROM {prefix}_flagged GROUP BY ALL)"
    return query(f"""{stats('closure', 'closure', f'{prefix}_closure')} UNION ALL {' UNION ALL '.join(stats(f'f_keep_{s}', 'f', f"(SELECT f FROM {shares} WHERE side = '{s}')") for s in ('before', 'after'))}
 UNION ALL SELECT observable, NULL, NULL, NULL, {half('b')}, {half('a')}, {half('a - b')} FROM (
 SELECT observable, median(CASE WHEN side = 'before' THEN v END) AS b, median(CASE WHEN side = 'after' THEN v END) AS a FROM {prefix}_contl GROUP BY observable)""")(run)


_validated("validate_dbscan", "vd", db.dbscan)
_validated("validate_clue", "vx", whole_clue)


# viewer

def _viewed(spark, d):
    rows = va.both_sides(ecal(spark, d), after(spark, d))
    return rows.join(F.broadcast(rows.agg(F.min("event_id").alias("event_id"))), "event_id")


@query(f"SELECT axis, {r('lo', 'hi', 'dtick', 'tick0')} FROM view")
def view_ranges(spark, d):
    apart = F.when(F.col("side") == "after", 1000000000).otherwise(0)
    return rounded(vw.view_ranges(_viewed(spark, d).withColumn("step_id", F.col("step_id") + apart)), ["axis"], ["lo", "hi", "dtick", "tick0"])


@query(f"SELECT axis, axis || ' [mm]' AS title, {r('lo', 'hi')}, 'linear' AS tickmode, {r('tick0', 'dtick')}, 'Shower 3D \u2014 Event ' || (SELECT min(event_id) FROM viewed) AS figure FROM view")
def view_config(spark, d):
    rows = _viewed(spark, d)
    apart = F.when(F.col("side") == "after", 1000000000).otherwise(0)
    points = rows.withColumn("step_id", F.col("step_id") + apart)
    return rounded(vw.view_config(points, rows.agg(F.min("event_id")).first()[0]), ["axis", "title", "tickmode", "figure"], ["lo", "hi", "tick0", "dtick"])


@query(f"""SELECT v.event_id, v.side, step_id, {r(*XYZ)}, floor((log10(greatest(energy, 1e-9))) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS log_e,
 floor(((2 + 7 * sqrt(least(greatest(energy / CASE WHEN cap > 0 THEN cap ELSE 1 END, 0), 1))) * CASE WHEN v.side = 'after' THEN CAST(12 AS DOUBLE) / 9 ELSE 1 END) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS size
 FROM viewed v JOIN (SELECT side, coalesce(quantile_cont(energy, 0.95) FILTER (energy > 0), 1) AS cap FROM viewed GROUP BY side) c ON v.side = c.side""")
def view_points(spark, d):
    return rounded(vw.view_points(_viewed(spark, d)), ["event_id", "side", "step_id"], [*XYZ, "log_e", "size"])


@query("SELECT floor((min(log10(greatest(energy, 1e-9)))) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS cmin, floor((max(log10(greatest(energy, 1e-9)))) * CAST(10000 AS DOUBLE) + 0.5) / CAST(10000 AS DOUBLE) AS cmax FROM viewed")
def color_range(spark, d):
    return rounded(vw.color_range(_viewed(spark, d)), [], ["cmin", "cmax"])


@query("SELECT event_id, step_id, floor((a - floor(a / (2 * pi())) * (2 * pi()) - pi()) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS angle FROM (SELECT event_id, step_id, x / 3 + pi() AS a FROM ecal)")
def angle_wrap(spark, d):
    return ecal(spark, d).select("event_id", "step_id", near(wrapped(F.col("x") / 3), 6).alias("angle"))


@query("SELECT event_id, floor((cos(m)) * CAST(1000000 AS DOUBLE) + 0.5) / CAST(1000000 AS DOUBLE) AS c FROM (SELECT event_id, CASE WHEN sum(energy) > 0 THEN atan2(sum(energy * sin(x)), sum(energy * cos(x))) ELSE 0 END AS m FROM ecal GROUP BY event_id)")
def circular_mean_angle(spark, d):
    return ecal(spark, d).groupBy("event_id").agg(circular_mean("x", "energy").alias("m")).select("event_id", near(F.cos("m"), 6).alias("c"))


@query(f"SELECT event_id, side, {r('long')} FROM (SELECT s.event_id, side, sum(energy * ((z - cz) * 1)) / sum(energy) AS long FROM sides s JOIN (SELECT event_id, sum(energy * z) / sum(energy) AS cz FROM ecal GROUP BY event_id) c ON s.event_id = c.event_id GROUP BY ALL)")
def fixed_direction(spark, d):
    rows = va.both_sides(ecal(spark, d), after(spark, d))
    out = va.cylindrical(rows, va.fixed_axis(rows.where("side = 'before'"), (0.0, 0.0, 2.0)))
    return rounded(out.groupBy("event_id", "side").agg(weighted_mean("long", "energy").alias("long")), ["event_id", "side"], ["long"])
