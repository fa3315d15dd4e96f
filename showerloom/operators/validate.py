"""Before / after comparison in the shower's cylindrical frame.

All geometry comes from BEFORE: axis, phi centre, cuts, anchor and bin edges; AFTER is projected and
binned with them.  Both sides travel as one table with a `side` column, so every step is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import cross, dot, minus, norm, scaled, settled, wrapped
from ..functions.stats import circular_mean, covariance, histogram_bin, staged, weighted_mean, weighted_quantiles, with_axis, with_basis
from .graph import cut_lineage
from .quantiles import exact_quantiles, numbered, picked, picked_beside
from .select import few_ids, sent_by_event, with_event

BEFORE, AFTER = "before", "after"
LONG_BINS, R_BINS, LOGE_BINS, LOGE_LOW, LOGE_HIGH, MOMENT_BINS = 30, 50, 50, -8.0, 2.0, 40
Q_LOW, Q_HIGH = 0.01, 0.99
COORDS = ("long", "r", "phi")
KEYS = ["event_id", "side"]
MOMENTS = ("m1l", "m2l", "m1r", "m2r")


def both_sides(before: DataFrame, after: DataFrame, n_events: int | None = None) -> DataFrame:
    """(event_id, side, step_id, x, y, z, energy) of events on both sides; after needs step_id as a tie-breaker."""
    cols = ["event_id", "step_id", "x", "y", "z", "energy"]
    ids = cut_lineage(before.select("event_id").distinct().join(after.select("event_id").distinct(), "event_id"))
    if n_events is not None:
        ids = few_ids(ids.orderBy("event_id").limit(n_events), n_events)
    rows = before.select(F.lit(BEFORE).alias("side"), *cols).unionByName(after.select(F.lit(AFTER).alias("side"), *cols))
    return with_event(rows, ids, "left_semi")


def refined_axis(before: DataFrame) -> DataFrame:
    """(event_id, cx, cy, cz, ax, ay, az): fit, trim to [p10, p99] along the axis where at least 10 steps, refit."""
    first = cut_lineage(with_axis(covariance(before, ["event_id"]))).select("event_id", *(f"{p}{k}" for p in "ca" for k in "xyz"), "n")
    rows = with_event(before.select("event_id", "x", "y", "z", "energy"), first)
    along = dot(minus(tuple(F.col(k) for k in "xyz"), tuple(F.col(f"c{k}") for k in "xyz")), tuple(F.col(f"a{k}") for k in "xyz"))
    rows = rows.withColumn("_l", along)
    limits = numbered(rows.select("event_id", "_l"), ["event_id"], ["_l"]).groupBy("event_id").agg(F.array(picked("_l", 0.1), picked("_l", 0.99)).alias("p"))
    kept = with_event(rows, cut_lineage(limits)).where("n >= 10 AND _l >= p[0] AND _l <= p[1]").select("event_id", "x", "y", "z", "energy")
    second = with_axis(covariance(kept, ["event_id"])).where("n >= 2")
    second = second.select("event_id", F.struct(*(f"{p}{k}" for p in "ca" for k in "xyz")).alias("s"))
    return first.join(second, "event_id", "left").select("event_id", *(F.coalesce(f"s.{p}{k}", f"{p}{k}").alias(f"{p}{k}") for p in "ca" for k in "xyz"))


def fixed_axis(before: DataFrame, direction: tuple[float, float, float]) -> DataFrame:
    """The given direction through each event's energy centroid; null where an event has no energy."""
    length = sum(d * d for d in direction) ** 0.5 + 1e-12
    centre = [F.try_divide(F.sum(F.col("energy") * F.col(k)), F.sum("energy")).alias(f"c{k}") for k in "xyz"]
    return before.groupBy("event_id").agg(*centre).select("*", *(F.lit(d / length).alias(f"a{k}") for k, d in zip("xyz", direction, strict=True)))


def with_directions(frame: DataFrame) -> DataFrame:
    """frame with what ``about`` needs: two directions across the axis and the one from which phi counts."""
    axis = tuple(F.col(f"a{k}") for k in "xyz")
    ref = minus((F.lit(1.0), F.lit(0.0), F.lit(0.0)), scaled(axis, axis[0]))
    frame = staged(with_basis(frame), {f"_f{k}": c for k, c in zip("xyz", ref, strict=True)})
    size = norm(tuple(F.col(f"_f{k}") for k in "xyz"))
    unit = F.when(size > 1e-9, size).otherwise(1.0)
    return staged(frame, {f"f{k}": F.col(f"_f{k}") / unit for k in "xyz"}).drop("_fx", "_fy", "_fz")


def about(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep with long, r, phi of rows that stand beside their event's frame, settled: cuts and bins are held against values of the rows themselves."""
    vec = lambda p: tuple(F.col(f"{p}{k}") for k in "xyz")
    axis = vec("a")
    rel = minus(tuple(F.col(k) for k in "xyz"), vec("c"))
    out = staged(rows, {"long": dot(rel, axis), "_u": dot(rel, vec("b1")), "_v": dot(rel, vec("b2"))})
    across = tuple(F.col("_u") * F.col(f"b1{k}") + F.col("_v") * F.col(f"b2{k}") for k in "xyz")
    out = staged(out, {f"_t{k}": c for k, c in zip("xyz", across, strict=True)})
    phi = F.atan2(dot(cross(vec("f"), vec("_t")), axis), dot(vec("_t"), vec("f")))
    r = F.sqrt(F.col("_u") * F.col("_u") + F.col("_v") * F.col("_v"))
    out = staged(out, {"_l": settled(F.col("long")), "_r": settled(r), "_phi": settled(phi)})
    return out.select(*keep, F.col("_l").alias("long"), F.col("_r").alias("r"), F.col("_phi").alias("phi"))


def cylindrical(rows: DataFrame, frame: DataFrame) -> DataFrame:
    """rows with long, r, phi about each event's axis."""
    return about(with_event(rows, cut_lineage(with_directions(frame))), rows.columns)


def phi_centres(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("side") == BEFORE).groupBy("event_id").agg(circular_mean("phi", "energy").alias("centre"))


def recentred(phi: str = "phi", centre: str = "centre") -> Column:
    """phi about BEFORE's circular mean."""
    return settled(wrapped(F.col(phi) - F.col(centre)))


def inside() -> Column:
    """Within BEFORE's cuts in all coordinates."""
    kept = F.lit(True)
    for c in COORDS:
        kept = kept & (F.col(c) >= F.col(f"{c}_lo")) & (F.col(c) <= F.col(f"{c}_hi"))
    return kept


def cuts(placed: DataFrame, low: float = Q_LOW, high: float = Q_HIGH) -> DataFrame:
    """(event_id, centre, long_lo .. phi_hi, start, steps) of BEFORE's rows about their axis: phi's circular mean, the quantiles of the coordinates, the smallest kept long and the number of rows.

    Rows are sent by event once; windows do the rest where they lie.
    """
    event = W.partitionBy("event_id")
    own = sent_by_event(placed.select("event_id", *COORDS, "energy"), placed.count())
    e, phi = F.col("energy"), F.col("phi")
    own = own.withColumns({"_e": F.sum(e).over(event), "_s": F.sum(e * F.sin(phi)).over(event), "_c": F.sum(e * F.cos(phi)).over(event)})
    own = own.withColumn("centre", F.when(F.col("_e") > 0, F.atan2("_s", "_c")).otherwise(0.0)).withColumn("phi", recentred()).drop("_e", "_s", "_c")
    bounds = {f"{c}_{n}": (c, q) for c in COORDS for n, q in (("lo", low), ("hi", high))}
    own = picked_beside(numbered(own, ["event_id"], list(COORDS)), ["event_id"], bounds).withColumns({b: settled(F.col(b)) for b in bounds})
    return own.groupBy("event_id").agg(*(F.first(c).alias(c) for c in ("centre", *bounds)), F.min(F.when(inside(), F.col("long"))).alias("start"), F.count("*").alias("steps"))


def geometry(before: DataFrame, direction: tuple[float, float, float] | None = None, low: float = Q_LOW, high: float = Q_HIGH) -> DataFrame:
    """One row for each event of BEFORE with all that a comparison takes from it, written once: frame, phi centre, cuts and start."""
    frame = cut_lineage(with_directions(refined_axis(before) if direction is None else fixed_axis(before, direction)))
    own = cuts(about(with_event(before.select("event_id", *"xyz", "energy"), frame), ["event_id", "energy"]), low, high)
    return cut_lineage(with_event(own, frame))


def prepared(before: DataFrame, after: DataFrame, direction: tuple[float, float, float] | None = None, low: float = Q_LOW, high: float = Q_HIGH, anchor: str = "before_min", n_events: int | None = None, told: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(all rows with kept, kept rows with long from BEFORE's smallest).

    Only what is known per event is written; a figure's plan takes the columns that it needs from the two
    tables.  told: BEFORE's ``geometry``, where several comparisons share it.
    """
    if not 0 <= low < high <= 1:
        raise ValueError("quantiles must satisfy 0 <= low < high <= 1")
    rows = both_sides(before, after, n_events)
    names = rows.columns
    told = geometry(rows.where(F.col("side") == BEFORE), direction, low, high) if told is None else told
    rows = beside(rows, told)
    from_start = from_smallest() if anchor == "before_min" else F.col("long")
    return rows.select(*names, *COORDS, "kept"), rows.where("kept").withColumn("long", from_start).select(*names, *COORDS)


def beside(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows with all that is told of their event, their coordinates about its axis and kept."""
    event = [c for c in told.columns if c != "event_id"]
    return staged(about(with_event(rows, told), [*rows.columns, *event]).withColumn("phi", recentred()), {"kept": inside()})


def from_smallest() -> Column:
    """long from BEFORE's smallest kept one."""
    return F.col("long") - F.coalesce("start", F.lit(0.0))


def placed(rows: DataFrame, told: DataFrame) -> DataFrame:
    """rows of one side with long (from BEFORE's smallest), r, phi and kept."""
    return beside(rows, told).withColumn("long", from_smallest()).select(*rows.columns, *COORDS, "kept")


def energy_closure(rows: DataFrame) -> DataFrame:
    """(event_id, closure): AFTER's energy over BEFORE's, without cuts; events without energy are left out."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("energy")))
    return rows.groupBy("event_id").agg(side(BEFORE).alias("b"), side(AFTER).alias("a")).where("b > 0").select("event_id", F.try_divide("a", "b").alias("closure"))


def closure_by_event(before: DataFrame, after: DataFrame) -> DataFrame:
    """``energy_closure`` of two tables summed apart: without an exchange where both are stored by event in equally many buckets."""
    total = lambda df, name: df.groupBy("event_id").agg(F.sum("energy").alias(name))
    both = total(before, "b").join(total(after, "a"), "event_id")
    return both.where("b > 0").select("event_id", F.try_divide("a", "b").alias("closure"))


def kept_fraction(rows: DataFrame) -> DataFrame:
    """(event_id, side, f_keep) from rows with kept; null without energy."""
    inside = F.coalesce(F.sum(F.when(F.col("kept"), F.col("energy"))), F.lit(0.0))
    return rows.groupBy(*KEYS).agg(F.when(F.sum("energy") > 0, F.try_divide(inside, F.sum("energy"))).alias("f_keep"))


def edges(kept: DataFrame) -> DataFrame:
    """(event_id, long_a, long_b, r_a, r_b): bin limits from BEFORE; [0, 1] without rows."""
    one = lambda f, c: f(F.when(F.col("side") == BEFORE, F.col(c)))
    return kept.groupBy("event_id").agg(*(F.coalesce(one(f, c), F.lit(d)).alias(f"{c}_{n}") for c in ("long", "r") for n, f, d in (("a", F.min, 0.0), ("b", F.max, 1.0))))


def limits(low, high) -> tuple:
    """Bin limits as ``histogram_bin`` takes them: equal ones are widened by one half."""
    return F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)


def profile_edges(kept: DataFrame) -> DataFrame:
    """(event_id, observable, bin, lo, hi): the limits of every bin of ``histograms``."""
    def all_bins(name, low, high, n):
        lo, hi = limits(low, high)
        at = lambda k: lo + (hi - lo) * k / n
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.lit(name).alias("observable"), k.cast("long").alias("bin"), at(k).alias("lo"), at(k + 1).alias("hi")))

    every = (("long", F.col("long_a"), F.col("long_b"), LONG_BINS), ("r", F.col("r_a"), F.col("r_b"), R_BINS), ("log_energy", F.lit(LOGE_LOW), F.lit(LOGE_HIGH), LOGE_BINS))
    return edges(kept).select("event_id", F.explode(F.concat(*(all_bins(*x) for x in every))).alias("e")).select("event_id", "e.*")


def histograms(kept: DataFrame) -> DataFrame:
    """(event_id, side, observable, bin, value): occupied bins of long, r (energy) and log_energy (counts)."""
    rows = with_event(kept, cut_lineage(edges(kept)))
    at = [
        F.struct(F.lit("long").alias("observable"), histogram_bin(F.col("long"), F.col("long_a"), F.col("long_b"), LONG_BINS).alias("bin"), F.col("energy").alias("w")),
        F.struct(F.lit("r").alias("observable"), histogram_bin(F.col("r"), F.col("r_a"), F.col("r_b"), R_BINS).alias("bin"), F.col("energy").alias("w")),
        F.struct(F.lit("log_energy").alias("observable"), histogram_bin(F.log10(F.col("energy") + 1e-12), F.lit(LOGE_LOW), F.lit(LOGE_HIGH), LOGE_BINS).alias("bin"), F.lit(1.0).alias("w")),
    ]
    long_rows = rows.select(*KEYS, F.explode(F.array(*at)).alias("h")).where("h.bin IS NOT NULL")
    return long_rows.groupBy(*KEYS, "h.observable", "h.bin").agg(F.sum("h.w").alias("value"))


def average_profiles(kept: DataFrame, n_events: DataFrame | None = None) -> DataFrame:
    """(side, observable, bin, value): mean over events, zero bins included.

    long and r are divided by the event's in-range longitudinal energy (else by their own sum, else
    1), log_energy by the number of kept objects.  Events are those with kept rows on any side.
    """
    h = cut_lineage(histograms(kept))
    own = h.groupBy(*KEYS, "observable").agg(F.sum("value").alias("own"))
    in_range = own.where("observable = 'long'").select(*KEYS, F.col("own").alias("in_range"))
    objects = cut_lineage(kept.groupBy(*KEYS).agg(F.count("*").alias("objects")))
    scale = F.when(F.col("observable") == "log_energy", F.col("objects").cast("double")).when(F.col("in_range") > 0, F.col("in_range")).when(F.col("own") > 0, F.col("own")).otherwise(1.0)
    shares = h.join(own, [*KEYS, "observable"]).join(objects, KEYS).join(in_range, KEYS, "left").select("side", "observable", "bin", (F.col("value") / scale).alias("share"))
    events = n_events if n_events is not None else objects.agg(F.countDistinct("event_id").alias("events"))
    spark = kept.sparkSession
    bins = [(s, o, b) for s in (BEFORE, AFTER) for o, n in (("long", LONG_BINS), ("r", R_BINS), ("log_energy", LOGE_BINS)) for b in range(n)]
    dense = F.broadcast(spark.createDataFrame(bins, "side string, observable string, bin long"))  # 260 rows
    total = dense.join(shares.groupBy("side", "observable", "bin").agg(F.sum("share").alias("s")), ["side", "observable", "bin"], "left")
    return total.join(F.broadcast(events)).select("side", "observable", "bin", F.coalesce(F.try_divide("s", "events"), F.lit(0.0)).alias("value"))  # events: one row


def moments(kept: DataFrame) -> DataFrame:
    """(event_id, side, m1l, m2l, m1r, m2r): energy-weighted raw moments; 0 without energy."""
    e = F.col("energy")
    mean = lambda v: F.when(F.sum(e) > 0, F.try_divide(F.sum(e * v), F.sum(e))).otherwise(0.0)
    long, r = F.col("long"), F.col("r")
    return kept.groupBy(*KEYS).agg(*(mean(v).alias(n) for n, v in zip(MOMENTS, (long, long * long, r, r * r), strict=True)))


def moment_histograms(moment_rows: DataFrame) -> DataFrame:
    """(observable, side, bin, density) over 40 bins common to both sides, padded by 5 %; occupied bins."""
    rows = moment_rows.select("side", F.explode(F.array(*(F.struct(F.lit(m).alias("observable"), F.col(m).alias("v")) for m in MOMENTS))).alias("m")).select("side", "m.*")
    lim = rows.groupBy("observable").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    flat = F.when(F.col("a") == F.col("b"), 1e-6).otherwise(0.0)
    lim = lim.select("observable", (F.col("a") - flat).alias("a"), (F.col("b") + flat).alias("b"))
    pad = (F.col("b") - F.col("a")) * 0.05
    lim = F.broadcast(lim.select("observable", (F.col("a") - pad).alias("a"), (F.col("b") + pad).alias("b")))  # four rows
    binned = rows.join(lim, "observable").withColumn("bin", histogram_bin(F.col("v"), F.col("a"), F.col("b"), MOMENT_BINS))
    n = F.sum("k").over(W.partitionBy("observable", "side"))
    counts = binned.groupBy("observable", "side", "bin", "a", "b").agg(F.count("*").alias("k"))
    return counts.select("observable", "side", "bin", F.try_divide(F.col("k") * MOMENT_BINS, n * (F.col("b") - F.col("a"))).alias("density"))


def containment(kept: DataFrame) -> DataFrame:
    """(event_id, side, r50, r80, r90, w10, w50, w90): energy quantiles of r and long."""
    both = F.explode(F.array(*(F.struct(F.lit(c).alias("observable"), F.col(c).alias("v")) for c in ("r", "long")))).alias("o")

    n = kept.count()

    def quantiles(side):  # each side by itself: rows that lie by event already stay where they are
        rows = sent_by_event(kept.where(F.col("side") == side).select(*KEYS, "step_id", "energy", "r", "long"), 2 * n)
        rows = rows.select(*KEYS, "step_id", "energy", both).select(*KEYS, "step_id", "energy", "o.*")
        return weighted_quantiles(rows, [*KEYS, "observable"], "v", "energy", {f"q{k}": k / 100 for k in (10, 50, 80, 90)})

    q = quantiles(BEFORE).unionByName(quantiles(AFTER))
    of = lambda name, c: F.max(F.when(F.col("observable") == name, F.col(c)))
    return q.groupBy(*KEYS).agg(*(of("r", f"q{k}").alias(f"r{k}") for k in (50, 80, 90)), *(of("long", f"q{k}").alias(f"w{k}") for k in (10, 50, 90)))


def containment_delta(quantiles: DataFrame) -> DataFrame:
    """(observable, before, after, delta): medians over events."""
    names = ("r50", "r80", "r90", "w10", "w50", "w90")
    rows = quantiles.select("side", F.explode(F.array(*(F.struct(F.lit(n).alias("observable"), F.col(n).alias("v")) for n in names))).alias("q")).select("side", "q.*")
    middle = exact_quantiles(rows, ["observable", "side"], "v", {"m": 0.5})
    med = middle.groupBy("observable").agg(*(F.max(F.when(F.col("side") == s, F.col("m"))).alias(s) for s in (BEFORE, AFTER)))
    return med.withColumn("delta", F.col(AFTER) - F.col(BEFORE))


def mean_rms(values: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, mean, rms): mean and sample deviation of finite values."""
    v = F.when(~F.isnan(col) & (F.abs(F.col(col)) < float("inf")), F.col(col))
    return values.groupBy(*(keys or [])).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("rms"))


def report(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(quantity, n, mean, rms) of closure and f_keep over events, and medians over events of containment and their shift.

    rows, kept: what ``prepared`` gives.  quantity: closure, f_keep_before, f_keep_after, then r50 .. w90
    with before, after and delta (null for the others).
    """
    part = lambda df, c: mean_rms(df, c).select("n", "mean", "rms")
    none = [F.lit(None).cast("double").alias(c) for c in (BEFORE, AFTER, "delta")]
    shares = cut_lineage(kept_fraction(rows))
    out = part(energy_closure(rows), "closure").select(F.lit("closure").alias("quantity"), "*", *none)
    for side in (BEFORE, AFTER):
        out = out.unionByName(part(shares.where(F.col("side") == side), "f_keep").select(F.lit(f"f_keep_{side}").alias("quantity"), "*", *none))
    shift = containment_delta(containment(kept))
    return out.unionByName(shift.select(F.col("observable").alias("quantity"), F.lit(None).cast("long").alias("n"), *(F.lit(None).cast("double").alias(c) for c in ("mean", "rms")), BEFORE, AFTER, "delta"))
