"""Territories: unit roll-ups, adjacency, alignments, contiguity and balance. Every round of a repair is a set of joins over units."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import miles
from ..functions.session import written as materialise
from . import ranks

#: Capacity of a territory as a multiple of the mean load.
SLACK = 1.08


def units(plan: DataFrame) -> DataFrame:
    """Workload, value, mean centroid and modal state by unit."""
    return plan.where("lat is not null and lon is not null").groupBy("zip3").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.mode("state", True).alias("state"), F.sum("desired_calls").alias("workload"), F.count("*").alias("accounts"), F.count_if("is_target").alias("targets"), F.sum("opportunity").alias("opportunity"), F.sum("class_fills").alias("class_fills"), F.count_if(F.col("opportunity_decile") >= 8).alias("high_decile_accounts")
    )


def adjacency(u: DataFrame, k: int = 6, cell: float = 12.0) -> DataFrame:
    """Symmetric k-nearest-neighbour edges (a < b).

    Units meet those of their own and the eight neighbouring grid cells. Those with fewer than k neighbours there, or
    with the k-th farther than the cells surely cover, are joined once more with cells three times as wide, and so on
    until none is left, so no neighbour is missed.
    """
    found, left, size = None, u.select("zip3", "lat", "lon"), cell
    total = u.count()
    while True:
        near = u.select(F.col("zip3").alias("dst"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.floor(F.col("lat") / size).alias("gy"), F.floor(F.col("lon") / size).alias("gx"))
        shift = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)]))
        src = left.select("zip3", "lat", "lon", shift.alias("d")).select("zip3", "lat", "lon", (F.floor(F.col("lat") / size) + F.col("d.y")).alias("gy"), (F.floor(F.col("lon") / size) + F.col("d.x")).alias("gx"))
        w = Window.partitionBy("zip3").orderBy("dist", "dst")
        pairs = src.join(near, ["gy", "gx"]).where("zip3 <> dst").withColumn("dist", F.round(miles(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6))
        best = materialise(pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("zip3", "dst", "dist", "lat"))
        # A whole cell lies around each unit: what is nearer than a cell's width was met (longitude shrinks with latitude).
        sure = F.least(F.lit(69.0 * size), 69.0 * size * F.cos(F.radians(F.least(F.abs("lat") + size, F.lit(85.0)))))
        done = best.groupBy("zip3").agg(F.count("*").alias("n"), F.max("dist").alias("far"), F.first("lat").alias("lat")).where(((F.col("n") >= k) & (F.col("far") <= sure)) | F.lit(size > 360)).select("zip3")
        part = best.join(done, "zip3", "left_semi").select("zip3", "dst")
        found = part if found is None else found.unionByName(part)
        left = materialise(left.join(done, "zip3", "left_anti"))
        if size > 360 or total <= 1 or left.isEmpty():
            break
        size *= 3
    return found.select(F.least("zip3", "dst").alias("a"), F.greatest("zip3", "dst").alias("b")).distinct()


def baseline(u: DataFrame, territories: int) -> DataFrame:
    """Blocks of equal length in the order of state and unit."""
    scan = ranks.global_scan(u, [F.col("state"), F.col("zip3")], total="n")
    return scan.withColumn("territory", F.floor((F.col("rn") - 1) / F.ceil(F.col("n") / territories)).cast("int")).drop("rn", "n")


def kmeans(u: DataFrame, territories: int, seed: int = 42) -> DataFrame:
    """Centroid clusters weighted by workload."""
    v = VectorAssembler(inputCols=["lat", "lon"], outputCol="__v").transform(u.withColumn("__w", F.greatest("workload", F.lit(1e-6))))
    model = KMeans(k=territories, seed=seed, featuresCol="__v", predictionCol="territory", weightCol="__w").fit(v)
    return model.transform(v).drop("__v", "__w")


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(assigned: DataFrame, edges: DataFrame, by: Sequence[str] = (), hops: int = 3) -> DataFrame:
    """Component of each unit inside its territory: the smallest unit reachable over edges of the same territory.

    ``by``: columns that name separate alignments in one frame. Labels spread by ``hops`` steps and jumps a job, until a
    job changes nothing.
    """
    by, own = list(by), assigned.select(*by, "zip3", "territory")
    side = lambda end: own.select(*by, F.col("zip3").alias(end), F.col("territory").alias(f"t{end}"))
    both = materialise(_symmetric(edges).join(side("a"), "a").join(side("b"), [*by, "b"]).where("ta = tb").select(*by, "a", "b"))
    labels = materialise(own.withColumn("component", F.col("zip3")))
    while True:
        after = labels.withColumn("old", F.col("component"))
        for _ in range(hops):
            low = both.join(after.select(*by, F.col("zip3").alias("b"), "component"), [*by, "b"]).groupBy(*by, F.col("a").alias("zip3")).agg(F.min("component").alias("m"))
            after = after.join(low, [*by, "zip3"], "left").withColumn("component", F.least("component", "m")).drop("m")
            # Pointer jump: take the label of the label.
            jump = after.select(*by, F.col("zip3").alias("component"), F.col("component").alias("j"))
            after = after.join(jump, [*by, "component"], "left").withColumn("component", F.least("component", "j")).drop("j")
        after = materialise(after)
        labels = after.select(*by, "zip3", "territory", "component")
        if after.where("component <> old").isEmpty():
            return labels


def metrics(assigned: DataFrame, comps: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Balance, travel to workload-weighted centroids, and the share of territories in one piece; a row per alignment."""
    by = list(by)
    at = lambda c: F.try_divide(F.sum(F.col(c) * F.col("workload")), F.nullif(F.sum("workload"), F.lit(0.0))).alias(f"c{c}")
    t = assigned.groupBy(*by, "territory").agg(F.sum("workload").alias("w"), at("lat"), at("lon"))
    way = miles(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) * F.col("workload")
    travel = assigned.join(t.drop("w"), [*by, "territory"]).groupBy(*by).agg(F.try_divide(F.sum(way), F.nullif(F.sum("workload"), F.lit(0.0))).alias("travel_miles"))
    parts = [t.groupBy(*by).agg(F.count("*").alias("territories"), F.try_divide(F.max("w"), F.nullif(F.min("w"), F.lit(0.0))).alias("imbalance"), F.try_divide(F.stddev_pop("w"), F.nullif(F.avg("w"), F.lit(0.0))).alias("workload_cv")), travel]
    if comps is not None:
        parts.append(comps.groupBy(*by, "territory").agg(F.count_distinct("component").alias("c")).groupBy(*by).agg(F.avg((F.col("c") == 1).cast("double")).alias("contiguity_rate")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, by) if by else out.join(F.broadcast(part))  # one row
    return out


def territory_rollup(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("territory").agg(F.count("*").alias("units"), F.sum("workload").alias("workload"), F.sum("opportunity").alias("opportunity"), F.sum("targets").alias("targets"))


# A solve holds all sizes in one frame, a row per size and unit: ``n_reps, zip3, lat, lon, workload, near, links, territory, component``.
# ``near`` (adjacent units) and ``links`` (pairs of them that are adjacent) are joined once. In a round every row sees a
# book of its size. Components are searched once for an alignment; after that a move carries its unit's label along.

SIZE = "n_reps"
#: Rounds without a better variation of loads after which balancing ends.
STALL = 3


def _nearest(by: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def neighbourhoods(u: DataFrame, edges: DataFrame) -> DataFrame:
    """Units with the arrays of their neighbours and of the edges among these."""
    both = materialise(_symmetric(edges))
    near = both.groupBy(F.col("a").alias("zip3")).agg(F.array_sort(F.collect_set("b")).alias("near"))
    triangles = both.join(both.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").join(both.select("a", F.col("b").alias("c")), ["a", "c"])
    links = triangles.groupBy(F.col("a").alias("zip3")).agg(F.array_sort(F.collect_set(F.struct("b", "c"))).alias("links"))
    out = u.select("zip3", "lat", "lon", "workload").join(near, "zip3", "left").join(links, "zip3", "left")
    return materialise(out.withColumn("near", F.coalesce("near", F.array().cast("array<string>"))).withColumn("links", F.coalesce("links", F.array().cast("array<struct<b:string,c:string>>"))))


def centroids(assigned: DataFrame) -> DataFrame:
    """Load, number of units and workload-weighted centre of each territory; units without work count a little."""
    w = F.greatest("workload", F.lit(1e-6))
    return assigned.groupBy(SIZE, "territory").agg(F.sum("workload").alias("load"), F.count("*").alias("members"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("clat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("clon"))


def capacity_assignment(u: DataFrame, seeds: DataFrame, slack: float = SLACK) -> DataFrame:
    """Nearest territory with room, in rounds: every open unit proposes, a territory accepts its nearest within capacity.

    ``seeds``: n_reps, territory, clat, clon. A size's centres are one array, as long as its force; a unit ranks them by
    distance once and then asks its first one with room. Each round places a unit at least, so there are at most as many rounds as units;
    when no open unit has a territory with room, those left go to their nearest.
    """
    centre = F.struct("territory", "clat", "clon")
    sizes = seeds.groupBy(SIZE).agg(F.sort_array(F.collect_list(centre)).alias("centres"), F.count("*").alias("n"))  # a row per size
    total = u.agg(F.sum("workload").alias("total"))
    sizes = materialise(sizes.join(F.broadcast(total)).withColumn("cap", F.coalesce("total", F.lit(0.0)) * slack / F.col("n")))  # one row
    units_of = u.withColumn(SIZE, F.explode(F.array(*[F.lit(r[SIZE]) for r in sizes.select(SIZE).collect()])))
    way = F.transform("centres", lambda c: F.struct(F.round(miles(F.col("lat"), F.col("lon"), c["clat"], c["clon"]), 6).alias("d"), c["territory"].alias("territory")))
    left = materialise(units_of.join(F.broadcast(sizes), SIZE).withColumn("wish", F.array_sort(way)).drop("centres", "n", "total"))
    keep, done = [c for c in left.columns if c not in ("wish", "cap")], None
    while True:
        if done is None:
            asks = left.withColumn("used", F.create_map().cast("map<int,double>"))
        else:
            used = done.groupBy(SIZE, "territory").agg(F.sum("workload").alias("w")).groupBy(SIZE).agg(F.map_from_entries(F.collect_list(F.struct("territory", "w"))).alias("used"))  # a row per size
            asks = left.join(F.broadcast(used), SIZE, "left")
        load = lambda t: F.coalesce(F.try_element_at("used", t.cast("int")), F.lit(0.0))
        room = F.filter("wish", lambda w: load(w["territory"]) + F.col("workload") <= F.col("cap"))
        asks = asks.withColumn("ask", F.try_element_at(room, F.lit(1)))
        running = F.sum("workload").over(Window.partitionBy(SIZE, "ask.territory").orderBy("ask.d", "zip3").rowsBetween(Window.unboundedPreceding, 0))
        tried = materialise(asks.withColumn("ok", F.col("ask").isNotNull() & (load(F.col("ask.territory")) + running <= F.col("cap"))).drop("used"))
        got = tried.where("ok").select(*keep, F.col("ask.territory").alias("territory"))
        if got.isEmpty():
            rest = tried.select(*keep, F.col("wish")[0]["territory"].alias("territory"))
            return materialise(rest if done is None else done.unionByName(rest))
        done = got if done is None else done.unionByName(got)
        left = tried.where(~F.col("ok")).drop("ok", "ask")


def labelled(assigned: DataFrame) -> DataFrame:
    """With ``component``, the smallest unit of each unit's piece.

    The edges inside a territory are one array, and each of them merges two labels: a pass instead of rounds to a fixpoint. A territory's
    units are bounded by its geography.
    """
    whole = assigned.groupBy(SIZE, "territory").agg(F.sort_array(F.collect_list(F.struct("zip3", "near"))).alias("us")).withColumn("names", F.transform("us", lambda u: u["zip3"]))
    inside = F.flatten(F.transform("us", lambda u: F.transform(F.filter(u["near"], lambda n: (n > u["zip3"]) & F.array_contains("names", n)), lambda n: F.struct(u["zip3"].alias("a"), n.alias("b")))))
    # Labels stand at the places of their units.
    label = lambda acc, name: F.element_at(acc, F.array_position("names", name).cast("int"))
    joined = lambda acc, e: F.transform(acc, lambda x: F.when(x == F.greatest(label(acc, e["a"]), label(acc, e["b"])), F.least(label(acc, e["a"]), label(acc, e["b"]))).otherwise(x))
    labels = F.aggregate(inside, F.col("names"), joined)
    out = whole.select(SIZE, F.explode(F.arrays_zip(F.col("names").alias("zip3"), labels.alias("component"))).alias("x")).select(SIZE, "x.zip3", "x.component")
    return materialise(assigned.drop("component").join(out, [SIZE, "zip3"]))


def _with_book(state: DataFrame) -> DataFrame:
    """With what all units of a size see: who owns each unit (``owner``), what territories hold (``sums``) and the mean load; and the neighbours' owners (``around``).

    There is one such row for a size, as long as its units and territories; the join broadcasts it below the session's threshold only.
    """
    w = F.greatest("workload", F.lit(1e-6))
    t = state.groupBy(SIZE, "territory").agg(F.struct(F.sum("workload").alias("load"), F.count("*").alias("members"), (F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon")).alias("s"), F.collect_list(F.struct("zip3", "component")).alias("us"))
    owners = F.transform("us", lambda u: F.struct(u["zip3"].alias("b"), F.struct(F.col("territory").alias("t"), u["component"].alias("c"))))
    book = t.groupBy(SIZE).agg(F.map_from_entries(F.flatten(F.collect_list(owners))).alias("owner"), F.map_from_entries(F.collect_list(F.struct("territory", "s"))).alias("sums"), F.avg("s.load").alias("mean"))
    seen = F.transform("near", lambda b: F.struct(b.alias("b"), F.try_element_at("owner", b)["t"].alias("t"), F.try_element_at("owner", b)["c"].alias("c")))
    return state.join(book, SIZE).withColumn("around", seen)


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    """The alignment after the moves (n_reps, zip3, to, piece), with a flag ``moved``."""
    out = state.drop("moved").join(moves.select(SIZE, "zip3", "to", "piece"), [SIZE, "zip3"], "left").withColumn("moved", F.col("to").isNotNull())
    return materialise(out.withColumn("territory", F.coalesce("to", "territory")).withColumn("component", F.coalesce("piece", "component")).drop("to", "piece"))


def repair_contiguity(state: DataFrame) -> DataFrame:
    """Keep each territory's largest piece by workload; other units go to an adjacent territory's piece, the nearest centre first.

    Every round joins units to largest pieces and gives them those labels, so there are at most as many rounds as units outside; it ends
    when no such unit is adjacent to one.
    """
    while True:
        size = state.groupBy(SIZE, "territory", "component").agg(F.sum("workload").alias("w"), F.count("*").alias("n"))
        main = materialise(size.withColumn("r", _nearest([SIZE, "territory"], F.desc("w"), F.desc("n"), F.col("component"))).where("r = 1").select(SIZE, "territory", F.col("component").alias("main")))
        if main.join(size, [SIZE, "territory"]).where("component <> main").isEmpty():
            return state
        orphans = _with_book(state).join(main, [SIZE, "territory"]).where("component <> main").select(SIZE, "zip3", "lat", "lon", F.explode("around").alias("x"))
        body = main.select(SIZE, F.col("territory").alias("to"), F.col("main").alias("piece"))
        offers = orphans.select(SIZE, "zip3", "lat", "lon", F.col("x.t").alias("to"), F.col("x.c").alias("piece")).join(body, [SIZE, "to", "piece"], "left_semi")
        centre = centroids(state).select(SIZE, F.col("territory").alias("to"), "clat", "clon")
        way = F.round(miles(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")), 6)
        state = _moved(state, offers.join(centre, [SIZE, "to"]).withColumn("r", _nearest([SIZE, "zip3"], way, F.col("to"))).where("r = 1"))
        if state.where("moved").isEmpty():
            return state


def _safe_offers(state: DataFrame) -> DataFrame:
    """Moves of a unit to an adjacent territory that leave its own piece whole, with what both hold (``here``, ``there``).

    A unit may leave if its neighbours in the territory hang together without it: what is reached from one of them
    over edges among them is all of them. The neighbours of a unit are a handful.
    """
    x = _with_book(state).withColumn("mates", F.transform(F.filter("around", lambda n: n["t"] == F.col("territory")), lambda n: n["b"])).withColumn("here", F.try_element_at("sums", "territory")).where("here.members > 1")
    reached = "aggregate(mates, slice(mates, 1, 1), (acc, m) -> array_distinct(concat(acc, transform(filter(links, l -> array_contains(acc, l.b) and array_contains(mates, l.c)), l -> l.c))))"
    x = x.where(F.size("mates") == F.size(F.expr(reached)))
    to = F.array_distinct(F.transform(F.filter("around", lambda n: n["t"] != F.col("territory")), lambda n: n["t"]))
    x = x.withColumn("to", F.explode(to)).withColumn("there", F.try_element_at("sums", "to"))
    # The piece of the other territory: any of those that the unit touches.
    return x.withColumn("piece", F.array_min(F.transform(F.filter("around", lambda n: n["t"] == F.col("to")), lambda n: n["c"]))).drop("owner", "sums", "around", "mates", "near", "links")


def _best_moves(offers: DataFrame) -> DataFrame:
    """At most one move out of a territory and one into it, the highest gain first; one that gives doesn't take."""
    order = (F.desc("gain"), F.col("zip3"), F.col("to"))
    out = offers.withColumn("r", _nearest([SIZE, "territory"], *order)).where("r = 1").withColumn("r", _nearest([SIZE, "to"], *order)).where("r = 1").select(SIZE, "zip3", "territory", "to", "piece")
    return out.join(out.select(SIZE, F.col("to").alias("territory")), [SIZE, "territory"], "left_anti")


def _variation(state: DataFrame) -> dict[int, tuple[float, int]]:
    """Variation of loads and number of units just moved, by size."""
    t = state.groupBy(SIZE, "territory").agg(F.sum("workload").alias("w"), F.count_if("moved").alias("m"))
    rows = t.groupBy(SIZE).agg(F.try_divide(F.stddev_pop("w"), F.nullif(F.avg("w"), F.lit(0.0))).alias("cv"), F.sum("m").alias("m")).collect()  # a row per size
    return {r[SIZE]: (r["cv"] or 0.0, r["m"]) for r in rows}


def improve_balance(state: DataFrame, passes: int = 200) -> DataFrame:
    """Boundary moves out of territories above the mean load that lower the squared deviation of loads.

    It ends without a move, when no size's variation has fallen in ``STALL`` rounds, or after ``passes`` rounds.
    """
    best, stalled = {}, 0
    for _ in range(passes):
        gain = F.round(2 * F.col("workload") * (F.col("here.load") - F.col("there.load") - F.col("workload")), 9)
        state = _moved(state, _best_moves(_safe_offers(state).where("here.load > mean").withColumn("gain", gain).where("gain > 0")))
        now = _variation(state)
        fell = [n for n, (cv, _) in now.items() if n not in best or cv < best[n] - 1e-4]
        best |= {n: now[n][0] for n in fell}
        stalled = 0 if fell else stalled + 1
        if stalled >= STALL or not sum(m for _, m in now.values()):
            break
    return state


def polish_distance(state: DataFrame, slack: float = SLACK, passes: int = 100) -> DataFrame:
    """Boundary moves to a nearer centre that keep the other territory within its capacity, as long as travel falls for some size."""
    best = materialise(state)
    travel = {r[SIZE]: r["travel_miles"] for r in metrics(best, by=[SIZE]).collect()}  # a row per size
    for _ in range(passes):
        way = lambda at: miles(F.col("lat"), F.col("lon"), F.col(at)["lat"], F.col(at)["lon"])
        gain = F.round(F.col("workload") * (way("here") - way("there")), 6)
        offers = _safe_offers(best).where(F.col("there.load") + F.col("workload") <= slack * F.col("mean")).withColumn("gain", gain).where("gain > 0")
        trial = _moved(best, _best_moves(offers))
        now = {r[SIZE]: r["travel_miles"] for r in metrics(trial, by=[SIZE]).collect()}  # a row per size
        better = [n for n, t in now.items() if t is not None and t < travel[n] * (1 - 1e-4)]
        if not better:
            break
        best = materialise(trial.where(F.col(SIZE).isin(better)).unionByName(best.where(~F.col(SIZE).isin(better)), allowMissingColumns=True))
        travel |= {n: now[n] for n in better}
    return best


def _ranks(state: DataFrame, worst_cv: float) -> dict[int, tuple[float, float, float]]:
    """By size: share of territories in pieces, variation beyond ``worst_cv``, and travel; lower is better."""
    rows = metrics(state, labelled(state), [SIZE]).collect()  # a row per size
    return {r[SIZE]: (-round(r["contiguity_rate"], 3), round(max(r["workload_cv"] or 0.0, worst_cv), 2), r["travel_miles"] or 0.0) for r in rows}


def solve(u: DataFrame, edges: DataFrame, sizes: list[int], slack: float = SLACK, max_iterations: int = 40, worst_cv: float = 0.20) -> DataFrame:
    """Aligned units for several numbers of territories, in long format: ``n_reps, zip3, lat, lon, territory, workload``.

    From workload-weighted k-means: capacity assignment, contiguity and balance, again from the new centres while a size gets
    better; the best alignments are then polished for travel. An alignment is better with more territories in one piece, then
    with a variation of loads within ``worst_cv``, then with less travel. Boundary moves keep pieces whole, so components are
    searched after an assignment and for the measures only.
    """
    near = neighbourhoods(u, edges)
    starts = [kmeans(near, n).withColumn(SIZE, F.lit(n)) for n in sizes]
    now = materialise(reduce(DataFrame.unionByName, starts))
    best, rank = None, {}
    for _ in range(max_iterations):
        now = repair_contiguity(labelled(capacity_assignment(near, centroids(now), slack)))
        now = improve_balance(now)
        found = _ranks(now, worst_cv)
        # Travel has to fall by a hundredth, or the rest to get better.
        better = [n for n, f in found.items() if n not in rank or f[:2] < rank[n][:2] or (f[:2] == rank[n][:2] and f[2] < 0.99 * rank[n][2])]
        if not better:
            break
        best = now if best is None else materialise(now.where(F.col(SIZE).isin(better)).unionByName(best.where(~F.col(SIZE).isin(better)), allowMissingColumns=True))
        rank |= {n: found[n] for n in better}
        now = now.where(F.col(SIZE).isin(better))
    polished = polish_distance(best, slack)
    after = _ranks(polished, worst_cv)
    good = [n for n in after if after[n] <= rank[n]]
    out = polished.where(F.col(SIZE).isin(good)).unionByName(best.where(~F.col(SIZE).isin(good)), allowMissingColumns=True)
    return materialise(out.select(SIZE, "zip3", "lat", "lon", "territory", "workload"))


def headline(u: DataFrame, edges: DataFrame, solved: DataFrame, size: int) -> DataFrame:
    """``alignment, n_reps`` and the metrics of the baseline, plain k-means and the solved alignments, all by the same measures."""
    u = materialise(u)
    parts = {"baseline": baseline(u, size).withColumn(SIZE, F.lit(size)), "kmeans": kmeans(u, size).withColumn(SIZE, F.lit(size)), "optimised": solved}
    kept = [df.select(F.lit(name).alias("alignment"), SIZE, "zip3", "lat", "lon", "territory", "workload") for name, df in parts.items()]
    every = materialise(reduce(DataFrame.unionByName, kept))
    by = ["alignment", SIZE]
    return metrics(every, components(every, edges, by), by)
