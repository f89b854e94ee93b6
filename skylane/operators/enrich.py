"""Per-hop distance, method, fuel and heat of routes, and their roll-ups.

Routes are ``request_id, step, system_id`` with steps counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.functions.geometry import distance
from skylane.functions.ship_physics import (
    FUEL_UNIT_MASS_KG,
    HEAT_CRITICAL,
    HEAT_NOMINAL,
    bound,
    jump_fuel,
    jump_fuel_of,
    jump_heat_energy,
    jump_length,
    quality_share,
    total_mass,
    with_heat,
)
from skylane.functions.text import step_tag, temperature_band, waypoint_type
from skylane.operators.ordered import running_total, with_neighbours
from skylane.session import counted, shuffled_side, small_side, written

# Hops folded by one task at a time; a longer route goes on in a further pass.
FOLD_HOPS = 512
UNKNOWN_NAME = "<unknown>"


def with_systems(steps: DataFrame, systems: DataFrame) -> DataFrame:
    """Name, position, ambient temperature and body counts of each step; nulls for an unknown system."""
    attributes = systems.select(
        F.col("id").alias("system_id"),
        "name", "x", "y", "z", "min_external_temp", "planet_count", "moon_count", "star_temperature",
    )
    return steps.join(shuffled_side(attributes, systems.count()), "system_id", "left")


def display_name() -> Column:
    return F.coalesce(F.col("name"), F.lit(UNKNOWN_NAME))


def with_hops(located: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add the hop that led to each step and what surrounds it.

    ``distance`` is the straight line from the previous step, null at the start or without positions;
    ``method`` is gate where a gate joins the two systems, else jump.
    """
    placed = with_neighbours(located, "request_id", "step", ["system_id", "x", "y", "z", "min_external_temp"])
    line = distance(*[F.col(f"prev_{c}") for c in "xyz"], *[F.col(c) for c in "xyz"])
    hops = written(
        placed.withColumn("distance", line)
        .withColumn("is_start", F.col("step") == 0)
        .withColumn("is_goal", F.col("next_system_id").isNull())
        .withColumnRenamed("prev_min_external_temp", "origin_temp")
        .drop("prev_x", "prev_y", "prev_z", "next_x", "next_y", "next_z", "next_min_external_temp"),
        "placed-hops",
    )
    # The gates that any hop takes; only the two ids of a hop travel to find them.
    taken = hops.select(F.col("prev_system_id").alias("src"), F.col("system_id").alias("dst")).where("src is not null")
    met, rows = counted(pairs.select("src", "dst").distinct().join(taken, ["src", "dst"], "left_semi"), "gates-met")
    came = small_side(met.select(F.col("src").alias("prev_system_id"), F.col("dst").alias("system_id"), F.lit(True).alias("gate")), rows)
    goes = small_side(met.select(F.col("src").alias("system_id"), F.col("dst").alias("next_system_id"), F.lit(True).alias("next_gate")), rows)
    return (
        hops.join(came, ["prev_system_id", "system_id"], "left")
        .join(goes, ["system_id", "next_system_id"], "left")
        .withColumn("method", F.when(F.col("prev_system_id").isNotNull(), F.when(F.col("gate"), "gate").otherwise("jump")))
        .withColumn("next_is_gate", F.coalesce("next_gate", F.lit(False)))
        .drop("gate", "next_gate")
    )


def with_labels(hops: DataFrame) -> DataFrame:
    """Tag, temperature band and waypoint type of each step."""
    return hops.withColumns(
        {
            "tag": step_tag(F.col("is_start"), F.col("is_goal"), F.col("method")),
            "band": temperature_band(F.col("min_external_temp")),
            "waypoint_type": waypoint_type(F.col("is_start"), F.col("method")),
        }
    )


def route_totals(hops: DataFrame) -> DataFrame:
    """Hops, total, jump and gate distance per route; hops without a distance add nothing."""
    length = F.coalesce(F.col("distance"), F.lit(0.0))
    sums = hops.groupBy("request_id").agg(
        (F.count(F.lit(1)) - 1).alias("hops"),
        F.sum(length).alias("total_distance"),
        F.sum(F.when(F.col("method") == "jump", length).otherwise(0.0)).alias("jump_distance"),
    )
    return sums.withColumn("gate_distance", F.col("total_distance") - F.col("jump_distance"))


def route_endpoints(steps: DataFrame) -> DataFrame:
    """First and last system of each route."""
    return steps.groupBy("request_id").agg(
        F.min_by("system_id", "step").alias("start_id"), F.max_by("system_id", "step").alias("goal_id")
    )


def _taken_edges(hops: DataFrame, edges: DataFrame, src: str, dst: str, how: str) -> DataFrame:
    """Edges of a hop's own graph between its two systems as ``edge_kind, edge_length``."""
    usable = edges.select(
        F.col("src").alias("edge_src"),
        F.col("dst").alias("edge_dst"),
        F.col("graph_id").alias("edge_graph"),
        F.col("kind").alias("edge_kind"),
        F.col("distance").alias("edge_length"),
    )
    in_graph = ((F.col("edge_kind") == "gate") & (F.col("mode") != "spatial")) | (
        (F.col("edge_graph") == F.col("graph_id")) & (F.col("mode") != "gate")
    )
    same = (F.col(src) == F.col("edge_src")) & (F.col(dst) == F.col("edge_dst"))
    return hops.join(usable, same & in_graph, how)


def hop_kinds(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """Gates and jumps per route, by the shortest edge between consecutive steps.

    ``hops`` carry ``graph_id`` and ``mode`` (gate, spatial or hybrid) of their search; a gate beats a
    jump of equal length, and a pair without an edge counts as a gate.
    """
    between = hops.where("prev_system_id is not null").select(
        "request_id", "step", "mode", "graph_id",
        F.col("prev_system_id").alias("src"), F.col("system_id").alias("dst"),
    )
    joined = _taken_edges(between, edges, "src", "dst", "left")
    chosen = joined.groupBy("request_id", "step", "mode").agg(
        F.min(F.struct("edge_length", "edge_kind"))["edge_kind"].alias("kind")
    )
    is_jump = (F.col("mode") == "spatial") | ((F.col("mode") == "hybrid") & (F.col("kind") == "spatial"))
    return chosen.groupBy("request_id").agg(
        F.count_if(~F.coalesce(is_jump, F.lit(False))).alias("gates"),
        F.count_if(F.coalesce(is_jump, F.lit(False))).alias("jumps"),
    )


def unsafe_requests(hops: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests whose found route has a hop that would reach the critical temperature.

    Looks at the shortest edge between the steps, as a ship would take it. ``hops`` carry
    ``graph_id, mode, avoid_critical_state`` and the ship columns of the request.
    """
    between = hops.where("prev_system_id is not null and avoid_critical_state and ship_name is not null")
    joined = _taken_edges(between, edges, "prev_system_id", "system_id", "inner")
    taken = joined.groupBy("request_id", "step").agg(
        F.min(F.struct("edge_length", "edge_kind")).alias("edge"),
        *[F.any_value(c).alias(c) for c in (
            "min_external_temp", "ship_base_mass_kg", "ship_specific_heat", "loaded_fuel", "loaded_cargo",
            "heat_calibration",
        )],
    )
    mass = total_mass(F.col("ship_base_mass_kg"), F.col("loaded_fuel"), F.col("loaded_cargo"))
    rise = jump_heat_energy(
        mass, F.col("edge.edge_length"), F.col("ship_base_mass_kg"), F.col("heat_calibration")
    ) / (mass * F.col("ship_specific_heat"))
    reached = F.coalesce("min_external_temp", F.lit(0.0)) + rise
    return (
        taken.where((F.col("edge.edge_kind") == "spatial") & (reached >= HEAT_CRITICAL))
        .select("request_id")
        .distinct()
    )


# --- fuel ---------------------------------------------------------------------------------------------

# Columns a hop row carries for fuel: the request's ship and how it is loaded.
LOAD = ["ship_base_mass_kg", "loaded_fuel", "loaded_cargo", "fuel_quality", "dynamic_mass"]


def running_fuel(hops: DataFrame) -> DataFrame:
    """Fuel along a route at constant mass, never refuelling: a running total.

    Takes jump rows with ``distance`` and ``LOAD``; adds ``hop_cost, cumulative, remaining``.
    """
    mass = total_mass(F.col("ship_base_mass_kg"), F.col("loaded_fuel"), F.col("loaded_cargo"))
    priced = hops.withColumn("hop_cost", jump_fuel(mass, F.col("fuel_quality"), F.col("distance")))
    return running_total(priced, "request_id", "step", "hop_cost", "cumulative").withColumn(
        "remaining", F.greatest(F.col("loaded_fuel") - F.col("cumulative"), F.lit(0.0))
    )


_HOP_OUT = "array<struct<step:int,hop_cost:double,cumulative:double,remaining:double,warning:string>>"


def _fold(refuel: bool, invalid_cost: float | None) -> Column:
    """Fuel recurrence over one block of hops, starting from ``carried_remaining`` / ``carried_total``."""
    start = F.struct(
        F.col("carried_remaining").alias("remaining"),
        F.col("carried_total").alias("total"),
        F.array().cast(_HOP_OUT).alias("out"),
    )

    def hop(acc: Column, h: Column) -> Column:
        fuel_aboard = F.when(F.col("dynamic_mass"), acc["remaining"]).otherwise(F.col("loaded_fuel"))
        mass = F.col("dry_mass") + fuel_aboard * FUEL_UNIT_MASS_KG
        return bound({"mass": mass}, lambda m: bound({"cost": priced(m["mass"], h)}, lambda c: paid(acc, h, c["cost"])))

    def priced(mass: Column, h: Column) -> Column:
        cost = jump_fuel_of(mass, F.col("quality_share"), h["length"])
        if invalid_cost is not None:
            cost = F.coalesce(cost, F.lit(invalid_cost))
        return F.when(h["is_gate"], F.lit(0.0)).otherwise(cost)

    def paid(acc: Column, h: Column, cost: Column) -> Column:
        short = ~h["is_gate"] & (cost > acc["remaining"]) if refuel else F.lit(False)
        remaining = F.when(cost.isNull(), F.lit(None).cast("double")).when(short, F.col("loaded_fuel")).otherwise(
            F.greatest(acc["remaining"] - cost, F.lit(0.0))
        )
        after = {"remaining": remaining, "total": acc["total"] + cost, "short": short}
        return bound(after, lambda s: noted(acc, h, cost, s))

    def noted(acc: Column, h: Column, cost: Column, s: Column) -> Column:
        row = F.struct(
            h["step"].cast("int").alias("step"),
            cost.alias("hop_cost"),
            s["total"].alias("cumulative"),
            s["remaining"].alias("remaining"),
            F.when(s["short"], F.lit("REFUEL")).alias("warning"),
        )
        return F.struct(
            s["remaining"].alias("remaining"), s["total"].alias("total"), F.array_append(acc["out"], row).alias("out")
        )

    return F.aggregate(F.col("todo"), start, hop)


def fold_fuel(
    hops: DataFrame, *, refuel: bool = True, invalid_cost: float | None = None, block: int = FOLD_HOPS
) -> DataFrame:
    """Fuel along a route where each hop depends on the fuel left: ``request_id, step, hop_cost, cumulative,
    remaining, warning``.

    A gate costs nothing and keeps the tank. With ``refuel``, a hop dearer than the tank refills it to the
    initial load, warns REFUEL, and is not deducted. With ``dynamic_mass`` the ship's mass follows the
    tank. A hop that cannot be priced gives null from there on, or ``invalid_cost``.

    Hops are folded inside the JVM, a bounded block of each route per pass; the state at a block's
    end feeds the next pass, so no route is ever gathered whole.
    """
    todo = written(
        hops.where("step > 0").select(
            "request_id", "step", jump_length(F.col("distance")).alias("length"), (F.col("method") == "gate").alias("is_gate"),
            "loaded_fuel", "dynamic_mass", quality_share(F.col("fuel_quality")).alias("quality_share"),
            (F.col("ship_base_mass_kg") + F.col("loaded_cargo")).alias("dry_mass"),
            F.floor((F.col("step") - 1) / block).cast("int").alias("block"),
        ),
        "fold-hops",
    )
    last = todo.agg(F.max("block")).first()[0]
    done: list[DataFrame] = []
    carried = None
    for number in range((last or 0) + 1):
        grouped = todo.where(F.col("block") == number).groupBy("request_id").agg(
            F.sort_array(F.collect_list(F.struct("step", "length", "is_gate"))).alias("todo"),
            *[F.any_value(c).alias(c) for c in ("loaded_fuel", "dynamic_mass", "quality_share", "dry_mass")],
        )
        if carried is None:
            started = grouped.withColumns({"carried_remaining": F.col("loaded_fuel"), "carried_total": F.lit(0.0)})
        else:
            started = grouped.join(carried, "request_id")
        folded = started.select("request_id", _fold(refuel, invalid_cost).alias("end"))
        if number < (last or 0):
            folded = written(folded, "fold-block")
        carried = folded.select(
            "request_id", F.col("end.remaining").alias("carried_remaining"), F.col("end.total").alias("carried_total")
        )
        # Each block has a hop. Of a plain inline Spark infers filters, for which it would fold every block thrice.
        done.append(folded.select("request_id", F.inline_outer("end.out")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def fuel_summary(hops: DataFrame, fuel: DataFrame) -> DataFrame:
    """Total fuel and what remains per route.

    After any refuel the remainder is reported as the initial load; else it is the last running value
    with dynamic mass, or the load less the total (not below 0).
    """
    loads = hops.groupBy("request_id").agg(
        F.any_value("loaded_fuel").alias("loaded_fuel"), F.any_value("dynamic_mass").alias("dynamic_mass")
    )
    totals = fuel.groupBy("request_id").agg(
        F.max_by("cumulative", "step").alias("total"),
        F.bool_or(F.col("warning").isNotNull()).alias("refuelled"),
        F.max_by("remaining", "step").alias("last_remaining"),
    )
    return totals.join(loads, "request_id").select(
        "request_id",
        "total",
        F.when(F.col("refuelled"), F.col("loaded_fuel"))
        .when(F.col("dynamic_mass"), F.col("last_remaining"))
        .otherwise(F.greatest(F.col("loaded_fuel") - F.col("total"), F.lit(0.0)))
        .alias("remaining"),
        "refuelled",
    )


# --- heat ---------------------------------------------------------------------------------------------


def hop_heat(hops: DataFrame) -> DataFrame:
    """Heat of each hop: ``request_id, step, hop_heat, warning, wait_seconds, residual, can_proceed``.

    A gate leaves the ship at nominal. A jump starts from the origin's ambient temperature, so hops do
    not depend on each other, and the rise does not depend on the mass aboard.
    """
    mass = total_mass(F.col("ship_base_mass_kg"), F.col("loaded_fuel"), F.col("loaded_cargo"))
    length = F.when(F.col("method") == "gate", F.lit(0.0)).otherwise(F.col("distance"))
    projected = with_heat(
        hops.where("step > 0"),
        "heat",
        mass=mass,
        specific_heat=F.col("ship_specific_heat"),
        hull_mass=F.col("ship_base_mass_kg"),
        calibration=F.col("heat_calibration"),
        distance=length,
        origin_ambient=F.col("origin_temp"),
        here_ambient=F.col("min_external_temp"),
        is_goal=F.col("is_goal"),
        next_is_gate=F.col("next_is_gate"),
    )
    return projected.select("request_id", "step", "heat.*")


def heat_summary(heat: DataFrame) -> DataFrame:
    """Total wait, final temperature and the warnings in route order."""
    warned = F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(), F.struct("step", "warning"))))
    return heat.groupBy("request_id").agg(
        F.coalesce(F.sum("wait_seconds"), F.lit(0.0)).alias("total_wait_seconds"),
        F.coalesce(F.max_by("residual", F.when(F.col("residual").isNotNull(), F.col("step"))), F.lit(HEAT_NOMINAL)).alias(
            "final_residual"
        ),
        F.transform(warned, lambda w: w["warning"]).alias("warnings"),
    )
