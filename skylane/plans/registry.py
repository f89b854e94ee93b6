"""Named queries over the sample map, each with SQL for the check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylane.plans import sample_map as src
from skylane.plans.sample_map import SampleMap


@dataclass(frozen=True)
class Query:
    run: Callable[[SampleMap], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a function under its own name; ``sql`` may build on the named parts in ``uses``."""

    def register(run: Callable[[SampleMap], DataFrame]):
        QUERIES[run.__name__] = Query(run, check_sql(sql, uses) if sql else None)
        return run

    return register


def runnable(entry: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: entry.run(SampleMap(spark, folder))


def r6(value: Column | str) -> Column:
    """Six decimals: engines differ in the last digits of a double."""
    return F.round(value, 6)


def r4(value: Column | str) -> Column:
    return F.round(value, 4)


def _plain(text: str) -> str:
    for name in src.SOURCE_TABLES:
        text = text.replace("{" + name + "}", name)
    return text.strip()


_LENGTH = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"

# Named parts of the check SQL: name -> (parts it builds on, text).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_regions": ((), _plain(src.REGIONS)),
    "raw_constellations": ((), _plain(src.CONSTELLATIONS)),
    "raw_systems": ((), _plain(src.SOLAR_SYSTEMS)),
    "raw_jumps": ((), _plain(src.JUMPS)),
    "raw_planets": ((), _plain(src.PLANETS)),
    "raw_moons": ((), _plain(src.MOONS)),
    "route_requests": ((), _plain(src.ROUTE_REQUESTS)),
    "scout_requests": ((), _plain(src.SCOUT_REQUESTS)),
    "request_log": ((), _plain(src.REQUEST_LOG)),
    "corpus": ((), _plain(src.CORPUS_STEPS)),
    "ship_rows": ((), _plain(src.SHIP_CATALOGUE)),
    "ships": (
        (),
        "SELECT * FROM (VALUES "
        + ", ".join(f"('{n}', {m:e}, {c:e}, {f:e}, {g:e})" for n, m, c, f, g in src.SHIPS)
        + ") AS v(name, base_mass_kg, specific_heat, fuel_capacity, cargo_capacity)",
    ),
    "bare": (
        ("raw_systems", "raw_constellations", "raw_regions"),
        """SELECT s.solarSystemId AS id, s.name, s.constellationId AS constellation_id, c.name AS constellation_name,
                  s.regionId AS region_id, r.name AS region_name, s.star_temperature, s.star_luminosity,
                  s.centerX / 9.4607304725808e15 AS x, s.centerY / 9.4607304725808e15 AS y,
                  s.centerZ / 9.4607304725808e15 AS z
           FROM raw_systems s LEFT JOIN raw_constellations c ON c.constellationId = s.constellationId
           LEFT JOIN raw_regions r ON r.regionId = s.regionId""",
    ),
    "bodies": (
        ("raw_planets", "raw_moons"),
        """SELECT solarSystemId AS system_id, 'planet' AS kind, centerX AS x, centerY AS y, centerZ AS z FROM raw_planets
           UNION ALL SELECT solarSystemId, 'moon', centerX, centerY, centerZ FROM raw_moons""",
    ),
    "body_facts": (
        ("bodies",),
        """SELECT system_id, nullif(count(*) FILTER (kind = 'planet'), 0) AS planet_count,
                  nullif(count(*) FILTER (kind = 'moon'), 0) AS moon_count,
                  max(sqrt(x * x + y * y + z * z)) AS outermost_m
           FROM bodies GROUP BY system_id""",
    ),
    "systems": (
        ("bare", "body_facts"),
        """SELECT s.*, CAST(planet_count AS INTEGER) AS planet_count, CAST(moon_count AS INTEGER) AS moon_count,
                  CASE WHEN star_luminosity > 0 AND outermost_m > 0 THEN
                    atan(sqrt(star_luminosity / ((outermost_m / 299792458e0) * (outermost_m / 299792458e0)) * 1e-21))
                    * (200e0 / pi()) END AS min_external_temp
           FROM bare s LEFT JOIN body_facts f ON f.system_id = s.id""",
    ),
    "pairs": (
        ("raw_jumps", "raw_systems"),
        """SELECT src, dst FROM (
             SELECT fromSystemId AS src, toSystemId AS dst FROM raw_jumps
             UNION SELECT toSystemId, fromSystemId FROM raw_jumps)
           WHERE src IN (SELECT solarSystemId FROM raw_systems) AND dst IN (SELECT solarSystemId FROM raw_systems)""",
    ),
    "gates": (
        ("pairs", "bare"),
        f"""SELECT src, dst, 'gate' AS kind, {_LENGTH} AS distance
            FROM pairs JOIN bare a ON a.id = src JOIN bare b ON b.id = dst""",
    ),
    "gaps": (
        ("bare",),
        f"SELECT a.id AS src, b.id AS dst, {_LENGTH} AS distance FROM bare a JOIN bare b ON a.id <> b.id",
    ),
    "nearest8": (
        ("gaps",),
        """SELECT src, dst, distance, row_number() OVER (PARTITION BY src ORDER BY distance, dst) AS rank
           FROM gaps QUALIFY rank <= 8""",
    ),
    "walks": (("corpus",), "SELECT route_id AS request_id, pos AS step, system_id FROM corpus"),
    "hops": (
        ("walks", "systems", "pairs"),
        f"""SELECT w.request_id, w.step, w.system_id, b.name, b.min_external_temp, b.planet_count, b.moon_count,
                   w.prev_id, a.min_external_temp AS origin_temp, w.next_id,
                   CASE WHEN w.prev_id IS NOT NULL THEN {_LENGTH} END AS distance,
                   CASE WHEN w.prev_id IS NOT NULL THEN CASE WHEN p.src IS NOT NULL THEN 'gate' ELSE 'jump' END END AS method,
                   coalesce(CASE WHEN w.next_id IS NOT NULL THEN n.src IS NOT NULL END, false) AS next_is_gate
            FROM (SELECT *, lag(system_id) OVER r AS prev_id, lead(system_id) OVER r AS next_id FROM walks
                  WINDOW r AS (PARTITION BY request_id ORDER BY step)) w
            JOIN systems b ON b.id = w.system_id
            LEFT JOIN systems a ON a.id = w.prev_id
            LEFT JOIN pairs p ON p.src = w.prev_id AND p.dst = w.system_id
            LEFT JOIN pairs n ON n.src = w.system_id AND n.dst = w.next_id""",
    ),
    # One ship per corpus route, so that every ship and both mass modes occur.
    "loads": (
        ("walks", "ships"),
        """SELECT r.request_id, s.name AS ship_name, base_mass_kg, specific_heat, fuel_capacity AS fuel_load,
                  CAST(r.request_id % 7 * 1000 AS DOUBLE) AS cargo, CAST(5 + r.request_id % 20 AS DOUBLE) AS quality,
                  r.request_id % 2 = 1 AS dynamic_mass
           FROM (SELECT DISTINCT request_id FROM walks) r
           JOIN ships s ON s.name = CASE r.request_id % 3 WHEN 0 THEN 'Reflex' WHEN 1 THEN 'Forager' ELSE 'Warden' END""",
    ),
}

# Parts referred to several times and costly enough to be computed once.
_KEEP = {"systems", "pairs", "gates", "gaps", "nearest8", "hops", "bare"}


def check_sql(body: str, uses: tuple[str, ...]) -> str:
    """The body with the parts it needs in front, dependencies first."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in PARTS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in uses:
        need(name)
    parts = [f"{n} AS {'MATERIALIZED ' if n in _KEEP else ''}({PARTS[n][1]})" for n in order]
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE"):
        text = text[len("WITH RECURSIVE"):].strip()
        return "WITH RECURSIVE " + ",\n".join([*parts, text])
    if not parts:
        return text
    return "WITH " + ",\n".join(parts) + "\n" + text
