"""Names, labels and small text renderings as column expressions, and name similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of developer systems, hidden unless asked for (case-sensitive).
DEVELOPER_SYSTEM = r"^(AD|V-)[0-9]+$"
BLACK_HOLE_IDS = (30000001, 30000003)
# Waypoint types.
START, JUMP, NPC_GATE, SMART_GATE, SET_DESTINATION = 0, 1, 2, 3, 4


def folded(name: Column) -> Column:
    """Name key for case-insensitive lookups."""
    return F.lower(F.trim(name))


def is_developer_system(name: Column) -> Column:
    return F.coalesce(name.rlike(DEVELOPER_SYSTEM), F.lit(False))


def is_black_hole(system_id: Column) -> Column:
    return system_id.between(*BLACK_HOLE_IDS)


def temperature_band(kelvin: Column) -> Column:
    """hot above 50 K, warm above 20 K, else cool; an unknown temperature counts as 0."""
    known = F.coalesce(kelvin, F.lit(0.0))
    return F.when(known > 50, "hot").when(known > 20, "warm").otherwise("cool")


def step_tag(is_first: Column, is_last: Column, method: Column) -> Column:
    """STRT, GOAL, GATE or JUMP; a one-step route is a start."""
    return (
        F.when(is_first, "STRT").when(is_last, "GOAL").when(method == "gate", "GATE").otherwise("JUMP")
    )


def cooldown_text(seconds: Column) -> Column:
    """Duration such as ``2m4s`` or ``45s``, rounded, at most a day."""
    whole = F.round(F.least(F.greatest(seconds, F.lit(0.0)), F.lit(86_400.0))).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    rest = (whole % 60).cast("string")
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m"), rest, F.lit("s"))).otherwise(
        F.concat(rest, F.lit("s"))
    )


def whole_units(value: Column) -> Column:
    """Fuel figures as reported outwards: rounded up to whole units."""
    return F.ceil(value).cast("long")


def status_class(status: Column) -> Column:
    """2xx, 3xx, 4xx, 5xx or other."""
    hundred = F.floor(status / 100).cast("int")
    return F.when(hundred.between(2, 5), F.concat(hundred.cast("string"), F.lit("xx"))).otherwise("other")


def waypoint_type(is_first: Column, method: Column) -> Column:
    """Type of a routed step: start, gate, or jump for anything else."""
    return F.when(is_first, START).when(method == "gate", NPC_GATE).otherwise(JUMP)


def listed_waypoint_type(is_first: Column, is_last: Column, given: Column) -> Column:
    """Type of a step in a hand-written list: the given word, else start / destination / jump."""
    word = F.lower(given)
    return (
        F.when(word == "start", START)
        .when(word == "jump", JUMP)
        .when(word == "npc-gate", NPC_GATE)
        .when(word == "smart-gate", SMART_GATE)
        .when(word.isin("destination", "dest"), SET_DESTINATION)
        .when(given.isNotNull(), F.lit(None).cast("int"))
        .when(is_first, START)
        .when(is_last, SET_DESTINATION)
        .otherwise(JUMP)
    )


# Similarity above which a shared prefix counts, and the weight and length of that prefix.
PREFIX_FLOOR, PREFIX_WEIGHT, PREFIX_LENGTH = 0.7, 0.1, 4
_MATCHES = "struct<used:array<int>,left:array<string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _matched(a: Column, b: Column) -> Column:
    """Each character of ``a`` in turn takes the first free equal one of ``b`` within reach.

    Returns the places taken in ``b`` and the characters of ``a`` that took one, both in the order of ``a``.
    """
    reach = F.greatest(F.floor(F.greatest(F.size(a), F.size(b)) / 2).cast("int") - 1, F.lit(0))

    def take(acc: Column, x: Column) -> Column:
        low, high = F.greatest(x["at"] - reach, F.lit(0)), F.least(x["at"] + reach, F.size(b) - 1)
        places = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        free = F.get(F.filter(places, lambda j: (F.get(b, j) == x["ch"]) & ~F.array_contains(acc["used"], j)), F.lit(0))
        grown = F.struct(F.array_append(acc["used"], free).alias("used"), F.array_append(acc["left"], x["ch"]).alias("left"))
        return F.when(free.isNull(), acc).otherwise(grown.cast(_MATCHES))

    letters = F.transform(a, lambda ch, i: F.struct(i.alias("at"), ch.alias("ch")))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("left")).cast(_MATCHES)
    return F.aggregate(letters, start, take)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro similarity of two names, raised by shared leading characters once it is above the floor."""

    def letters(name: Column) -> Column:
        return F.array_remove(F.split(name, ""), "")

    def score(x: Column, y: Column, m: Column) -> Column:
        right = F.transform(F.array_sort(m["used"]), lambda j: F.get(y, j))
        unequal = F.zip_with(m["left"], right, lambda p, q: (p != q).cast("int"))
        swapped = F.floor(F.aggregate(unequal, F.lit(0), lambda n, u: n + u) / 2)
        n = F.size(m["used"])
        return F.when(n > 0, (n / F.size(x) + n / F.size(y) + (n - swapped) / n) / 3.0).otherwise(0.0)

    def raised(jaro: Column) -> Column:
        prefix = F.lit(0)
        for k in range(PREFIX_LENGTH, 0, -1):
            shared = (F.left(a, F.lit(k)) == F.left(b, F.lit(k))) & (F.least(F.char_length(a), F.char_length(b)) >= k)
            prefix = F.greatest(prefix, F.when(shared, k).otherwise(0))
        return F.when(jaro > PREFIX_FLOOR, jaro + PREFIX_WEIGHT * prefix * (1.0 - jaro)).otherwise(jaro)

    jaro = _let(letters(a), lambda x: _let(letters(b), lambda y: _let(_matched(x, y), lambda m: score(x, y, m))))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(_let(jaro, raised))
