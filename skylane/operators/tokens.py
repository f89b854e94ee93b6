"""Route tokens: waypoints packed into bit strings and back, as table jobs.

A token is a header (version, bit width, number of waypoints) and a payload of one field per
waypoint: its offset from the base id in as few bits as the largest offset needs, then its type in
three bits, most significant bit first, padded to whole bytes and written in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.session import written

# Fixed values of the token format.
BASE_SYSTEM_ID = 30_000_000
TOKEN_VERSION = 1
MAX_BIT_WIDTH = 30
TYPE_BITS = 3
MAX_WAYPOINTS = 65_535
MAX_TYPE = 4
# Fields packed together into one piece of a payload: a multiple of 8 fields fills whole bytes at any width.
# Short pieces matter, since cutting a byte out of a text takes time in proportion to its place.
PIECE = 64
# Fields cut out of a token together when it is read.
SLICE = 64


def _nibbles(bits: Column) -> Column:
    """Hex text of a bit string whose length is a multiple of 8."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(0), (F.length(bits) / 8).cast("int") - 1),
            lambda i: F.lpad(F.conv(F.substring(bits, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"),
        ),
        "",
    )


def pack_tokens(waypoints: DataFrame) -> DataFrame:
    """``route_id, version, bit_width, waypoints, payload, problem`` of each route.

    ``waypoints`` are ``route_id, pos, system_id, waypoint_type`` with positions from 0. A bad id, type, a too
    wide offset or too many stops is a ``problem`` and leaves the payload null.
    """
    offset = F.col("system_id") - BASE_SYSTEM_ID
    shape = waypoints.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("waypoints"),
        F.max(offset).alias("widest"),
        F.min(offset).alias("lowest"),
        F.bool_and(F.col("waypoint_type").between(0, MAX_TYPE)).alias("typed"),
    ).withColumn(
        "bit_width",
        F.when(F.col("widest") == 0, 1).when(F.col("widest") > 0, F.length(F.bin("widest"))).cast("int"),
    )
    problem = (
        F.when(F.col("lowest") < 0, "system id below base")
        .when(F.col("bit_width") > MAX_BIT_WIDTH, "bit width out of range")
        .when(F.col("waypoints") > MAX_WAYPOINTS, "too many waypoints")
        .when(~F.coalesce(F.col("typed"), F.lit(False)), "invalid waypoint type")
    )
    shape = shape.withColumn("problem", problem).drop("lowest", "typed", "widest")
    field = F.concat(
        F.lpad(F.bin(offset), F.col("bit_width"), F.lit("0")), F.lpad(F.bin("waypoint_type"), TYPE_BITS, "0")
    )
    pieces = (
        waypoints.join(shape.where("problem is null").select("route_id", "bit_width"), "route_id")
        .select("route_id", "pos", F.floor(F.col("pos") / PIECE).alias("piece"), field.alias("field"))
        .groupBy("route_id", "piece")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "field"))), lambda p: p["field"]), "").alias("bits"))
    )
    padded = F.rpad("bits", (F.ceil(F.length("bits") / 8) * 8).cast("int"), F.lit("0"))
    # At most MAX_WAYPOINTS / PIECE pieces are left to join per route.
    payloads = (
        pieces.select("route_id", "piece", _nibbles(padded).alias("hex"))
        .groupBy("route_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "hex"))), lambda p: p["hex"]), "").alias("payload"))
    )
    return shape.join(payloads, "route_id", "left").select(
        "route_id",
        F.lit(TOKEN_VERSION).alias("version"),
        "bit_width",
        "waypoints",
        "payload",
        "problem",
    )


def token_text() -> Column:
    """Header and payload as one hex text."""
    return F.concat(
        F.lpad(F.hex(F.col("version").cast("long")), 2, "0"),
        F.lpad(F.hex(F.col("bit_width").cast("long")), 2, "0"),
        F.lpad(F.hex(F.col("waypoints").cast("long")), 4, "0"),
        F.col("payload"),
    )


def token_headers(tokens: DataFrame) -> DataFrame:
    """Read the header of ``route_id, token`` rows; ``problem`` says why a token cannot be read."""
    text = F.upper("token")

    def number(start: int, length: int) -> Column:
        return F.conv(F.substring(text, start, length), 16, 10).cast("int")

    parsed = tokens.select(
        "route_id",
        text.alias("token"),
        F.when(F.length("token") >= 8, number(1, 2)).alias("version"),
        F.when(F.length("token") >= 8, number(3, 2)).alias("bit_width"),
        F.when(F.length("token") >= 8, number(5, 4)).alias("waypoints"),
    )
    needed = F.col("waypoints") * (F.col("bit_width") + TYPE_BITS)
    held = F.floor((F.length("token") - 8) / 2) * 8
    problem = (
        F.when(F.col("version").isNull(), "truncated")
        .when(F.col("version") != TOKEN_VERSION, "unsupported version")
        .when(~F.col("bit_width").between(1, MAX_BIT_WIDTH), "invalid bit width")
        .when(needed > held, "truncated")
    )
    return parsed.withColumn("problem", problem)


def unpack_tokens(tokens: DataFrame) -> DataFrame:
    """Waypoints of readable tokens: ``route_id, pos, system_id, waypoint_type, problem``.

    An unreadable token gives one row with its problem; an unknown waypoint type is a problem of that row.
    """
    # Both the waypoints and the problems are read from it, so the tokens are made once.
    read = written(token_headers(tokens), "token-headers")
    width = F.col("bit_width") + TYPE_BITS
    slices = read.where("problem is null and waypoints > 0").select(
        "route_id",
        "bit_width",
        "waypoints",
        "token",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("waypoints") - 1) / SLICE).cast("int"))).alias("slice"),
    )
    # A slice of fields starts on a whole byte, so it is cut out of the token before it is spread.
    slices = slices.select(
        "route_id",
        "bit_width",
        "slice",
        F.least(F.lit(SLICE), F.col("waypoints") - F.col("slice") * SLICE).alias("held"),
        F.substring("token", 9 + F.col("slice") * (width * (SLICE // 4)), width * (SLICE // 4)).alias("hex"),
    )
    fields = slices.select("*", F.explode(F.sequence(F.lit(0), F.col("held") - 1)).alias("nth"))
    # The bytes that hold the field, then the field inside them.
    first = F.floor(F.col("nth") * width / 8).cast("int")
    last = F.floor(((F.col("nth") + 1) * width - 1) / 8).cast("int")
    digits = F.substring("hex", first * 2 + 1, (last - first + 1) * 2)
    # At most 5 bytes, so that they are a number: what follows the field is shifted off, what precedes it is masked.
    after = (last - first + 1) * 8 - (F.col("nth") * width - first * 8) - width
    fields = fields.withColumn("pos", F.col("slice") * SLICE + F.col("nth")).withColumns(
        {"held_bits": F.conv(digits, 16, 10).cast("long"), "after": after.cast("int")}
    )
    shifted = F.call_function("shiftright", F.col("held_bits"), F.col("after"))
    fields = fields.withColumn("field", shifted)
    system = (
        F.call_function("shiftright", F.col("field"), F.lit(TYPE_BITS))
        .bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit_width")) - 1)
        + BASE_SYSTEM_ID
    )
    kind = F.col("field").bitwiseAND((1 << TYPE_BITS) - 1).cast("int")
    waypoints = fields.select(
        "route_id",
        "pos",
        system.alias("system_id"),
        kind.alias("waypoint_type"),
        F.when(kind > MAX_TYPE, "invalid waypoint type").alias("problem"),
    )
    unread = read.where("problem is not null").select(
        "route_id",
        F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("long").alias("system_id"),
        F.lit(None).cast("int").alias("waypoint_type"),
        "problem",
    )
    return waypoints.unionByName(unread)
