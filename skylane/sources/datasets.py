"""Whole datasets: subsets, fingerprints, freshness, manifests, inspection, spatial layout, results."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, CharType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType,
    StructType, TimestampNTZType, TimestampType, VarcharType,
)

from skylane.functions.geometry import cell
from skylane.sources.starmap import detect_layout, find_table

# --- subsets ------------------------------------------------------------------------------------------


def subset(tables: Mapping[str, DataFrame], keep: DataFrame) -> dict[str, DataFrame]:
    """The part of a current-layout map that belongs to the systems in ``keep`` (``id``).

    Jumps need both ends inside; regions and constellations are those the kept systems name.
    """
    ids = keep.select(F.col("id").alias("kept_id")).distinct()

    def inside(df: DataFrame, column: str) -> DataFrame:
        return df.join(ids, df[column] == ids["kept_id"], "left_semi")

    systems = inside(find_table(tables, "SolarSystems"), "solarSystemId")
    out = {"SolarSystems": systems}
    jumps = find_table(tables, "Jumps")
    out["Jumps"] = inside(inside(jumps, "fromSystemId"), "toSystemId")
    for name, key in (("Regions", "regionId"), ("Constellations", "constellationId")):
        if (df := find_table(tables, name)) is not None:
            out[name] = df.join(systems.select(key).distinct(), key, "left_semi")
    for name in ("Planets", "Moons"):
        if (df := find_table(tables, name)) is not None:
            out[name] = inside(df, "solarSystemId")
    return out


def write_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Write each table as Parquet under ``folder``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


# --- fingerprints and freshness -------------------------------------------------------------------------

# The states a recorded dataset can be in.
FRESH, STALE, LEGACY, MISSING, DATASET_MISSING, ERROR = (
    "fresh", "stale", "legacy_format", "missing", "dataset_missing", "error",
)


def exact_bits(value: Column) -> Column:
    """The 64 bits of a double as two numbers in text, ``exponent.fraction`` after its sign; null stays null.

    Arithmetic only, every step of it exact: powers of two and quotients by them are not rounded.
    """
    size = F.abs(value)
    finite = (size > 0) & (size < F.lit(float("inf"))) & ~F.isnan(value)
    safe = F.when(finite, size).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(safe))
    # A logarithm may be off by one beside a power of two.
    exact = guess + F.when(safe >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0) - F.when(safe < F.pow(F.lit(2.0), guess), 1).otherwise(0)
    exponent = F.greatest(exact, F.lit(-1022))
    fraction = (safe / F.pow(F.lit(2.0), exponent) * F.lit(2.0**52)).cast("long")
    shown = (
        F.when(F.isnan(value), "nan")
        .when(size == float("inf"), "inf")
        .when(size == 0, "0")
        .otherwise(F.concat_ws(".", exponent.cast("string"), fraction.cast("string")))
    )
    # A negative zero prints its sign too; not-a-number has none.
    sign = F.when(value.cast("string").startswith("-"), "-").otherwise("+")
    return F.when(value.isNotNull(), F.when(F.isnan(value), shown).otherwise(F.concat(sign, shown)))


def _sized(kind: str, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit(kind), F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~"))


def rendered(value: Column, kind: DataType) -> Column:
    """A value as text that no other value of any type shares: its kind, its length in bytes, its content.

    Null is ``~``. Lists and records are rendered from their parts, so their borders are in the text too.
    """
    if isinstance(kind, (FloatType, DoubleType)):
        return _sized("d", exact_bits(value.cast("double")))
    if isinstance(kind, IntegralType):
        return _sized("i", value.cast("string"))
    if isinstance(kind, DecimalType):
        return _sized("n", value.cast(f"decimal(38,{kind.scale})").cast("string"))
    if isinstance(kind, (StringType, VarcharType, CharType)):
        return _sized("s", value)
    if isinstance(kind, BooleanType):
        return _sized("b", value.cast("string"))
    if isinstance(kind, DateType):
        return _sized("y", F.unix_date(value).cast("string"))
    if isinstance(kind, TimestampType):
        return _sized("t", F.unix_micros(value).cast("string"))
    if isinstance(kind, TimestampNTZType):
        return _sized("z", value.cast("string"))
    if isinstance(kind, BinaryType):
        return _sized("x", F.hex(value))
    if isinstance(kind, ArrayType):
        return _sized("a", F.array_join(F.transform(value, lambda v: rendered(v, kind.elementType)), ""))
    if isinstance(kind, StructType):
        inner = F.concat(*[rendered(value[f.name], f.dataType) for f in kind.fields], F.lit(""))
        return _sized("r", F.when(value.isNotNull(), inner))
    raise TypeError(f"no rendering for values of type {kind.simpleString()}")


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Row count and an order-insensitive fingerprint of a table: the 128-bit sum of its rows' digests.

    A row's digest is the MD5 of its fields' renderings, whole: both halves are summed apart, each modulo 2**64. A sum,
    unlike an exclusive or, does not cancel repeated rows. Rows never leave their tasks, only partial sums do.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    digest = F.md5(F.concat(*[rendered(F.col(f"`{c}`"), kinds[c]) for c in columns or df.columns], F.lit("")))
    halves = [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)").alias(name) for at, name in ((1, "high"), (17, "low"))]

    def total(name: str) -> Column:
        # Sums of ten to the 18th rows fit.
        return (F.coalesce(F.sum(F.col(name).cast("decimal(28,0)")), F.lit(0).cast("decimal(38,0)")) % F.lit(Decimal(2**64))).cast("decimal(20,0)").cast("string")

    return df.select(*halves).agg(
        F.count(F.lit(1)).alias("row_count"), F.concat_ws("-", total("high"), total("low")).alias("fingerprint")
    )


def manifest(tables: Mapping[str, DataFrame], release_tag: str | None = None) -> DataFrame:
    """One row per table: ``table_name, row_count, fingerprint, release_tag``."""
    parts = [
        fingerprint(df).select(F.lit(name).alias("table_name"), "row_count", "fingerprint")
        for name, df in sorted(tables.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("release_tag", F.lit(release_tag).cast("string"))


def record_manifest(tables: Mapping[str, DataFrame], path: str, release_tag: str | None = None) -> None:
    """Leave the tables' manifest at ``path`` for later runs to compare with."""
    manifest(tables, release_tag).write.mode("errorifexists").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from storage; records of an older format lack columns, which read as null."""
    held = spark.read.parquet(path)
    kinds = {"table_name": "string", "row_count": "long", "fingerprint": "string", "release_tag": "string"}
    return held.select(*[(F.col(c) if c in held.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def read_marker(spark: SparkSession, path: str) -> DataFrame:
    """Marker files, one row (``value``) for each whole file."""
    return spark.read.text(path, wholetext=True)


def release_tag(marker: DataFrame) -> DataFrame:
    """The tag of a marker's first ``resolved=`` line that names one, and of several markers the smallest.

    ``value`` holds a whole marker or any part of it with its lines in order, so no order of rows decides.
    """
    tag = F.trim(F.regexp_extract("value", r"(?m)^resolved=[ \t]*([^\s][^\r\n]*)$", 1))
    return marker.select(tag.alias("release_tag")).where("release_tag <> ''").agg(F.min("release_tag").alias("release_tag")).where("release_tag is not null")


def freshness(current: DataFrame, recorded: DataFrame, strict: bool = False) -> DataFrame:
    """Status of each table's recorded manifest row against its current one.

    dataset_missing when the table is gone, missing when nothing was recorded, legacy_format when the
    record has no fingerprint, error when the current one cannot be had, stale when the fingerprints
    (or, if ``strict``, the release tags) differ, else fresh.
    """
    now = current.select(
        "table_name",
        F.lit(True).alias("is_current"),
        F.col("fingerprint").alias("actual"),
        F.col("row_count").alias("actual_rows"),
        F.col("release_tag").alias("actual_tag"),
    )
    then = recorded.select(
        "table_name",
        F.lit(True).alias("is_recorded"),
        F.col("fingerprint").alias("expected"),
        F.col("row_count").alias("expected_rows"),
        F.col("release_tag").alias("expected_tag"),
    )
    differs = F.col("actual") != F.col("expected")
    if strict:
        differs = differs | ~F.col("actual_tag").eqNullSafe(F.col("expected_tag"))
    status = (
        F.when(F.col("is_current").isNull(), DATASET_MISSING)
        .when(F.col("is_recorded").isNull(), MISSING)
        .when(F.col("expected").isNull(), LEGACY)
        .when(F.col("actual").isNull(), ERROR)
        .when(differs, STALE)
        .otherwise(FRESH)
    )
    return now.join(then, "table_name", "full").select(
        "table_name", status.alias("status"), "expected", "actual", "expected_rows", "actual_rows",
        "expected_tag", "actual_tag",
    )


def verify_counts(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """Row counts and releases, recorded against current, with ``matches`` per table."""
    a = current.select("table_name", F.col("row_count").alias("current_rows"), F.col("release_tag").alias("current_tag"))
    b = recorded.select("table_name", F.col("row_count").alias("recorded_rows"), F.col("release_tag").alias("recorded_tag"))
    same = F.col("current_rows").eqNullSafe(F.col("recorded_rows")) & F.col("current_tag").eqNullSafe(F.col("recorded_tag"))
    return a.join(b, "table_name", "full").withColumn("matches", same)


# --- inspection ----------------------------------------------------------------------------------------

# Key and name column of each table of the two layouts.
TABLE_KEYS = {
    "Regions": ("regionId", "name"),
    "Constellations": ("constellationId", "name"),
    "SolarSystems": ("solarSystemId", "name"),
    "Planets": ("planetId", "name"),
    "Moons": ("moonId", "name"),
    "Jumps": ("fromSystemId", "toSystemId"),
    "mapSolarSystems": ("solarSystemID", "solarSystemName"),
    "mapSolarSystemJumps": ("fromSolarSystemID", "toSolarSystemID"),
}


def inspect_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every row's table, key and name in key order, with the layout the tables form."""
    layout = detect_layout(tables).name
    parts = []
    for name, (key, label) in TABLE_KEYS.items():
        df = find_table(tables, name)
        if df is None:
            continue
        has_label = label.lower() in {c.lower() for c in df.columns}
        parts.append(
            df.select(
                F.lit(layout).alias("layout"),
                F.lit(name).alias("table_name"),
                F.col(key).cast("long").alias("key"),
                (F.col(label) if has_label else F.lit(None)).cast("string").alias("name"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("table_name", "key", "name")


def dataset_info(systems: DataFrame, pairs: DataFrame) -> DataFrame:
    """Systems, gate connections, systems with a position and systems with an ambient temperature."""
    counts = systems.agg(
        F.count(F.lit(1)).alias("systems"),
        F.count("x").alias("indexed"),
        F.count("min_external_temp").alias("with_temperature"),
    )
    gates = pairs.agg(F.count(F.lit(1)).alias("gates"))
    rows = counts.select(
        F.explode(
            F.map_from_arrays(
                F.array(F.lit("systems"), F.lit("indexed"), F.lit("with_temperature")),
                F.array("systems", "indexed", "with_temperature"),
            )
        ).alias("item", "value")
    )
    return rows.unionByName(gates.select(F.lit("gates").alias("item"), F.col("gates").alias("value")))


# --- spatial layout ---------------------------------------------------------------------------------------


# Bits of a cell's number along one axis in its place in the Z order, and the number that the middle of the map gets.
_AXIS_BITS = 20
_MIDDLE = 1 << (_AXIS_BITS - 1)


def _spaced(value: Column) -> Column:
    """The bits of a number below 2**_AXIS_BITS, two zeros between any two of them."""
    out = value.cast("long")
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def z_order(cx: Column, cy: Column, cz: Column) -> Column:
    """A cell's place on the Z curve: the bits of its three numbers in turn, so near cells mostly have near places.

    Cells beyond ``_MIDDLE`` of the map's middle share the place of the outermost ones.
    """
    x, y, z = (_spaced(F.least(F.greatest(c + _MIDDLE, F.lit(0)), F.lit(2 * _MIDDLE - 1))) for c in (cx, cy, cz))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def system_cells(systems: DataFrame, cell_size: float) -> DataFrame:
    """Positioned systems keyed by the grid cell that holds them, with the cell's place on the Z curve."""
    cells = systems.where(F.col("x").isNotNull()).select(
        *[cell(F.col(c), cell_size).alias(f"c{c}") for c in "xyz"], "id", "x", "y", "z", "min_external_temp"
    )
    return cells.withColumn("place", z_order(F.col("cx"), F.col("cy"), F.col("cz")))


def write_system_cells(
    cells: DataFrame, path: str, *, fingerprint_text: str, release_tag: str | None = None, slabs: int = 64, group_bytes: int | None = None
) -> None:
    """Write the layout along the Z curve, each row with the provenance of the dataset it came from.

    Rows are spread over files by ranges of the curve and sorted along it, so the rows of a file, and of a row group
    within it, lie in a compact part of the map, and a reader that filters on cells skips the others by their statistics.
    """
    rows = (
        cells.withColumn("source_fingerprint", F.lit(fingerprint_text))
        .withColumn("release_tag", F.lit(release_tag).cast("string"))
        .withColumn("built_at", F.current_timestamp())
        .repartitionByRange(slabs, "place")
        .sortWithinPartitions("place")
    )
    writer = rows.write.mode("errorifexists")
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)


def cells_in_box(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """The layout's rows in a box of cells, both ends included.

    Filters on the plain columns reach the scan. The box lies between the places of its two ends on the curve, which
    cuts the files to a range; the three axes cut the row groups within.
    """
    ends = [z_order(*[F.lit(v) for v in corner]) for corner in (low, high)]
    box = F.col("place").between(*ends)
    for c, a, b in zip(("cx", "cy", "cz"), low, high):
        box = box & F.col(c).between(a, b)
    return cells.where(box)


def read_system_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def lookup(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """Position and temperature of the ids found in the layout."""
    return ids.select("id").join(cells.select("id", "x", "y", "z", "min_external_temp"), "id")


# --- results ----------------------------------------------------------------------------------------------


def route_documents(summary: DataFrame, hops: DataFrame) -> DataFrame:
    """One JSON text per route: its totals and its steps in order, null fields left out.

    A route's steps are gathered into its own document and nothing wider.
    """
    step = F.struct(
        "step", F.col("system_id").alias("id"), "name", "distance", "method", "min_external_temp", "planet_count", "moon_count"
    )
    steps = hops.groupBy("request_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return summary.join(steps, "request_id").select(
        "request_id",
        F.to_json(
            F.struct(
                "request_id", "hops", "total_distance", "jump_distance",
                F.struct(F.col("start_id").alias("id")).alias("start"),
                F.struct(F.col("goal_id").alias("id")).alias("goal"),
                "steps",
            )
        ).alias("document"),
    )


def scout_documents(found: DataFrame) -> DataFrame:
    """One JSON text per scout request; at most the scout limit of systems each."""
    row = F.struct("rank", F.col("system_id").alias("id"), "name", "distance", "min_external_temp", "planet_count", "moon_count")
    return found.groupBy("request_id").agg(
        F.to_json(
            F.struct(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(row)).alias("systems"))
        ).alias("document")
    )
