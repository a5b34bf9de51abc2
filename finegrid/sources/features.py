"""GeoJSON features as rows: a shape is an array of polygons, each its outer ring and its holes, of (x, y) structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finegrid.operators.geometry import with_shape
from finegrid.sources.collection import RANGE, split_collection

_GEOMETRY = "geometry:struct<type:string,coordinates:string>"


def _shape(geometry: Column) -> Column:
    """All rings of a Polygon or MultiPolygon, part by part."""
    one = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    many = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    parts = F.when(geometry["type"] == "Polygon", F.array(one)).when(geometry["type"] == "MultiPolygon", many)
    return F.transform(parts, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def read_features(spark: SparkSession, path: str, properties: str, collection: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """Properties (a DDL field list) and the shape of every feature.

    Features one per line are cut at lines; ``FeatureCollection`` documents (``collection=True``) at ranges of
    ``range_bytes``, whatever their lines, texts and line ends.
    """
    if collection:
        feature = f"struct<type:string,properties:struct<{properties}>,{_GEOMETRY}>"
        rows = split_collection(spark, path, range_bytes).select(F.from_json("value", feature).alias("f")).where("f.type = 'Feature'")
    else:
        rows = spark.read.schema(f"properties struct<{properties}>, geometry struct<type:string,coordinates:string>").json(path)
        rows = rows.select(F.struct("properties", "geometry").alias("f"))
    return rows.select("f.properties.*", _shape(F.col("f.geometry")).alias("shape"))


def feature_lines(df: DataFrame, ring: str, properties: list[str], digits: int = 5, decimals: int = 2) -> DataFrame:
    """One GeoJSON feature per row as text, with chosen properties and rounded coordinates; rings are closed.

    The polygon column may hold a ring, a polygon with holes or several polygons; one polygon is written as Polygon,
    more as MultiPolygon.
    """
    def coordinates(r: Column) -> Column:
        closed = F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
        return F.transform(closed, lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits)))

    df = with_shape(df, ring)
    parts = F.transform(ring, lambda polygon: F.transform(polygon, coordinates))
    types = dict(df.dtypes)
    props = [F.bround(F.col(c), decimals).alias(c) if types[c] in ("double", "float") else F.col(c) for c in properties]
    single = F.size(ring) == 1
    geometry = F.concat(F.lit('{"type":"'), F.when(single, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), F.when(single, F.to_json(parts[0])).otherwise(F.to_json(parts)), F.lit("}"))
    text = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*props), {"ignoreNullFields": "false"}), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))
    return df.select(text.alias("value"))
