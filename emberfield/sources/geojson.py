"""GeoJSON in and out. Geometries become nested arrays; nothing but JSON functions is needed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfield import schema as S
from emberfield.functions.geometry import normalise_rings
from emberfield.operators.columns import pick_column
from emberfield.scale import cut_lineage, number_rows

_NUM1 = "array<double>"
_NUM2 = f"array<{_NUM1}>"
_NUM3 = f"array<{_NUM2}>"
_NUM4 = f"array<{_NUM3}>"


def _points(coords: Column) -> Column:
    return F.transform(coords, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))


def _parts(kind: Column, coords: Column) -> Column:
    """Coordinates text of any geometry type to one array of parts; polygon rings are wound consistently."""
    point = F.array(F.array(F.from_json(coords, _NUM1)))
    multi_point = F.transform(F.from_json(coords, _NUM2), lambda p: F.array(p))
    line = F.array(F.from_json(coords, _NUM2))
    multi_line = F.from_json(coords, _NUM3)
    polygon = F.array(F.from_json(coords, _NUM3))
    multi_polygon = F.from_json(coords, _NUM4)
    rings = lambda polys: normalise_rings(F.transform(polys, lambda rs: F.transform(rs, _points)))
    lines = lambda ls: F.transform(ls, _points)
    return (
        F.when(kind == "Point", lines(point))
        .when(kind == "MultiPoint", lines(multi_point))
        .when(kind == "LineString", lines(line))
        .when(kind == "MultiLineString", lines(multi_line))
        .when(kind == "Polygon", rings(polygon))
        .when(kind == "MultiPolygon", rings(multi_polygon))
    )


def parse_features(texts: DataFrame, text: str = "value") -> DataFrame:
    """GeoJSON documents (FeatureCollections or single Features) to rows: properties, geom_type, parts.

    Features without geometry are dropped.
    """
    doc = F.get_json_object(text, "$.features")
    listed = F.from_json(F.coalesce(doc, F.concat(F.lit("["), F.col(text), F.lit("]"))), "array<string>")
    feature = texts.select(F.explode(listed).alias("_f"))
    fields = feature.select(
        F.from_json(F.get_json_object("_f", "$.properties"), "map<string,string>").alias("properties"),
        F.get_json_object("_f", "$.geometry.type").alias("geom_type"),
        F.get_json_object("_f", "$.geometry.coordinates").alias("_c"),
    )
    out = fields.withColumn("parts", _parts(F.col("geom_type"), F.col("_c"))).drop("_c")
    return out.filter(F.col("geom_type").isNotNull() & (F.size(F.flatten("parts")) > 0))


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``lines``: one Feature per line (splittable, for large layers); otherwise one document per file."""
    return parse_features(spark.read.text(path) if lines else spark.read.text(path, wholetext=True))


def wards_from_features(features: DataFrame) -> DataFrame:
    """Ward polygons: id and name taken from the candidate property names, else 1..N and the id as name.

    Output: ward_ord (1..N in file order), ward_id, ward_name (strings), rings.
    """
    polys = cut_lineage(
        features.filter(F.col("geom_type").isin("Polygon", "MultiPolygon"))
        .withColumns({"_all": F.lit(0), "_order": F.monotonically_increasing_id()})
    )
    # of all keys only spellings of the candidates are listed
    wanted = sorted({c.lower() for c in [*S.WARD_ID_CANDIDATES, *S.WARD_NAME_CANDIDATES]})
    spelled = polys.select(F.explode(F.map_keys("properties")).alias("k")).filter(F.lower("k").isin(wanted)).distinct()
    keys = sorted(r[0] for r in spelled.collect())
    id_key, name_key = pick_column(keys, S.WARD_ID_CANDIDATES), pick_column(keys, S.WARD_NAME_CANDIDATES)
    numbered = number_rows(polys, ["_all"], ["_order"], "ward_ord")
    wid = F.try_element_at("properties", F.lit(id_key)) if id_key else F.col("ward_ord").cast("string")
    out = numbered.withColumn("ward_id", wid)
    name = F.try_element_at("properties", F.lit(name_key)) if name_key else F.col("ward_id")
    return out.select("ward_ord", "ward_id", name.alias("ward_name"), F.col("parts").alias("rings"))


def read_wards_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return wards_from_features(read_features(spark, path, lines))


# Geometry types kept per layer.
LAYER_TYPES = {"roads": ["LineString", "MultiLineString"], "buildings": ["Polygon", "MultiPolygon"]}


def layer_from_features(features: DataFrame, layer: str) -> DataFrame:
    """Features of one layer with the geometry types that layer keeps, in the common feature schema."""
    kinds = LAYER_TYPES.get(layer)
    kept = features if kinds is None else features.filter(F.col("geom_type").isin(kinds))
    return kept.select(
        F.lit(layer).alias("layer"), F.monotonically_increasing_id().alias("feature_id"), "geom_type",
        F.col("properties").alias("tags"), "parts",
    )


def read_feature_layer(spark: SparkSession, path: str, layer: str, lines: bool = False) -> DataFrame:
    return layer_from_features(read_features(spark, path, lines), layer)


def filter_tags(features: DataFrame, tags: Mapping[str, object], col: str = "tags") -> DataFrame:
    """Features having any of the tags: True asks for the key, a list for one of its values."""
    hit = F.lit(False)
    for key, want in tags.items():
        value = F.try_element_at(F.col(col), F.lit(key))
        wanted = [want] if isinstance(want, str) else want
        hit = hit | F.coalesce(value.isNotNull() if want is True else value.isin(*wanted), F.lit(False))
    return features.filter(hit)


# Features in one part file of a document.
FILE_ROWS = 100_000


def feature_json(df: DataFrame, rings: str = "rings", properties: list[str] | None = None) -> Column:
    """One GeoJSON Feature per row, as text."""
    props = properties or [c for c in df.columns if c != rings]
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p.x, p.y)))
    return F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*props).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )


def feature_lines(df: DataFrame, rings: str = "rings", properties: list[str] | None = None) -> DataFrame:
    return df.select(feature_json(df, rings, properties).alias("value"))


def write_geojson(df: DataFrame, path: str, rings: str = "rings", properties: list[str] | None = None, collection: bool = False, file_rows: int = FILE_ROWS) -> None:
    """Feature-per-line text files; with ``collection`` one FeatureCollection document of any length.

    A document is written by many tasks: its features are numbered, ranges of ``file_rows`` of them go to one part file
    each, the first row opens and the last one closes the document. The parts, one after the other, are the document; up
    to ``file_rows`` features it is one file.
    """
    lines = feature_lines(df, rings, properties)
    if collection:
        opening, closing = '{"type":"FeatureCollection","features":[', "]}"
        ordered = cut_lineage(number_rows(lines.withColumns({"_all": F.lit(0), "_order": F.monotonically_increasing_id()}), ["_all"], ["_order"]))
        n = ordered.count()
        before = F.when(F.col("_rn") == 1, opening).otherwise(",")
        after = F.when(F.col("_rn") == n, closing).otherwise("")
        whole = ordered.select("_rn", F.concat(before, "value", after).alias("value"))
        if not n:
            whole = df.sparkSession.createDataFrame([(1, opening + closing)], "_rn long, value string")
        # consecutive numbers fall into the part files in order
        parts = max(1, -(-n // file_rows))
        part = F.least(F.floor((F.col("_rn") - 1) / F.lit(file_rows)), F.lit(parts - 1))
        spread = whole.repartition(1) if parts == 1 else whole.withColumn("_part", part).repartitionByRange(parts, "_part")
        lines = spread.sortWithinPartitions("_rn").select("value")
    lines.write.mode("overwrite").text(path)
