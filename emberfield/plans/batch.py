"""The batch flows end to end: raw export to clean cells, enriched cells, ward table and fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.functions.bands import impervious_ratio
from emberfield.operators.columns import align_columns, cast_types, drop_missing_target, nan_to_null, require_columns, with_indices
from emberfield.operators.impute import fill_albedo, fill_mode, impute_grouped_median
from emberfield.operators.spatial import area_density, density_of_length, feature_segments, nearest_join, with_disk_length
from emberfield.operators.wards import hvi, ward_aggregate, ward_join
from emberfield.operators.temporal import hotspot_label, lst_anomaly
from emberfield.scale import as_large, cut_lineage


def clean_cells(raw: DataFrame) -> DataFrame:
    """Align, type, fill albedo, drop rows without target, fill land cover, fill the rest by class medians."""
    # each step looks at its input several times, so the input is written once and not made anew
    aligned = cut_lineage(require_columns(cast_types(align_columns(nan_to_null(raw)))))
    filled = cut_lineage(fill_mode(drop_missing_target(fill_albedo(aligned))))
    return impute_grouped_median(filled)


def add_map_features(
    cells: DataFrame, cell_id: str, roads: DataFrame, buildings: DataFrame, parks: DataFrame, water: DataFrame,
    radius: float = 250.0, x: str = "x_m", y: str = "y_m",
) -> DataFrame:
    """Road and building density, impervious share and the distances to roads, parks and water.

    Layers: feature_id, geom_type, parts in the cells' planar coordinates. Such columns are replaced where the cells
    already have them.
    """
    cells = cells.drop("road_density", "building_density", "impervious_ratio", "dist_road_m", "dist_park_m", "dist_water_m")
    # rows are told apart by a number of their own, so that repeated ids stay apart
    held = cut_lineage(cells.withColumn("_cell_row", F.monotonically_increasing_id()))
    built = area_density(held.select("_cell_row", F.col(x).alias("px"), F.col(y).alias("py")), buildings, "_cell_row", radius)
    # the rows go from step to step; their places are always counted in the kept table
    out = with_disk_length(held, feature_segments(roads), radius, "_length", x, y, counted=held)
    for layer, name in ((roads, "dist_road_m"), (parks, "dist_park_m"), (water, "dist_water_m")):
        out = nearest_join(out, layer, cell_id, name, x, y, counted=held)
    out = out.withColumn("road_density", density_of_length(F.col("_length"), radius))
    out = out.join(as_large(built.withColumnRenamed("area_density", "building_density")), "_cell_row")
    columns = ["road_density", "building_density", "dist_road_m", "dist_park_m", "dist_water_m"]
    return out.select(*cells.columns, *columns).withColumn("impervious_ratio", impervious_ratio("building_density", "road_density"))


def ward_table(cells: DataFrame, wards: DataFrame, cell_id: str, to_plane) -> DataFrame:
    """Indices, ward assignment, hotspot label and anomaly, then the ward aggregate with its vulnerability index."""
    joined = cut_lineage(ward_join(with_indices(cells), wards, cell_id, to_plane))
    labelled = lst_anomaly(hotspot_label(joined, by=None))
    return hvi(cut_lineage(ward_aggregate(labelled, skip=(cell_id,))))
