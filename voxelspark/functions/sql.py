"""The engine's tables and scalar functions for SQL text: ``register(spark)`` gives a session the views class_map, tissues and palette, and temporary functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .constants import CLASS_TO_LABEL, DENSITY, PALETTE, TISSUES

VIEWS = {
    "class_map": (list(CLASS_TO_LABEL), "cls int, label int"),
    "tissues": (list(TISSUES), "label int, tissue string, imp double, alpha double, mu0 double, mu1 double, sigma0 double"),
    "palette": (list(PALETTE), "label int, red int, green int, blue int, alpha int"),
}
FUNCTIONS = {
    "clamp": "(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN greatest(low, least(high, x))",
    "is_fat": "(tissue INT) RETURNS BOOLEAN RETURN coalesce(tissue IN (1, 2), false)",
    "is_fat_fast": "(tissue INT) RETURNS BOOLEAN RETURN coalesce(tissue IN (1, 2, 3), false)",
    "is_dense": f"(hu INT) RETURNS BOOLEAN RETURN coalesce(hu > {DENSITY[0]} AND hu < {DENSITY[1]}, false)",
    "voxel_label": "(skin BOOLEAN, tissue INT, label INT) RETURNS INT RETURN CASE WHEN skin THEN 12 WHEN tissue IN (1, 2) THEN 3 WHEN coalesce(label, 0) <> 0 THEN label ELSE 9 END",
    "wrapped": "(x INT) RETURNS INT RETURN pmod(x, 256)",
    "at_index": "(xs ARRAY<DOUBLE>, i INT, other DOUBLE) RETURNS DOUBLE RETURN coalesce(get(xs, i), other)",
    "affine_point": "(m ARRAY<ARRAY<DOUBLE>>, x DOUBLE, y DOUBLE, z DOUBLE) RETURNS ARRAY<DOUBLE> RETURN transform(slice(m, 1, 3), r -> r[0] * x + r[1] * y + r[2] * z + r[3])",
}


def register(spark: SparkSession) -> None:
    """Views and functions of this session; earlier ones of these names are replaced."""
    for name, (rows, schema) in VIEWS.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
    for name, text in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
