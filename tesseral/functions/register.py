"""The codec's scalars and the time cover as SQL functions of a session.

They are SQL-bodied, so Spark inlines them into the plan: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BODIES = (
    ("tess_x_tile(lng DOUBLE, z INT) RETURNS BIGINT", "RETURN least(cast((((lng + 180D) % 360D + CASE WHEN (lng + 180D) % 360D < 0 THEN 360D ELSE 0D END - 180D) + 180D) / 360D * shiftleft(1L, z) AS BIGINT), shiftleft(1L, z) - 1)"),
    (
        "tess_y_tile(lat DOUBLE, z INT) RETURNS BIGINT",
        "RETURN least(greatest(cast((1D - ln(tan(radians(greatest(-85.05112877980659D, least(85.05112877980659D, lat)))) + 1D / cos(radians(greatest(-85.05112877980659D, least(85.05112877980659D, lat))))) / pi()) / 2D * shiftleft(1L, z) AS BIGINT), 0L), shiftleft(1L, z) - 1)",
    ),
    ("tess_f_tile(h DOUBLE, z INT) RETURNS BIGINT", "RETURN shiftright(cast((h + 16383D) / 32767D * 4294967295D AS BIGINT), 32 - z)"),
    ("tess_t_tile(t BIGINT, z INT) RETURNS BIGINT", "RETURN shiftright(t, 32 - z)"),
    ("tess_prefix_bits(v BIGINT, z INT) RETURNS STRING", "RETURN CASE WHEN z > 0 THEN lpad(bin(v), z, '0') ELSE '' END"),
    ("tess_compatible(va BIGINT, za INT, vb BIGINT, zb INT) RETURNS BOOLEAN", "RETURN shiftright(va, za - least(za, zb)) = shiftright(vb, zb - least(za, zb))"),
    ("tess_subsumes(vc BIGINT, zc INT, vd BIGINT, zd INT) RETURNS BOOLEAN", "RETURN zc <= zd AND vc = shiftright(vd, zd - least(zc, zd))"),
    ("tess_time_block(zt INT) RETURNS BIGINT", "RETURN shiftleft(1L, 32 - zt)"),
    (
        "tess_time_cover(s BIGINT, e BIGINT) RETURNS TABLE(zt INT, vt BIGINT)",
        """RETURN SELECT 32 - k, v FROM (
          SELECT k, explode(array_distinct(array_compact(array(
            CASE WHEN l % 2 = 1 OR (k = 31 AND l = 0) THEN l END, CASE WHEN r % 2 = 1 OR (k = 31 AND r = 2) THEN r - 1 END)))) AS v FROM (
              SELECT k, shiftright(s + shiftleft(1L, k) - 1, k) AS l, shiftright(e, k) AS r FROM (SELECT explode(sequence(0, 31)) AS k)) WHERE l < r)""",
    ),
    (
        "tess_refine(v BIGINT, z INT) RETURNS TABLE(zoom INT, value BIGINT)",
        "RETURN SELECT z + 1, v * 2 + b FROM (SELECT explode(array(0L, 1L)) AS b)",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary functions; returns their names."""
    names = []
    for head, body in _BODIES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} {body}")
        names.append(head.split("(")[0])
    return names
