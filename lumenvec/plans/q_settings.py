"""Settings of as many bundles as there are customers, in both shapes and in several states of repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenvec.operators import settings
from lumenvec.plans.registry import query
from lumenvec.sources.shared import spread

LEGEND = '{"maxVisibleValues":%d,"shapeSize":3.5,"sortMode":"size-desc","hiddenValues":["a"],"enableDuplicateStackUI":true,"categories":{"x":{"zOrder":1,"color":"#fff","shape":"circle"}}%s}'
EXPORT = '{"imageWidth":%d,"imageHeight":2,"lockAspectRatio":true,"legendWidthPercent":20,"legendFontSizePx":12,"includeLegendSettings":true,"includeExportOptions":false}'
BINS = ',"numericSettings":{"strategy":"quantile","signature":"s","more":1}'

#: By c_custkey modulo 8: the text, with the segment and the key put in.
TEXTS = (
    '{"legendSettings":{"%s":' + LEGEND % (7, BINS) + '},"exportOptions":{"e%d":' + EXPORT % 10 + '},"eatConfidenceThreshold":0.5,"eatOverlayEnabled":true,"publishState":{"a":[1]}}',
    '{"%s":' + LEGEND % (8, "") + ',"e%d":' + LEGEND % (9, "") + "}",
    '{"legendSettings":{"%s":' + LEGEND % (7, ',"numericSettings":{"strategy":"odd","signature":"s"}') + ',"bad":{"maxVisibleValues":"7"}},"exportOptions":{"e%d":{"imageWidth":1}},"eatConfidenceThreshold":2}',
    '{"legendSettings":null,"%s":' + LEGEND % (7, "") + ',"e%d":5}',
    "%s %d",
    '["%s", %d]',
    '{"legendSettings":{"%s":' + LEGEND % (7, "") + '},"exportOptions":{"e%d":' + EXPORT % 11 + '},"eatOverlayEnabled":"yes","eatConfidenceThreshold":1}',
)


@query("settings_normalized", """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS s, c_custkey % 8 AS k FROM customer)
SELECT id, CASE WHEN k = 0 THEN 'current' WHEN k = 1 THEN 'legacy' WHEN k IN (2, 3, 6) THEN 'repaired' END AS shape,
  CASE WHEN k = 1 THEN list_sort([s, 'e' || id]) WHEN k IN (0, 2, 3, 6) THEN [s] END AS legends, CASE WHEN k IN (0, 6) THEN ['e' || id] WHEN k IN (1, 2, 3) THEN [] END::VARCHAR[] AS exports,
  CASE WHEN k IN (0, 2, 3, 6) THEN 7 WHEN k = 1 THEN 8 END::BIGINT AS most, CASE WHEN k = 0 THEN 'quantile' END AS strategy, CASE WHEN k IN (0, 1, 2, 3, 6) THEN 'kellys' END AS palette,
  CASE WHEN k = 0 THEN '{"a":[1]}' END AS publish, CASE WHEN k = 0 THEN true END AS overlay, CASE WHEN k = 0 THEN 0.5::DOUBLE WHEN k = 6 THEN 1.0 END AS threshold FROM c""")
def settings_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")), F.col("c_custkey") % 8
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEXTS):
        text = F.when(k == i, F.format_string(t, "c_mktsegment", "c_custkey")).otherwise(text)
    n = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("s"), settings.normalized(text).alias("n"))
    mine = F.try_element_at("n.legend", "s")
    return n.select(
        "id", "n.shape", F.array_sort(F.map_keys("n.legend")).alias("legends"), F.map_keys("n.export").alias("exports"), F.get_json_object(mine, "$.maxVisibleValues").cast("long").alias("most"),
        F.get_json_object(mine, "$.numericSettings.strategy").alias("strategy"), F.get_json_object(mine, "$.selectedPaletteId").alias("palette"), "n.publish", "n.overlay", "n.threshold",
    )
