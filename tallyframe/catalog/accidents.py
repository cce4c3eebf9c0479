"""The line items seen as a table of accidents, so that the presets run on the given tables.

All columns come from columns of ``lineitem``; nothing is made up but the naming. Some codes are -1 and some
times are null, as in the table the presets were made for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.catalog import table

_SHARED = """
    l_orderkey AS Accident_Index,
    CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 3 END AS Accident_Severity,
    CASE WHEN l_discount = 0 THEN NULL
         ELSE lpad(CAST(CAST(l_quantity AS INT) % 24 AS STRING), 2, '0') || ':' ||
              lpad(CAST(l_linenumber * 7 AS STRING), 2, '0') END AS Time,
    year(l_shipdate) AS Year,
    CASE WHEN l_tax = 0 THEN -1 ELSE CAST(l_partkey % 3 AS INT) + 1 END AS Urban_or_Rural_Area,
    CASE WHEN l_quantity < 5 THEN -1 ELSE CAST(floor(l_quantity / 10) AS INT) * 10 + 20 END AS Speed_limit,
    CASE WHEN l_tax = 0 THEN -1.0D ELSE l_quantity / 8 - 5 END AS Longitude,
    l_extendedprice / 10000 + 50 AS Latitude,
    CAST(floor(l_quantity / 15) AS INT) + 1 AS Number_of_Vehicles,
    CASE WHEN l_quantity > 40 THEN 2 ELSE 1 END AS Number_of_Casualties,
    CAST(l_suppkey % 10 AS STRING) AS Police_Force,
    CAST(l_suppkey AS STRING) AS `Local_Authority_(District)`,
    CAST(l_partkey % 5 AS STRING) AS `1st_Road_Class`,
    CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '2' ELSE '6' END AS Road_Type,
    CASE WHEN l_tax = 0 THEN '-1' ELSE CAST(l_linenumber % 4 + 1 AS STRING) END AS Light_Conditions,
    CASE WHEN l_discount = 0 THEN '-1' ELSE CAST(CAST(round(l_discount * 100) AS INT) AS STRING) END
        AS Weather_Conditions,
    CASE l_linestatus WHEN 'O' THEN '1' ELSE '2' END AS Road_Surface_Conditions,
    '0' AS Carriageway_Hazards,
    CASE WHEN l_quantity < 25 THEN 'Yes' ELSE 'No' END AS Did_Police_Officer_Attend_Scene_of_Accident
"""

_SPARK = f"""
SELECT date_format(l_shipdate, ' dd/MM/yyyy ') AS Date, dayofweek(l_shipdate) AS Day_of_Week, {_SHARED}
FROM {{lineitem}}
"""

_DUCKDB = (
    _SHARED.replace("AS STRING", "AS VARCHAR").replace("-1.0D", "-1.0::DOUBLE").replace("`", '"')
)

#: Common table expression for the SQL side.
CTE = f"""
accidents AS (
SELECT strftime(l_shipdate, ' %d/%m/%Y ') AS Date, CAST(dayofweek(l_shipdate) + 1 AS INT) AS Day_of_Week, {_DUCKDB}
FROM lineitem),
labelled AS (
SELECT *, CAST(strptime(trim(Date), '%d/%m/%Y') AS DATE) AS Accident_Date,
  CAST(split_part(Time, ':', 1) AS BIGINT) AS Hour,
  month(strptime(trim(Date), '%d/%m/%Y')) AS Month,
  CASE Accident_Severity WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Serious' ELSE 'Slight' END AS Severity_Label,
  CASE Urban_or_Rural_Area WHEN 1 THEN 'Urban' WHEN 2 THEN 'Rural' ELSE 'Other' END AS Area_Label,
  CASE Day_of_Week WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday' WHEN 4 THEN 'Wednesday'
    WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' ELSE 'Saturday' END AS Day_Name
FROM accidents)
"""


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK, lineitem=table(spark, sf_dir, "lineitem")).withColumn("Year", F.col("Year").cast("int"))
