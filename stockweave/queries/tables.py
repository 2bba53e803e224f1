"""The driver's tables as movements, catalogues and events, in Spark and in SQL.

Both forms follow one mapping: line items are movements, parts are devices, suppliers are
warehouses, regions are countries, and the events table is the event stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Read = Callable[[str], DataFrame]


def _places(read: Read) -> DataFrame:
    region = read("region")
    nation = read("nation")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)
    supplier = read("supplier")
    return supplier.join(named, supplier.s_nationkey == named.n_nationkey).select(
        "s_suppkey", "s_name", "n_name", "r_name"
    )


def _tier(size):
    return (
        F.when(size <= 10, "ENTRY").when(size <= 20, "LOW").when(size <= 30, "MID")
        .when(size <= 40, "HIGH").otherwise("FLAGSHIP")
    )


def _state(key):
    return F.when(key % 10 == 0, "EOL").when(key % 10 == 1, "NEW").otherwise("ACTIVE")


def movements(read: Read) -> DataFrame:
    """Enriched movements: the clean fact's columns."""
    line = read("lineitem")
    part = read("part")
    place = _places(read)
    day = F.col("l_shipdate").cast("date")
    return (
        line.join(place, line.l_suppkey == place.s_suppkey)
        .join(part, line.l_partkey == part.p_partkey)
        .select(
            F.col("r_name").alias("PAIS"),
            day.alias("FECHA"),
            F.year(day).alias("ANIO"),
            F.month(day).alias("MES"),
            F.date_format(day, "yyyy-MM").alias("YEAR_MONTH"),
            F.when(F.col("l_returnflag") == "N", "SALES")
            .when(F.col("l_returnflag") == "A", "INVENTORY").otherwise("TRANSITS").alias("TIPO_TRANSACCION"),
            F.col("l_partkey").cast("string").alias("CODIGO_SKU"),
            F.col("p_type").alias("FAMILIA"),
            F.col("p_name").alias("MODELO"),
            F.col("p_brand").alias("MARCA"),
            _tier(F.col("p_size")).alias("TIER"),
            _state(F.col("p_partkey")).alias("ESTADO"),
            F.col("l_suppkey").cast("string").alias("CODIGO_BODEGA"),
            F.col("s_name").alias("NOMBRE_BODEGA"),
            F.col("l_quantity").alias("VALUE"),
            F.col("l_extendedprice").alias("COSTO"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("PRECIO_UNITARIO"),
        )
    )


def series_grain(mv: DataFrame) -> DataFrame:
    """Movements with the coarse SKU brand/type and one warehouse per country."""
    return mv.withColumns({
        "CODIGO_SKU": F.concat_ws("/", "MARCA", "FAMILIA"),
        "CODIGO_BODEGA": F.col("PAIS"),
        "MODELO": F.col("MARCA"),
    })


def devices(read: Read) -> DataFrame:
    """Device catalogue in raw header spellings: every part in every country."""
    part = read("part")
    countries = read("region").agg(F.collect_list("r_name")).scalar()  # five fixed names
    return part.withColumn("r_name", F.explode(countries)).select(
        F.col("r_name").alias("Country"),
        F.col("p_partkey").cast("string").alias("COD SKU"),
        F.col("p_type").alias("Family"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")).alias("Model Name"),
        F.lower("p_brand").alias("Brand"),
        _tier(F.col("p_size")).alias("Tier"),
        _state(F.col("p_partkey")).alias("Status"),
    )


def warehouses(read: Read) -> DataFrame:
    """Warehouse catalogue in raw header spellings; its country is the source country."""
    return _places(read).select(
        F.col("r_name").alias("SOURCE_COUNTRY"),
        F.col("s_suppkey").cast("string").alias("cod_bodega"),
        F.col("s_name").alias("nombre bodega"),
        F.col("n_name").alias("Ubicacion"),
        F.col("r_name").alias("tipo_bodega"),
    )


def raw_movements(read: Read) -> DataFrame:
    """Movements as they arrive: text columns, bad values, unknown types, copies."""
    line = read("lineitem")
    base = line.join(_places(read), F.col("l_suppkey") == F.col("s_suppkey"))
    money = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    units = F.col("l_quantity").cast("bigint").cast("string")
    day = F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd")
    tax = F.col("l_tax").cast("decimal(4,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    raw = base.select(
        F.when(tax == 0.08, F.lit(None)).when(tax == 0.07, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")))
        .when(tax == 0.06, "nan").otherwise(F.col("r_name")).alias("PAIS"),
        F.when(discount == 0.10, F.concat(F.substring(day, 1, 4), F.lit("1399")))
        .when(discount == 0.09, "sin fecha").otherwise(day).alias("FECHA_VENTA_INVENTARIO"),
        F.when(F.col("l_returnflag") == "N", "Sales").when(F.col("l_returnflag") == "A", " inventory ")
        .when(F.col("l_linestatus") == "O", "TRANSITS").otherwise("Service   Level").alias("TIPO_TRANSACCION"),
        F.col("l_partkey").cast("string").alias("CODIGO_SKU"),
        F.col("l_suppkey").cast("string").alias("CODIGO_BODEGA"),
        F.when(units == "50", "0").when(units == "49", "n/a").otherwise(units).alias("VALUE"),
        money.alias("COSTO"),
        F.concat(F.lit("Datos_"), F.col("l_linenumber").cast("string"), F.lit(".csv")).alias("SOURCE_FILE"),
        F.col("r_name").alias("SOURCE_COUNTRY"),
        F.col("l_linenumber").alias("_line"),
    )
    again = raw.filter(F.col("_line") == 1).withColumn("SOURCE_FILE", F.lit("Copia.csv"))
    return raw.unionByName(again).drop("_line")


def events(read: Read) -> DataFrame:
    """Purchases are sales, sign-ups are stock snapshots; whole units of at least 1."""
    e = read("events").filter(F.col("event_type").isin("purchase", "signup"))
    user = F.col("user_id")
    return e.select(
        F.col("event_id").cast("string").alias("evento_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "purchase", "SALES").otherwise("INVENTORY").alias("tipo_evento"),
        F.concat(F.lit("R"), (user % 5).cast("string")).alias("pais"),
        user.cast("string").alias("codigo_sku"),
        F.concat(F.lit("F"), (user % 2).cast("string")).alias("familia"),
        F.concat(F.lit("MOD-"), (user % 9).cast("string")).alias("modelo"),
        F.concat(F.lit("M"), (user % 4).cast("string")).alias("marca"),
        F.concat(F.lit("T"), (user % 3).cast("string")).alias("tier"),
        F.when(user % 10 == 0, "EOL").otherwise("ACTIVE").alias("estado"),
        F.from_json("props", "k int")["k"].cast("string").alias("codigo_bodega"),
        F.col("value").cast("bigint").alias("value"),
        (F.lit(10.0) + F.col("event_id") % 7).alias("precio_unitario"),
    ).filter(F.col("value") >= 1)


BASE_SQL = """
place AS (
  SELECT s_suppkey, s_name, n_name, r_name FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
mv AS (
  SELECT r_name AS PAIS, CAST(l_shipdate AS DATE) AS FECHA,
    CAST(year(l_shipdate) AS BIGINT) AS ANIO, CAST(month(l_shipdate) AS BIGINT) AS MES,
    strftime(CAST(l_shipdate AS DATE), '%Y-%m') AS YEAR_MONTH,
    CASE l_returnflag WHEN 'N' THEN 'SALES' WHEN 'A' THEN 'INVENTORY' ELSE 'TRANSITS' END AS TIPO_TRANSACCION,
    CAST(l_partkey AS VARCHAR) AS CODIGO_SKU, p_type AS FAMILIA, p_name AS MODELO, p_brand AS MARCA,
    CASE WHEN p_size <= 10 THEN 'ENTRY' WHEN p_size <= 20 THEN 'LOW' WHEN p_size <= 30 THEN 'MID'
         WHEN p_size <= 40 THEN 'HIGH' ELSE 'FLAGSHIP' END AS TIER,
    CASE p_partkey % 10 WHEN 0 THEN 'EOL' WHEN 1 THEN 'NEW' ELSE 'ACTIVE' END AS ESTADO,
    CAST(l_suppkey AS VARCHAR) AS CODIGO_BODEGA, s_name AS NOMBRE_BODEGA,
    l_quantity AS VALUE, l_extendedprice AS COSTO, l_extendedprice / l_quantity AS PRECIO_UNITARIO
  FROM lineitem JOIN place ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
),
sales AS (
  SELECT *, VALUE * PRECIO_UNITARIO AS INGRESO_TOTAL,
    CAST(VALUE * PRECIO_UNITARIO AS DECIMAL(20,4)) AS R FROM mv WHERE TIPO_TRANSACCION = 'SALES'
),
inv AS (SELECT * FROM mv WHERE TIPO_TRANSACCION = 'INVENTORY'),
ser AS (SELECT * REPLACE (MARCA || '/' || FAMILIA AS CODIGO_SKU, PAIS AS CODIGO_BODEGA, MARCA AS MODELO) FROM mv),
dev AS (
  SELECT r_name AS PAIS, CAST(p_partkey AS VARCHAR) AS CODIGO_SKU, upper(p_type) AS FAMILIA,
    upper(trim(p_name)) AS MODELO, upper(p_brand) AS MARCA,
    CASE WHEN p_size <= 10 THEN 'ENTRY' WHEN p_size <= 20 THEN 'LOW' WHEN p_size <= 30 THEN 'MID'
         WHEN p_size <= 40 THEN 'HIGH' ELSE 'FLAGSHIP' END AS TIER,
    CASE p_partkey % 10 WHEN 0 THEN 'EOL' WHEN 1 THEN 'NEW' ELSE 'ACTIVE' END AS ESTADO
  FROM part CROSS JOIN region
),
bod AS (
  SELECT r_name AS PAIS, CAST(s_suppkey AS VARCHAR) AS CODIGO_BODEGA, upper(s_name) AS NOMBRE_BODEGA,
    upper(n_name) AS UBICACION, upper(r_name) AS TIPO_BODEGA FROM place
),
raw0 AS (
  SELECT CASE WHEN CAST(l_tax AS DECIMAL(4,2)) = 0.08 THEN NULL
              WHEN CAST(l_tax AS DECIMAL(4,2)) = 0.07 THEN '  ' || lower(r_name) || ' '
              WHEN CAST(l_tax AS DECIMAL(4,2)) = 0.06 THEN 'nan' ELSE r_name END AS PAIS,
    CASE WHEN CAST(l_discount AS DECIMAL(4,2)) = 0.10 THEN strftime(l_shipdate, '%Y') || '1399'
         WHEN CAST(l_discount AS DECIMAL(4,2)) = 0.09 THEN 'sin fecha'
         ELSE strftime(l_shipdate, '%Y%m%d') END AS FECHA_VENTA_INVENTARIO,
    CASE WHEN l_returnflag = 'N' THEN 'Sales' WHEN l_returnflag = 'A' THEN ' inventory '
         WHEN l_linestatus = 'O' THEN 'TRANSITS' ELSE 'Service   Level' END AS TIPO_TRANSACCION,
    CAST(l_partkey AS VARCHAR) AS CODIGO_SKU, CAST(l_suppkey AS VARCHAR) AS CODIGO_BODEGA,
    CASE CAST(l_quantity AS BIGINT) WHEN 50 THEN '0' WHEN 49 THEN 'n/a'
         ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS VALUE,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS COSTO,
    'Datos_' || CAST(l_linenumber AS VARCHAR) || '.csv' AS SOURCE_FILE, r_name AS SOURCE_COUNTRY, l_linenumber
  FROM lineitem JOIN place ON l_suppkey = s_suppkey
),
rawmv AS (
  SELECT * EXCLUDE (l_linenumber) FROM raw0
  UNION ALL
  SELECT * EXCLUDE (l_linenumber) REPLACE ('Copia.csv' AS SOURCE_FILE) FROM raw0 WHERE l_linenumber = 1
),
typed0 AS (
  SELECT upper(trim(regexp_replace(PAIS, '\\s+', ' ', 'g'))) AS P,
    upper(trim(regexp_replace(TIPO_TRANSACCION, '\\s+', ' ', 'g'))) AS TIPO_TRANSACCION,
    CODIGO_SKU, CODIGO_BODEGA, TRY_CAST(VALUE AS DOUBLE) AS VALUE, TRY_CAST(COSTO AS DOUBLE) AS COSTO,
    TRY_CAST(FECHA_VENTA_INVENTARIO AS DOUBLE) AS FECHA_VENTA_INVENTARIO,
    upper(SOURCE_FILE) AS SOURCE_FILE, upper(SOURCE_COUNTRY) AS SOURCE_COUNTRY FROM rawmv
),
typed AS (
  SELECT coalesce(CASE WHEN P IN ('<NA>', 'NAN', 'NONE', '') THEN NULL ELSE P END, SOURCE_COUNTRY) AS PAIS,
    * EXCLUDE (P) FROM typed0
),
priced AS (
  SELECT *, COSTO / VALUE AS PRECIO_UNITARIO,
    CAST(try_strptime(CAST(CAST(FECHA_VENTA_INVENTARIO AS BIGINT) AS VARCHAR), '%Y%m%d') AS DATE) AS FECHA
  FROM typed
  WHERE TIPO_TRANSACCION IN ('SALES', 'INVENTORY', 'TRANSITS') AND PAIS IS NOT NULL AND CODIGO_SKU IS NOT NULL
    AND CODIGO_BODEGA IS NOT NULL AND FECHA_VENTA_INVENTARIO IS NOT NULL AND VALUE > 0 AND COSTO > 0
),
dated AS (
  SELECT * FROM priced WHERE PRECIO_UNITARIO > 1.0 AND FECHA >= DATE '1996-01-01' AND FECHA < DATE '2001-07-01'
),
clean AS (
  SELECT PAIS, FECHA_VENTA_INVENTARIO, TIPO_TRANSACCION, CODIGO_SKU, CODIGO_BODEGA, VALUE, COSTO,
    min(SOURCE_FILE) AS SOURCE_FILE, first(SOURCE_COUNTRY ORDER BY SOURCE_FILE, SOURCE_COUNTRY) AS SOURCE_COUNTRY,
    min(PRECIO_UNITARIO) AS PRECIO_UNITARIO, min(FECHA) AS FECHA
  FROM dated GROUP BY ALL
),
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS evento_id, event_id AS seq, ts,
    CASE event_type WHEN 'purchase' THEN 'SALES' ELSE 'INVENTORY' END AS tipo_evento,
    'R' || CAST(user_id % 5 AS VARCHAR) AS pais, CAST(user_id AS VARCHAR) AS codigo_sku,
    'F' || CAST(user_id % 2 AS VARCHAR) AS familia, 'MOD-' || CAST(user_id % 9 AS VARCHAR) AS modelo,
    'M' || CAST(user_id % 4 AS VARCHAR) AS marca, 'T' || CAST(user_id % 3 AS VARCHAR) AS tier,
    CASE WHEN user_id % 10 = 0 THEN 'EOL' ELSE 'ACTIVE' END AS estado,
    CAST(json_extract(props, '$.k') AS VARCHAR) AS codigo_bodega,
    CAST(trunc(value) AS BIGINT) AS value, 10.0 + event_id % 7 AS precio_unitario
  FROM events WHERE event_type IN ('purchase', 'signup') AND trunc(value) >= 1
)"""
