"""Search inputs derived from a star schema.

The SQL below is plain ANSI and holds ``{table}`` slots, so the same text defines the inputs
for Spark and for the check queries. Every derivation reads whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAR = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# fixed values: the vocabulary the derived inputs are written in
HEADS = [
    "cafe", "Cà phê", "ATM", "atm vcb", "khách sạn", "khachsan", "benh vien", "bv", "cây xăng",
    "nguyen hue", "12 nguyen hue", "10.77", "duong den ben", "tra sua", "gym 24", "caphe",
    "highlands", "vincom", "quan an", "san bay", "ks d", "nha hang", "cf lam viec", "cho",
]
TAILS = [
    "", " gần đây", " đà nẵng", " gan", " wifi", " 24/7", " quận 1", " ha n", " yên tĩnh", " g",
    " khuya", " tp.hcm",
]
POI_CATEGORIES = [
    "Quán cà phê", "ATM", "Khách sạn", "Bệnh viện", "Cây xăng", "Nhà hàng", "Chợ", "Sân bay",
    "Bến xe", "Đại học", "Rạp chiếu phim", "Trung tâm thương mại", "Bãi biển", "Quán bar",
]
POI_BRANDS = [
    "Highlands Coffee", "Vietcombank", "Vincom", "", "Phúc Long", "Mường Thanh", "BIDV", "",
]
POI_CITIES = ["TP.HCM", "Hà Nội", "Đà Nẵng", "Đà Lạt", "Nha Trang"]
POI_STREETS = [
    "Nguyễn Huệ", "Lê Lợi", "Lê Thánh Tôn", "Võ Nguyên Giáp", "Giải Phóng", "Trần Phú",
    "Bạch Đằng", "Hùng Vương", "Hai Bà Trưng",
]
POI_TAGS = [
    "wifi;yên tĩnh;làm việc", "24/7;ngân hàng", "gần biển;hồ bơi", "mở cửa khuya;nhóm",
    "phở;gia đình", "", "du lịch;check-in;view đẹp",
]
PAIR_PREFIXES = [
    "vin", "cafe", "atm", "nguyen hue", "khach san", "benh vien", "cay xang", "nha hang",
    "tra sua", "san bay", "da nang", "gym",
]
PAIR_TEXTS = [
    "Vincom Center", "Quán cà phê gần đây", "ATM Vietcombank gần nhất", "Nguyễn Huệ, Quận 1",
    "Khách sạn Đà Nẵng", "Bệnh viện gần đây", "Cây xăng gần đây", "Nhà hàng chay",
    "Trà sữa ngon", "Sân bay Nội Bài", "Đà Nẵng gần biển", "Phòng gym mở cửa 24/7",
]
INTENT_CYCLE = [
    "Brand Search", "Category Search", "Nearby Search", "POI Search", "Address Suggestion",
    "Discovery Search", "Attribute Search",
]
NATION_ABBREVIATIONS = [
    ("ks", "Khách sạn", "category"), ("bv", "Bệnh viện", "category"),
    ("vcb", "Vietcombank", "brand"), ("q1", "Quận 1", "district"), ("q7", "Quận 7", "district"),
    ("hn", "Hà Nội", "city"), ("dn", "Đà Nẵng", "city"), ("sb", "Sân bay", "category"),
    ("nh", "Nhà hàng", "category"), ("cf", "Cà phê", "category"),
]


def pick(key: str, values: list[str], cast: str = "") -> str:
    """SQL that picks an element of a list by key."""
    quoted = [v.replace("'", "''") for v in values]
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted))
    return f"CASE CAST({key} % {len(values)} AS INT) {arms} END"


INPUT_SQL: dict[str, str] = {
    "pois": f"""
SELECT 'P' || CAST(c_custkey AS VARCHAR(20)) AS poi_id,
       category || CASE WHEN brand = '' THEN '' ELSE ' ' || brand END || ' ' || street || ' '
         || CAST(c_custkey AS VARCHAR(20)) AS poi_name,
       category, brand,
       CAST(1 + c_custkey % 90 AS VARCHAR(20)) || ' ' || street || ', ' || city AS address,
       city,
       8 + CAST((c_custkey * 37) % 1500 AS DOUBLE) / 100 AS latitude,
       102 + CAST((c_custkey * 53) % 700 AS DOUBLE) / 100 AS longitude,
       3 + CAST(c_custkey % 20 AS DOUBLE) / 10 AS rating,
       (c_custkey * 97) % 12000 AS review_count,
       50 + c_custkey % 50 AS popularity_score,
       tags_text, c_custkey AS row_ord
FROM (SELECT c_custkey, {pick('c_custkey', POI_CATEGORIES)} AS category,
             {pick('c_nationkey', POI_BRANDS)} AS brand, {pick('c_custkey', POI_STREETS)} AS street,
             {pick('n_regionkey', POI_CITIES)} AS city, {pick('c_custkey', POI_TAGS)} AS tags_text
      FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey) p""",
    "pairs": f"""
SELECT 'S' || CAST(p_partkey AS VARCHAR(20)) AS suggestion_id,
       {pick('p_partkey', PAIR_PREFIXES)} AS input_prefix,
       {pick('p_partkey', PAIR_TEXTS)} || CASE WHEN p_size < 10 THEN '' ELSE ' ' || p_name END
         AS suggestion_text,
       {pick('p_partkey', INTENT_CYCLE)} AS suggestion_type,
       CAST(86 + p_partkey % 13 AS DOUBLE) / 100 AS score,
       COALESCE(n_lines, 0) * 300 AS query_frequency, p_partkey AS row_ord
FROM {{part}} LEFT JOIN (SELECT l_partkey, COUNT(*) AS n_lines FROM {{lineitem}} GROUP BY l_partkey) l
  ON l_partkey = p_partkey""",
    "requests": f"""
SELECT o_orderkey AS request_id,
       {pick('o_orderkey', HEADS)} || {pick('o_custkey', TAILS)} AS q,
       CASE CAST(o_custkey % 20 AS INT) WHEN 0 THEN 'TP.HCM' WHEN 1 THEN 'Đà Nẵng' WHEN 2 THEN 'hn' END
         AS city,
       CASE WHEN o_custkey % 20 BETWEEN 3 AND 9
            THEN 8 + CAST((o_custkey % 20) * 175 % 1500 AS DOUBLE) / 100 END AS lat,
       CASE WHEN o_custkey % 20 BETWEEN 3 AND 9
            THEN 102 + CAST((o_custkey % 20) * 91 % 700 AS DOUBLE) / 100 END AS lon,
       CASE CAST(o_custkey % 20 AS INT) WHEN 4 THEN '2024-05-01T23:30:00+07:00'
            WHEN 5 THEN '2024-05-01T07:30:00' WHEN 12 THEN '2024-05-01T22:15:00Z' END AS now,
       CAST(o_custkey % 150 AS VARCHAR(20)) AS user_id, o_custkey AS cust
FROM {{orders}}""",
    "popular": f"""
SELECT 'Q' || CAST(row_ord AS VARCHAR(20)) AS query_id, query_text,
       {pick('row_ord', INTENT_CYCLE)} AS intent_type, n * 20 AS monthly_frequency,
       COALESCE(city, 'Hà Nội') AS region, row_ord
FROM (SELECT q AS query_text, COUNT(*) AS n, MIN(city) AS city, MIN(request_id) AS row_ord
      FROM {{requests}} GROUP BY q) g""",
    "abbreviations": f"""
SELECT COALESCE({pick('n_nationkey', [a for a, _, _ in NATION_ABBREVIATIONS] + [''] * 15)}, '')
         || CASE WHEN n_nationkey % 25 < 10 THEN '' ELSE 'n' || CAST(n_nationkey AS VARCHAR(9)) END
         AS abbreviation,
       CASE WHEN n_nationkey % 25 < 10
            THEN {pick('n_nationkey', [e for _, e, _ in NATION_ABBREVIATIONS] + [''] * 15)}
            ELSE n_name END AS expanded_form,
       CASE WHEN n_nationkey % 25 < 10
            THEN {pick('n_nationkey', [t for _, _, t in NATION_ABBREVIATIONS] + [''] * 15)}
            ELSE 'nation' END AS type,
       n_nationkey AS row_ord
FROM {{nation}}""",
    "events": """
SELECT CAST(user_id AS VARCHAR(20)) AS user_id, event_type || ' ' || CAST(user_id % 7 AS VARCHAR(9)) AS query,
       CASE event_type WHEN 'click' THEN 'Highlands Coffee' WHEN 'view' THEN 'Khách sạn'
            WHEN 'purchase' THEN 'ATM' WHEN 'signup' THEN 'wifi' ELSE 'Trần Phú' END AS selected_text,
       CASE event_type WHEN 'click' THEN 'Brand Search' WHEN 'view' THEN 'Category Search'
            ELSE 'POI Search' END AS selected_type,
       CASE event_type WHEN 'click' THEN 'Highlands' WHEN 'purchase' THEN 'Vietcombank' END AS brand,
       CASE event_type WHEN 'view' THEN 'Khách sạn' WHEN 'error' THEN 'Bến xe' END AS category,
       CASE WHEN value < 20 THEN 'TP.HCM' WHEN value < 40 THEN 'Ho Chi Minh' WHEN value < 60 THEN 'Đà Nẵng' END
         AS city,
       ts AS occurred_at, event_id AS ingest_seq, value
FROM {events}""",
}

DEPENDS = {
    "pois": ["customer", "nation"], "pairs": ["part", "lineitem"], "requests": ["orders"],
    "popular": ["requests"], "abbreviations": ["nation"], "events": ["events"],
}
# fixed value: the clock of recency weights, after the last event
NOW = "2024-02-01 00:00:00"


def star_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived input as a lazy DataFrame."""
    sources = {
        dep: star_table(spark, sf_dir, dep) if dep in STAR else search_input(spark, sf_dir, dep)
        for dep in DEPENDS[name]
    }
    df = spark.sql(INPUT_SQL[name].replace("VARCHAR(20)", "STRING").replace("VARCHAR(9)", "STRING"), **sources)
    if name == "pois":
        tags = F.filter(F.split("tags_text", ";"), lambda t: t != "")
        df = df.withColumn("tags", tags).drop("tags_text")
    return df
