"""Schemas of the three tables and the dictionaries that operators join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ENTITIES = "id long, label string, label_en string, entity_type string, source string, release_year int, qid string, is_dormant int, lat double, lon double"
ENTITY_TAGS = "entity_id long, axis string, value_code string, confidence double"
CONNECTIONS = "a_id long, b_id long, connection_type string, score double, verdict string, source string"

AXES = ("theme", "medium", "era", "geography", "experience")

# Nine eras with their year bounds [from, to).
ERAS = [
    ("ancient", -10000, 1185),
    ("medieval", 1185, 1573),
    ("edo_early", 1573, 1700),
    ("edo_late", 1700, 1868),
    ("meiji_taisho", 1868, 1926),
    ("showa_prewar", 1926, 1945),
    ("showa_postwar", 1945, 1989),
    ("heisei", 1989, 2019),
    ("reiwa", 2019, 2100),
]

# Regions with centre and radius in km.
REGIONS = [
    ("hokkaido", 43.0642, 141.3469, 200),
    ("tohoku", 39.7, 140.1, 150),
    ("kanto", 35.7, 139.7, 100),
    ("chubu", 36.2, 137.9, 150),
    ("kinki", 34.7, 135.5, 100),
    ("chugoku", 34.4, 132.5, 120),
    ("shikoku", 33.8, 133.5, 80),
    ("kyushu", 33.0, 131.0, 150),
    ("okinawa", 26.3344, 127.8056, 100),
    ("tokyo", 35.6762, 139.6503, 30),
    ("kyoto", 35.0116, 135.7681, 30),
    ("osaka", 34.6937, 135.5023, 25),
    ("nara", 34.6851, 135.8049, 25),
]

# Prefectures with centre and radius in km.
PREFECTURES = [
    ("hokkaido", 43.0642, 141.3469, 120),
    ("aomori", 40.8244, 140.7400, 50),
    ("iwate", 39.7036, 141.1527, 60),
    ("miyagi", 38.2688, 140.8721, 40),
    ("akita", 39.7186, 140.1024, 50),
    ("yamagata", 38.2404, 140.3633, 40),
    ("fukushima", 37.7500, 140.4678, 50),
    ("ibaraki", 36.3419, 140.4468, 35),
    ("tochigi", 36.5658, 139.8836, 35),
    ("gunma", 36.3912, 139.0608, 35),
    ("saitama", 35.8569, 139.6489, 25),
    ("chiba", 35.6047, 140.1233, 30),
    ("tokyo", 35.6762, 139.6503, 25),
    ("kanagawa", 35.4478, 139.6425, 20),
    ("niigata", 37.9026, 139.0236, 55),
    ("toyama", 36.6953, 137.2114, 30),
    ("ishikawa", 36.5946, 136.6256, 35),
    ("fukui", 35.8562, 136.2258, 30),
    ("yamanashi", 35.6642, 138.5684, 25),
    ("nagano", 36.2378, 138.1813, 45),
    ("gifu", 35.3912, 136.7223, 35),
    ("shizuoka", 34.9769, 138.3831, 40),
    ("aichi", 35.1802, 136.9066, 30),
    ("mie", 34.7303, 136.5086, 40),
    ("shiga", 35.0045, 135.8686, 25),
    ("kyoto", 35.0116, 135.7681, 30),
    ("osaka", 34.6937, 135.5023, 20),
    ("hyogo", 34.6913, 135.1830, 35),
    ("nara", 34.6851, 135.8049, 20),
    ("wakayama", 33.9499, 135.3748, 30),
    ("tottori", 35.5039, 134.2383, 30),
    ("shimane", 35.4723, 133.0505, 40),
    ("okayama", 34.6618, 133.9345, 30),
    ("hiroshima", 34.3966, 132.4596, 35),
    ("yamaguchi", 34.1861, 131.4714, 35),
    ("tokushima", 34.0658, 134.5593, 25),
    ("kagawa", 34.3401, 134.0434, 20),
    ("ehime", 33.8417, 132.7661, 30),
    ("kochi", 33.5597, 133.5311, 35),
    ("fukuoka", 33.6064, 130.4183, 30),
    ("saga", 33.2494, 130.2988, 20),
    ("nagasaki", 32.7503, 129.8779, 30),
    ("kumamoto", 32.7898, 130.7418, 30),
    ("oita", 33.2382, 131.6126, 30),
    ("miyazaki", 31.9111, 131.4239, 35),
    ("kagoshima", 31.5602, 130.5581, 40),
    ("okinawa", 26.3344, 127.8056, 60),
]


# Categories of a region's assets, with their entity types and label patterns; no types: any end of a pilgrimage edge.
ASSETS = [
    ("shrine", ("place",), ("%神社%", "%大社%", "%八幡%")),
    ("temple", ("place",), ("%寺%", "%院%")),
    ("place", ("place",), ()),
    ("artifact", ("artifact",), ()),
    ("building", ("building",), ()),
    ("food", ("food",), ()),
    ("festival", ("festival", "event"), ()),
    ("tradition", ("tradition", "cultural_practice"), ()),
    ("pilgrimage", None, ()),
]

# Kinds of neighbours by connection type; any other type is "other".
NEIGHBOUR_KINDS = [
    ("people", ("creator_work", "influence", "adaptation")),
    ("works", ("same_theme", "shared_genre", "medium_cross", "thematic_resonance")),
    ("places", ("pilgrimage_same_location", "pilgrimage_landmark", "pilgrimage_proximity", "pilgrimage_regional", "pilgrimage_filming", "geographic_cultural", "heritage_location")),
    ("themes", ("cultural_echo", "era_bridge", "temporal_echo", "shared_motif")),
]

# The calendar, by month: events with their type.
CALENDAR = {
    1: [("正月", "event"), ("成人の日", "event"), ("七草粥", "food")],
    2: [("節分", "event"), ("札幌雪まつり", "festival"), ("梅の花見", "event")],
    3: [("ひな祭り", "event"), ("お水取り", "event"), ("桜の開花", "event")],
    4: [("花見", "event"), ("高山祭", "festival")],
    5: [("端午の節句", "event"), ("三社祭", "festival"), ("葵祭", "festival")],
    6: [("梅雨入り", "event"), ("YOSAKOIソーラン祭り", "festival")],
    7: [("七夕", "event"), ("祇園祭", "festival"), ("隅田川花火大会", "festival")],
    8: [("お盆", "event"), ("阿波おどり", "festival"), ("ねぶた祭", "festival"), ("コミックマーケット", "event")],
    9: [("お月見", "event"), ("岸和田だんじり祭", "festival")],
    10: [("紅葉狩り", "event"), ("時代祭", "festival"), ("秋祭り", "event")],
    11: [("七五三", "event"), ("紅葉の見頃", "event"), ("酉の市", "event")],
    12: [("冬至", "event"), ("除夜の鐘", "event"), ("忠臣蔵", "event"), ("年越しそば", "food")],
}
# Words of each month that festivals are looked up by.
MONTH_WORDS = {
    1: ("一月", "正月"),
    2: ("二月", "節分"),
    3: ("三月", "ひな祭り", "桃"),
    4: ("四月", "花見", "桜"),
    5: ("五月", "端午"),
    6: ("六月", "梅雨"),
    7: ("七月", "七夕"),
    8: ("八月", "お盆", "盆踊り"),
    9: ("九月", "月見"),
    10: ("十月", "紅葉"),
    11: ("十一月", "七五三"),
    12: ("十二月", "年末"),
}
# Words of each month that seasonal things are looked up by.
SEASON_WORDS = {
    1: ("初詣", "おせち"),
    2: ("豆まき", "梅"),
    3: ("雛人形", "桃の花"),
    4: ("桜", "花見"),
    5: ("鯉のぼり", "菖蒲"),
    6: ("紫陽花", "蛍"),
    7: ("花火", "浴衣", "風鈴"),
    8: ("灯籠", "盆踊り", "夏祭り"),
    9: ("団子", "ススキ", "月見"),
    10: ("紅葉", "栗", "秋"),
    11: ("菊", "千歳飴"),
    12: ("柚子", "餅つき"),
}


def degree_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """(lat_min, lat_max, lon_min, lon_max) of a radius, in degrees."""
    import math

    dlat = km / 111.0
    dlon = km / (111.0 * max(math.cos(math.radians(lat)), 0.01))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def boxes(spark: SparkSession, places: list[tuple]) -> DataFrame:
    """A dictionary of places as boxes: code, lat_min, lat_max, lon_min, lon_max."""
    rows = [(code, *degree_box(lat, lon, km)) for code, lat, lon, km in places]
    return spark.createDataFrame(rows, "code string, lat_min double, lat_max double, lon_min double, lon_max double")


def boxes_sql(places: list[tuple]) -> str:
    """The same dictionary as a SQL VALUES list."""
    rows = ", ".join(f"('{code}', " + ", ".join(f"CAST({x!r} AS DOUBLE)" for x in degree_box(lat, lon, km)) + ")" for code, lat, lon, km in places)
    return f"(SELECT * FROM (VALUES {rows}) v(code, lat_min, lat_max, lon_min, lon_max))"


def era_of(year: str = "release_year") -> str:
    """SQL: era code of a year, null outside all of them."""
    return "CASE " + " ".join(f"WHEN {year} >= {a} AND {year} < {b} THEN '{code}'" for code, a, b in ERAS) + " END"


def era_index(code: str) -> str:
    """SQL: place of an era code in the list; an unknown code is in the middle."""
    return f"CASE {code} " + " ".join(f"WHEN '{e[0]}' THEN {i}" for i, e in enumerate(ERAS)) + " ELSE 4 END"


def era_midpoint(code: str) -> str:
    """SQL: middle year of an era, 0 for an unknown one."""
    return f"CASE {code} " + " ".join(f"WHEN '{c}' THEN {(a + b) // 2}" for c, a, b in ERAS) + " ELSE 0 END"
