"""Labels, titles and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + " "


def norm_title(text: Column) -> Column:
    """Full-width ASCII to half-width, trimmed."""
    return F.trim(F.translate(text, _WIDE, _NARROW))


def strip_disambiguation(text: Column) -> Column:
    """Without one trailing bracketed part."""
    return F.regexp_replace(text, r"\s*[（(][^（()）]*[)）]\s*$", "")


def norm_label(text: Column) -> Column:
    """Without any bracketed parts, trimmed."""
    out = text
    for pattern in (r"（[^）]*）", r"\([^)]*\)", r"【[^】]*】"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(out)


def clean_title(text: Column) -> Column:
    """White space collapsed; null unless 2 to 300 characters are left."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t).between(2, 300), t)


def qid(uri: Column) -> Column:
    """Last part of an entity's address, if it is an item number."""
    last = F.substring_index(uri, "/", -1)
    return F.when(last.rlike("^Q"), last)


def record_id(link: Column) -> Column:
    """The identifier that ends a link's path, else the whole link."""
    return F.coalesce(F.nullif(F.regexp_extract(link, r"/([0-9A-Za-z_]+[0-9]+)(?:\?|$)", 1), F.lit("")), link)


def all_digits(text: Column) -> Column:
    return text.rlike("^[0-9０-９]+$")


def low_unique(text: Column, most: int = 2) -> Column:
    """Made of at most so many different characters."""
    return F.size(F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))) <= most


def quoted_place(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "同じ場所「(.+?)」", 1), F.lit(""))


def truncate(text: Column, most: int = 200) -> Column:
    """Cut to ``most`` characters, the last three of them dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def description_label(text: Column, most: int = 80) -> Column:
    """A description good enough for a label: short and without a comma."""
    return F.when((F.length(text) <= most) & ~F.contains(text, F.lit(",")), text)


def commons_path(name: Column) -> Column:
    """Path of a media file by the digest of its name."""
    n = F.replace(name, F.lit(" "), F.lit("_"))
    d = F.md5(n.cast("binary"))
    return F.concat_ws("/", F.substring(d, 1, 1), F.substring(d, 1, 2), F.replace(F.url_encode(n), F.lit("+"), F.lit("%20")))


# Names of places by level. A caller may pass other lists.
COUNTRY = ["日本", "Japan", "日本国"]
WIDE_REGIONS = ["北海道地方", "東北地方", "関東地方", "中部地方", "近畿地方", "中国地方", "四国地方", "九州地方", "九州・沖縄地方", "東海地方", "北陸地方", "甲信越地方", "関西地方"]
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
VENUES = ["東京国際フォーラム", "中野サンプラザ", "武道館", "日本武道館", "幕張メッセ", "東京ガーデンシアター", "パシフィコ横浜", "昭和女子大学人見記念講堂", "国技館", "両国国技館", "マリンメッセ福岡", "大宮ソニックシティ", "TOKYO DOME CITY HALL", "Bunkamura"]
DENSE_CITIES = ["東京", "大阪市", "横浜市", "名古屋市", "札幌市", "福岡市", "神戸市", "京都市", "川崎市", "広島市", "さいたま市", "仙台市", "千葉市", "北九州市", "堺市", "新潟市", "浜松市", "熊本市", "相模原市", "岡山市", "静岡市"]
VENUE_WORDS = ["ホール", "ドーム", "アリーナ", "スタジアム", "競技場", "Zepp", "LIVE"]


def granularity(place: Column, country=COUNTRY, regions=WIDE_REGIONS, dense=DENSE_CITIES, venues=VENUE_WORDS) -> Column:
    """Level of a place name; the first that fits."""
    return (
        F.when(place.isNull() | (place == ""), "UNKNOWN")
        .when(place.isin(*country), "L1")
        .when(place.isin(*regions), "L2")
        .when(place.isin(*PREFECTURES), "L3_prefecture")
        .when(place.isin(*dense), "L4_high_density")
        .when(place.isin(*VENUES) | place.rlike("|".join(venues)), "L5_venue")
        .when(place.rlike("(市|町|村|区)$"), "L4_city")
        .otherwise("L5_spot")
    )
