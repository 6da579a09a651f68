"""Words and tables that jobs look things up by. Fixed values throughout."""

# Words of a label and the theme that they name; a label may name several.
KEYWORD_THEMES = [
    (("妖怪", "化け", "幽霊", "鬼", "百鬼", "怪談", "怪奇", "霊"), "yokai"),
    (("忍者", "忍", "ニンジャ"), "ninja"),
    (("侍", "武士", "武道", "剣", "刀"), "samurai"),
    (("神社", "鳥居", "神道", "祭神"), "shrine_temple"),
    (("寺", "仏", "仏教", "菩薩", "如来", "阿弥陀"), "sacred_profane"),
    (("城", "城郭", "天守"), "war_conflict"),
    (("祭", "踊", "盆踊", "山車", "神輿"), "community_tradition"),
    (("温泉", "湯", "風呂"), "nature_communion"),
    (("桜", "花見", "梅", "藤"), "seasonal_beauty"),
    (("紅葉", "秋", "落葉"), "seasonal_beauty"),
    (("茶", "侘び", "寂び"), "wabi_sabi"),
    (("禅", "坐禅", "瞑想"), "reflective_beauty"),
    (("料理", "食", "寿司", "和食", "ラーメン", "蕎麦", "酒"), "food_culture"),
    (("庭", "庭園", "枯山水"), "garden_beauty"),
    (("花", "草", "自然", "山", "海", "川", "森", "滝"), "nature_communion"),
    (("魔法", "魔", "異世界", "ファンタジー"), "magic"),
    (("転生", "死", "霊", "冥"), "death_rebirth"),
    (("恋", "愛", "結婚", "恋愛"), "love_bond"),
    (("学園", "青春", "学校", "部活"), "identity_self"),
    (("ロボット", "メカ", "機械", "ガンダム", "マクロス"), "mecha"),
    (("浮世絵", "版画", "錦絵", "木版"), "ukiyoe_craft"),
    (("屏風", "絵巻", "掛軸", "襖絵"), "ukiyoe_craft"),
    (("歌舞伎", "能", "狂言", "文楽", "人形浄瑠璃"), "performing_arts"),
    (("俳句", "和歌", "短歌", "万葉", "古今"), "literary_spirit"),
    (("着物", "織物", "染色", "友禅"), "craft_mastery"),
    (("陶芸", "焼", "磁器", "陶器", "漆"), "craft_mastery"),
    (("相撲", "柔道", "剣道", "空手", "合気道"), "martial_arts"),
    (("SF", "宇宙", "サイエンス", "未来"), "science_fiction"),
    (("推理", "探偵", "ミステリー", "事件"), "mystery"),
    (("スポーツ", "野球", "サッカー", "バスケ", "テニス"), "sports"),
    (("音楽", "バンド", "ライブ", "歌", "楽器", "アイドル"), "performing_arts"),
    (("戦争", "戦", "軍", "兵"), "war_conflict"),
    (("旅", "冒険", "漂流", "航海"), "journey_boundary"),
    (("変身", "変容", "成長"), "transformation"),
]
# The theme of a label without any of these words, by entity type.
DEFAULT_THEMES = {"place": "community_tradition", "work": "craft_mastery"}

# Names of today's prefectures in labels, with a point.
PREFECTURE_POINTS = [
    ("北海道", 43.0642, 141.3469),
    ("青森", 40.8244, 140.7400),
    ("岩手", 39.7036, 141.1527),
    ("宮城", 38.2688, 140.8721),
    ("秋田", 39.7186, 140.1024),
    ("山形", 38.2405, 140.3634),
    ("福島", 37.7503, 140.4676),
    ("茨城", 36.3418, 140.4468),
    ("栃木", 36.5657, 139.8836),
    ("群馬", 36.3911, 139.0608),
    ("埼玉", 35.8569, 139.6489),
    ("千葉", 35.6047, 140.1233),
    ("東京", 35.6762, 139.6503),
    ("神奈川", 35.4478, 139.6425),
    ("新潟", 37.9026, 139.0236),
    ("富山", 36.6953, 137.2113),
    ("石川", 36.5946, 136.6256),
    ("福井", 36.0652, 136.2219),
    ("山梨", 35.6642, 138.5684),
    ("長野", 36.2325, 138.1812),
    ("岐阜", 35.3912, 136.7223),
    ("静岡", 34.9769, 138.3831),
    ("愛知", 35.1802, 136.9066),
    ("三重", 34.7303, 136.5086),
    ("滋賀", 35.0045, 135.8686),
    ("京都", 35.0116, 135.7681),
    ("大阪", 34.6937, 135.5023),
    ("兵庫", 34.6913, 135.1830),
    ("奈良", 34.6851, 135.8049),
    ("和歌山", 34.2261, 135.1675),
    ("鳥取", 35.5039, 134.2383),
    ("島根", 35.4723, 133.0505),
    ("岡山", 34.6617, 133.9350),
    ("広島", 34.3966, 132.4596),
    ("山口", 34.1861, 131.4714),
    ("徳島", 34.0658, 134.5593),
    ("香川", 34.3402, 134.0434),
    ("愛媛", 33.8416, 132.7657),
    ("高知", 33.5597, 133.5311),
    ("福岡", 33.6064, 130.4183),
    ("佐賀", 33.2494, 130.2988),
    ("長崎", 32.7503, 129.8779),
    ("熊本", 32.7898, 130.7417),
    ("大分", 33.2382, 131.6126),
    ("宮崎", 31.9111, 131.4239),
    ("鹿児島", 31.5602, 130.5581),
    ("沖縄", 26.3344, 127.8056),
]
# Names of old provinces in labels, with a point.
PROVINCE_POINTS = [
    ("蝦夷", 43.0, 141.3),
    ("陸奥", 40.8, 140.7),
    ("出羽", 38.2, 140.3),
    ("下野", 36.6, 139.9),
    ("上野", 36.4, 139.1),
    ("武蔵", 35.7, 139.7),
    ("相模", 35.4, 139.3),
    ("越後", 37.9, 139.0),
    ("越中", 36.7, 137.2),
    ("能登", 37.0, 136.8),
    ("加賀", 36.6, 136.6),
    ("越前", 36.1, 136.2),
    ("甲斐", 35.7, 138.6),
    ("信濃", 36.2, 138.2),
    ("飛騨", 36.1, 137.3),
    ("美濃", 35.4, 136.8),
    ("駿河", 35.0, 138.4),
    ("遠江", 34.8, 137.8),
    ("三河", 34.8, 137.2),
    ("尾張", 35.2, 136.9),
    ("伊勢", 34.7, 136.5),
    ("近江", 35.0, 135.9),
    ("山城", 35.0, 135.8),
    ("大和", 34.7, 135.8),
    ("摂津", 34.7, 135.5),
    ("河内", 34.6, 135.6),
    ("和泉", 34.5, 135.5),
    ("播磨", 34.8, 134.7),
    ("紀伊", 34.2, 135.2),
    ("因幡", 35.5, 134.2),
    ("伯耆", 35.4, 133.5),
    ("出雲", 35.4, 132.8),
    ("備前", 34.7, 134.0),
    ("備中", 34.7, 133.6),
    ("安芸", 34.4, 132.5),
    ("周防", 34.2, 131.5),
    ("長門", 34.4, 131.2),
    ("阿波", 34.1, 134.6),
    ("讃岐", 34.3, 134.0),
    ("伊予", 33.8, 132.8),
    ("土佐", 33.6, 133.5),
    ("筑前", 33.6, 130.4),
    ("筑後", 33.3, 130.5),
    ("肥前", 33.2, 130.3),
    ("肥後", 32.8, 130.7),
    ("豊前", 33.6, 131.0),
    ("豊後", 33.2, 131.6),
    ("日向", 31.9, 131.4),
    ("大隅", 31.4, 130.7),
    ("薩摩", 31.6, 130.6),
    ("琉球", 26.3, 127.8),
]

# Designations by outside id, the highest first.
DESIGNATIONS = [
    ("Q9259", "world_heritage"),
    ("Q1139795", "kokuho"),
    ("Q1188622", "juyo_bunkazai"),
    ("Q1120982", "historic_site"),
    ("Q2319498", "scenic_beauty"),
    ("Q2753153", "natural_monument"),
    ("Q10857476", "registered_tangible"),
]
