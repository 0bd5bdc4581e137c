"""Names, labels, limits and grids that results depend on.

Everything here is data.  Kinds of bet are English keys inside the tables; the
labels are what card, quote and ticket files carry.
"""

from __future__ import annotations

import math

# Kinds of bet in report order, their labels and the number of legs.
KINDS = ["win", "place", "frame", "quinella", "wide", "exacta", "trio", "trifecta"]
KIND_LABELS = {
    "win": "単勝", "place": "複勝", "frame": "枠連", "quinella": "馬連",
    "wide": "ワイド", "exacta": "馬単", "trio": "3連複", "trifecta": "3連単",
}
KIND_LEGS = {"win": 1, "place": 1, "frame": 2, "quinella": 2, "wide": 2, "exacta": 2, "trio": 3, "trifecta": 3}
UNORDERED_KINDS = ["frame", "quinella", "wide", "trio"]

# File keys of the quote files.
QUOTE_FILE_KINDS = {
    "wakuren": "frame", "umaren": "quinella", "wide": "wide",
    "umatan": "exacta", "fuku3": "trio", "tan3": "trifecta",
}
QUOTE_FILE_BOTH = "tanpuku"

# Row classes of the payout table.
PAYOUT_CLASSES = {
    "Tansho": "win", "Fukusho": "place", "Wakuren": "frame", "Umaren": "quinella",
    "Wide": "wide", "Umatan": "exacta", "Fuku3": "trio", "Tan3": "trifecta",
}

# Venues.
VENUE_NAMES = {
    1: "札幌", 2: "函館", 3: "福島", 4: "新潟", 5: "東京",
    6: "中山", 7: "中京", 8: "京都", 9: "阪神", 10: "小倉",
}
VENUE_SHORT = {
    "札": 1, "函": 2, "福": 3, "新": 4, "東": 5,
    "中": 6, "名": 7, "京": 8, "阪": 9, "小": 10,
}

# Surface, going, running style, race class.
SURFACE_MARKS = {"芝": "芝", "ダ": "ダート", "障": "障害"}
SURFACE_MISSING = "NA"
STEEPLECHASE = "障害"
GOING_LEVELS = {"良": 1.0, "稍": 2.0, "稍重": 2.0, "重": 3.0, "不": 4.0, "不良": 4.0}
STYLE_LEVELS = {"逃": 1.0, "先": 2.0, "差": 3.0, "追": 4.0, "マ": 3.0, "捲": 3.0}
STYLE_NAMES = ["逃げ", "先行", "差し", "追込"]
STYLE_UNKNOWN = "不明"
ALLOWANCE_MARKS = "▲☆△★◇"
CLASS_NAMES = ["新馬", "未勝利", "1勝", "2勝", "3勝", "OP", "G3", "G2", "G1"]
CLASS_PATTERNS = [
    (r"G1|GI|GⅠ|ＧＩ", "G1"),
    (r"G2|GII|GⅡ|ＧⅡ", "G2"),
    (r"G3|GIII|GⅢ|ＧⅢ", "G3"),
    (r"オープン|OP|リステッド|L\b", "OP"),
    (r"1600万|3勝", "3勝"),
    (r"1000万|2勝", "2勝"),
    (r"500万|1勝", "1勝"),
    (r"未勝利", "未勝利"),
    (r"新馬", "新馬"),
]
CLASS_OTHER = "OP"
CLASS_BY_WINS = [(0, "未勝利"), (1, "1勝"), (2, "2勝"), (3, "3勝")]

# Career distance bands when the header names none.
CAREER_COLUMNS = ["career_all", "career_a", "career_b", "career_c"]
CAREER_BANDS = {"career_a": (0, 1400), "career_b": (1401, 2000), "career_c": (2001, 99999)}

# Frame colours.
FRAME_COLOURS = {1: "白", 2: "黒", 3: "赤", 4: "青", 5: "黄", 6: "緑", 7: "橙", 8: "桃"}

# Ticket rules (lowest chance, lowest value, highest value).
LEG_CHANCE = 0.1
DEFAULT_MIN_VALUE = 1.0
TICKET_RULES = {
    "frame": (0.15, 1.5, 1.6),
    "quinella": (0.15, 1.2, 3.0),
    "exacta": (0.1, 1.0, 1.6),
    "trio": (0.125, 1.1, 3.0),
    "wide": (0.3, 1.2, math.inf),
    "place": (0.5, 1.2, math.inf),
}
SMALL_FIELD = 7

# Threshold grids.
CHANCE_GRID = [0.1, 0.125, 0.15, 0.2, 0.3, 0.5]
VALUE_GRID = [1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 20.0, 30.0]
CONFIDENCE_GRID = [0.0, 0.3, 0.4, 0.5, 0.6]
TEMPERATURE_GRID = [10 ** (-1.5 + 3.0 * i / 60) for i in range(61)]
BLEND_GRIDS = {"other": [0.1 * i for i in range(1, 10)], "win": [0.05 * i for i in range(1, 11)]}
STAKE = 100

# Encoder limits.
MIN_ROLE_RUNS = 3
MIN_PAIR_RUNS = 2
MIN_CATEGORY_ROWS = 30
FOLDS = 5

# Patterns of the card, ticket and message texts.
PATTERNS = {
    "number": r"[-+]?\d*\.?\d+",
    "digits": r"(\d+)",
    "placing": r"^\s*(\d+)着",
    "course": r"^(芝|ダ|障|ダート)?\s*(\d{3,4})\s*(良|稍重|稍|重|不良|不)?",
    "abandoned": r"(中止|取消|除外)",
    "clock": r"([0-9]+(?:[.:][0-9]+){1,2})",
    "month_day": r"^(\d{1,2})/(\d{1,2})$",
    "date_place_weather": r"^(\d{1,2}/\d{1,2})([^\d晴曇雨雪]+?)?(小雨|小雪|晴|曇|雨|小|雪)?$",
    "name_number": r"^(.+?)([\d.]+)$",
    "three_ints": r"(\d+)\D+(\d+)\D+(\d+)",
    "pace_style_time": r"^([A-Za-z]+)?([^A-Za-z\d.]+)?([\d.]+)?$",
    "text_paren": r"^(.*?)\((.*?)\)$",
    "weight_delta_rank": r"^([^\(]+)(?:\((.*?)\))?(\d*)$",
    "sex_age": r"^(牡|牝|セ|セン|せん|騙)(\d+)",
    "quote_range": r"^\s*([\d.]+)\s*-\s*([\d.]+)\s*$",
    "meeting_text": r"^(\d{4})年 第(\d+)回(\d+)日目$",
    "race_text": r"^(\d+)R$",
    "receipt": r"IPATで (\d+)点 ([\d,]+)円を自動購入しました",
    "bet_line": r"(?m)^(単勝|複勝|枠連|馬連|ワイド|馬単|3連複|3連単) (.+?) \| 確率 .+? \| オッズ .+? \| 期待値 .+$",
    "message_head": r"(?m)^(.+?) (\d+)R (.*?) 発走 (\d{4}/\d{2}/\d{2} \d{2}:\d{2}) JST$",
    "quote_file": r"odds_(\d{8})_([^_]+?)(\d+)回(\d+)日_(\d+)R_([a-z0-9]+)\.csv",
    "card_file": r"horse_racing_data_([0-9]{10}|[0-9]{12})\.csv",
    "race_link": r"race_id=(\d{12})",
    "past_marker": r"^(前走|[2-5]走前)の成績$",
    "allowance": r"^[▲☆△★◇]",
    "decimal": r"([\d.]+)",
    "name_tag": r"^[(（](?:地|外|父|市|招|特)[)）]",
    "katakana_l": r"(?<=[ァ-ヶー])l(?=[ァ-ヶー]|$)",
    "band_number": r"\d{3,4}",
    "band_upper": r"以下|未満|まで|^[~〜\-−–]",
    "band_lower": r"以上|超|から|[~〜\-−–]$",
    "obstacle": r"障(?:害)?[0-9]",
    "refund": r"返還|特払|特別払戻",
}

# Characters read as the long vowel mark in names, and one wrong spelling it causes.
NAME_BARS = "ｌ｜￨¦"
NAME_LONG = "ー"
NAME_REPAIR = ("bーe", "ble")

# Text forms of the legs per kind.
LEG_PATTERNS = {
    "win": r"^(\d+)", "place": r"^(\d+)", "frame": r"^枠(\d+)-枠(\d+)$",
    "quinella": r"^(\d+)-(\d+)$", "wide": r"^(\d+)-(\d+)$", "exacta": r"^(\d+)→(\d+)$",
    "trio": r"^(\d+)-(\d+)-(\d+)$", "trifecta": r"^(\d+)→(\d+)→(\d+)$",
}
LEG_FORMS = {
    "win": "%d", "place": "%d", "frame": "枠%d-枠%d", "quinella": "%d-%d", "wide": "%d-%d",
    "exacta": "%d→%d", "trio": "%d-%d-%d", "trifecta": "%d→%d→%d",
}
MAX_NUMBER = 18
MAX_FRAME = 8

# Row labels and field order of the vertical card.
CARD_NAME_LABEL = "馬名"
CARD_NUMBER_LABEL = "馬番"
CARD_CURRENT_AFTER = "調教師"
CARD_CURRENT_FIELDS = [
    "着順", "単勝オッズ", "タイム", "ペース,脚質,上3F", "通過順位",
    "馬体重()3F順", "先行指数", "ペース指数", "上がり指数", "スピード指数",
]
CARD_PAST_FIELDS = [
    "成績", "レース名", "コース", "騎手,斤量", "頭数,馬番,人気", "タイム,(着順)", "ペース,脚質,上3F",
    "通過順位", "トップ(タイム差)", "馬体重()3F順", "先行指数", "ペース指数", "上がり指数", "スピード指数",
]
PAST_BLOCKS = ["前走", "2走前", "3走前", "4走前", "5走前"]
PAST_NUMBERS = [
    "スピード指数", "先行指数", "ペース指数", "上がり指数", "タイム差", "着順", "人気", "頭数", "馬番",
    "距離", "斤量", "体重増減", "上がり3F順位", "上3F", "馬体重",
]
