"""Fixed values.

Word lists, constants and lookup tables whose content decides results. They are data, not
logic: every one is stated as it is used, in its natural (priority) order.
"""

from __future__ import annotations

# fixed values: intents and entity kinds
INTENTS = [
    "Brand Search", "Category Search", "Nearby Search", "POI Search", "Address Suggestion",
    "Location Search", "Discovery Search", "Navigation", "Attribute Search",
    "Coordinate Search", "Ambiguous",
]

ENTITY_KINDS = [
    "brand", "category", "poi", "street", "city", "district", "attribute", "proximity",
    "navigation", "coordinate", "address",
]

# fixed values: label variants of suggestion types
INTENT_ALIASES = {
    "Brand Suggestion": "Brand Search",
    "Brand Suggestions": "Brand Search",
    "Category Suggestion": "Category Search",
    "Category Suggestions": "Category Search",
    "Nearby Suggestion": "Nearby Search",
    "Nearby Suggestions": "Nearby Search",
    "POI Suggestion": "POI Search",
    "POI Suggestions": "POI Search",
    "Address Suggestion": "Address Suggestion",
    "Address Suggestions": "Address Suggestion",
}

# fixed values: scales of popularity factors, and the radius within which a point has a city
MAX_QUERY_FREQUENCY = 15000.0
MAX_REVIEWS = 10000.0
CITY_RADIUS_M = 60000.0

# fixed values: query aliases, applied in this order
QUERY_ALIASES = [
    ("cafe", "cà phê"), ("coffee", "cà phê"), ("cf", "cà phê"), ("near", "gần đây"),
    ("near me", "gần đây"), ("hotel", "khách sạn"), ("xang", "xăng"), ("tram x", "trạm xăng"),
    ("cay xang", "cây xăng"), ("benh vien", "bệnh viện"), ("khach san", "khách sạn"),
    ("sieuthi", "siêu thị"), ("gara oto", "garage ô tô"), ("oto", "ô tô"), ("cho", "chợ"),
    ("ben thanh", "bến thành"), ("nguyen huee", "nguyễn huệ"), ("da n", "đà nẵng"),
    ("danang", "đà nẵng"), ("hcm", "TP.HCM"), ("bk", "bách khoa"), ("q", "quận"),
]

# fixed values: phrases and syllables every lexicon starts with
DOMAIN_PHRASES = [
    "ca phe", "quan ca phe", "khach san", "benh vien", "nha hang", "cay xang", "tram xang",
    "tra sua", "sieu thi", "nha thuoc", "duong den", "chi duong", "san bay", "ben xe",
    "hoc vien", "trung tam", "gara o to", "garage o to", "quan nuong", "quan chay", "quan an",
    "an dem", "gan day", "gan nhat", "gan bien", "mo cua", "lam viec", "hoc tap", "check in",
    "song ao",
]
SYLLABLES = [
    "an", "atm", "bach", "bay", "ben", "benh", "bien", "ca", "cafe", "cay", "chay", "check",
    "cho", "cong", "da", "day", "dem", "den", "dia", "duong", "gan", "gara", "garage", "ha",
    "hoc", "hue", "khach", "khoa", "lam", "long", "mart", "mo", "mua", "my", "nang", "nha",
    "nhat", "noi", "nuong", "oto", "phe", "phong", "phuc", "quan", "sach", "san", "sua", "tam",
    "thanh", "thi", "thuoc", "tin", "tra", "tram", "trung", "vien", "vin", "wifi", "xang",
]

# fixed values: term -> related words for lexical-semantic matching
SEMANTIC_EXPANSIONS = {
    "song ao": ["check in", "chup hinh", "dep", "du lich"],
    "chup hinh": ["check in", "song ao", "dep"],
    "dep": ["check in", "song ao", "du lich"],
    "khuya": ["mo cua", "an dem", "24 7"],
    "dem": ["khuya", "an dem", "mo cua"],
    "hoc": ["hoc tap", "lam viec", "wifi", "yen tinh"],
    "lam viec": ["wifi", "yen tinh", "hoc tap"],
    "gan bien": ["bien", "my khe", "da nang"],
    "bien": ["gan bien", "my khe", "du lich"],
    "gan san bay": ["san bay", "noi bai", "tan son nhat"],
    "cf": ["ca phe", "cafe", "coffee"],
    "cafe": ["ca phe", "coffee", "quan ca phe"],
    "hotel": ["khach san", "gan bien", "du lich"],
}

# fixed values: city -> accepted spellings
CITY_ALIASES = {
    "tp.hcm": ["tp.hcm", "tp hcm", "hcm", "ho chi minh", "thanh pho ho chi minh", "sai gon", "sg"],
    "ha noi": ["ha noi", "hn"],
    "da nang": ["da nang", "dn"],
    "da lat": ["da lat", "dl"],
    "nha trang": ["nha trang", "nt"],
    "hai phong": ["hai phong", "hp"],
}
KNOWN_CITIES = ["TP.HCM", "Hà Nội", "Đà Nẵng", "Đà Lạt", "Nha Trang", "Hải Phòng"]
KNOWN_DISTRICTS = ["Quận 1", "Quận 7"]

# fixed values: entity terms (kind, value, confidence, extra trigger)
ENTITY_TERMS = [
    ("category", "cà phê", 0.9, None), ("category", "ATM", 0.94, None),
    ("category", "khách sạn", 0.9, None), ("category", "bệnh viện", 0.9, None),
    ("category", "cây xăng", 0.9, None), ("category", "nhà hàng", 0.82, None),
    ("category", "trà sữa", 0.82, None), ("attribute", "Wi-Fi", 0.8, "wifi"),
    ("attribute", "24/7", 0.8, None), ("attribute", "gần biển", 0.78, None),
    ("attribute", "check-in", 0.78, None), ("attribute", "yên tĩnh", 0.76, None),
    ("attribute", "làm việc", 0.76, None), ("proximity", "gần đây", 0.9, None),
    ("proximity", "gần nhất", 0.9, None), ("navigation", "chỉ đường", 0.96, None),
    ("navigation", "đường đến", 0.94, "duong den"),
]

# fixed values: raw terms that vote for an intent ("24/7" never occurs in normalized text)
VOTE_TERMS = [
    ("cafe", "Category Search"), ("ca phe", "Category Search"), ("quan ca phe", "Category Search"),
    ("atm", "Nearby Search"), ("khach san", "Category Search"), ("benh vien", "Nearby Search"),
    ("cay xang", "Nearby Search"), ("nha hang", "Category Search"), ("cho", "POI Search"),
    ("san bay", "POI Search"), ("gan day", "Nearby Search"), ("gan nhat", "Nearby Search"),
    ("gan bien", "Discovery Search"), ("24/7", "Discovery Search"), ("mo cua", "Discovery Search"),
    ("wifi", "Attribute Search"), ("lam viec", "Discovery Search"), ("hoc", "Discovery Search"),
    ("check in", "Discovery Search"), ("duong den", "Navigation"), ("chi duong", "Navigation"),
]
ENTITY_INTENTS = {
    "coordinate": "Coordinate Search", "navigation": "Navigation", "address": "Address Suggestion",
    "street": "Address Suggestion", "proximity": "Nearby Search", "attribute": "Attribute Search",
    "brand": "Brand Search", "poi": "POI Search", "category": "Category Search",
}

# fixed values: generated-pattern lexicons (key, label, intent, trigger phrases)
PATTERN_CATEGORIES = [
    ("cafe", "Quán cà phê", "Category Search", ["cafe", "coffee", "cf", "ca phe", "quan ca phe"]),
    ("hotel", "Khách sạn", "Category Search", ["hotel", "ks", "khach san"]),
    ("atm", "ATM", "Nearby Search", ["atm", "cash machine"]),
    ("hospital", "Bệnh viện", "Nearby Search", ["bv", "benh vien", "hospital"]),
    ("gas", "Cây xăng", "Nearby Search", ["cay xang", "tram xang", "xang", "gas station"]),
    ("restaurant", "Nhà hàng", "Category Search", ["nha hang", "restaurant"]),
    ("eatery", "Quán ăn", "Category Search", ["quan an", "food"]),
    ("market", "Chợ", "Category Search", ["cho", "market"]),
    ("supermarket", "Siêu thị", "Category Search", ["sieu thi", "supermarket"]),
    ("cinema", "Rạp chiếu phim", "Category Search", ["rap phim", "cinema", "movie"]),
    ("airport", "Sân bay", "POI Search", ["san bay", "airport"]),
    ("bus station", "Bến xe", "POI Search", ["ben xe", "bus station"]),
    ("university", "Đại học", "POI Search", ["dai hoc", "dh", "university"]),
    ("academy", "Học viện", "Category Search", ["hoc vien", "academy"]),
    ("pharmacy", "Nhà thuốc", "Category Search", ["nha thuoc", "pharmacy"]),
    ("repair", "Tiệm sửa xe", "Category Search", ["sua xe", "tiem sua xe"]),
    ("garage", "Garage ô tô", "Category Search", ["garage", "gara", "oto", "o to"]),
    ("spa", "Spa", "Category Search", ["spa"]),
    ("gym", "Phòng gym", "Category Search", ["gym", "phong gym"]),
    ("milk tea", "Trà sữa", "Category Search", ["tra sua", "milk tea"]),
]
PATTERN_ATTRIBUTES = [
    ("nearby", "gần đây", "Nearby Search", ["gan", "gan day", "gan nhat", "near", "near me"]),
    ("open-24h", "mở cửa 24/7", "Discovery Search", ["24/7", "24h", "mo cua", "open now"]),
    ("wifi", "có Wi-Fi", "Attribute Search", ["wifi", "wi fi"]),
    ("quiet", "yên tĩnh", "Discovery Search", ["yen tinh", "quiet"]),
    ("work-study", "phù hợp học tập", "Discovery Search", ["hoc tap", "lam viec", "study", "work"]),
    ("beach", "gần biển", "Discovery Search", ["gan bien", "near beach", "beach", "my khe"]),
    ("airport", "gần sân bay", "Nearby Search",
     ["gan san bay", "near airport", "noi bai", "tan son nhat"]),
    ("late-night", "mở cửa khuya", "Discovery Search", ["khuya", "an dem", "late night"]),
    ("check-in", "đẹp để check-in", "Discovery Search", ["check in", "song ao", "chup hinh"]),
    ("family", "phù hợp cho trẻ em", "Discovery Search", ["tre em", "family", "kid"]),
    ("vegetarian", "chay", "Category Search", ["chay", "vegetarian"]),
    ("halal", "halal", "Category Search", ["halal"]),
    ("rooftop", "rooftop", "Discovery Search", ["rooftop", "view"]),
    ("on-route", "trên đường đi", "Discovery Search", ["tren duong", "duong di", "on route"]),
]
# fixed values: attributes a corpus category gets, by the first key fragment that fits
CORPUS_ATTRIBUTES = [
    (["cafe", "ca phe", "quan ca phe"],
     ["nearby", "open-24h", "wifi", "quiet", "work-study", "check-in", "rooftop"]),
    (["hotel", "khach san"], ["nearby", "beach", "airport", "family"]),
    (["nha hang", "quan an", "restaurant", "eatery"],
     ["nearby", "open-24h", "late-night", "family", "vegetarian", "halal", "rooftop"]),
    (["atm", "benh vien", "hospital"], ["nearby", "airport"]),
    (["xang", "gas"], ["nearby", "on-route"]),
    (["gym"], ["nearby", "open-24h"]),
]

# fixed values: curated completions (triggers, texts, intent, reason)
TEMPLATES = [
    (["bv bach", "benh vien bach"], ["Bệnh viện Bạch Mai"], "POI Search",
     "hospital abbreviation plus POI completion"),
    (["ben thanh"], ["Chợ Bến Thành", "Khách sạn gần Chợ Bến Thành"], "POI Search",
     "landmark completion for Bến Thành"),
    (["my khe hotel"], ["Khách sạn gần biển Mỹ Khê"], "Discovery Search",
     "specific My Khe hotel intent"),
    (["khach san da nang", "hotel da nang", "hotel near beach danang", "my khe hotel"],
     ["Khách sạn Đà Nẵng", "Khách sạn Đà Nẵng gần biển", "Khách sạn gần biển Đà Nẵng",
      "Hotel Đà Nẵng", "Khách sạn gần biển Mỹ Khê"], "Discovery Search",
     "hotel plus coastal Da Nang intent"),
    (["cay xang", "tram xang"], ["Cây xăng gần đây", "Trạm xăng gần đây"], "Nearby Search",
     "gas station nearby intent"),
    (["xang tren duong"], ["Cây xăng trên đường đi", "Trạm dừng có cây xăng"], "Discovery Search",
     "gas station on-route discovery intent"),
    (["coffee gan day", "ca phe gan day"], ["Coffee near me", "Quán cà phê gần đây"],
     "Discovery Search", "mixed language nearby cafe intent"),
    (["cafe yen tinh"], ["Quán cà phê yên tĩnh"], "Discovery Search",
     "quiet cafe attribute intent"),
    (["quan cafe hoc", "cafe wifi", "cf lam viec", "cafe yen tinh", "cafe dep song ao"],
     ["Quán cà phê phù hợp học tập", "Cafe có Wi-Fi", "Quán cà phê có Wi-Fi", "Cafe làm việc",
      "Quán cà phê yên tĩnh", "Quán cà phê đẹp để check-in"], "Discovery Search",
     "semantic cafe attribute intent"),
    (["nguyen hue", "12 nguyen hue"],
     ["Nguyễn Huệ, Quận 1, TP.HCM", "12 Nguyễn Huệ, Quận 1, TP.HCM",
      "Highlands Coffee Nguyễn Huệ"], "Address Suggestion", "street and address completion"),
    (["atm vcb quan", "atm vietcombank quan"],
     ["ATM Vietcombank Quận 1", "ATM Vietcombank Quận 7"], "Nearby Search",
     "ATM brand plus district intent"),
    (["atm bidv"], ["ATM BIDV gần đây"], "Nearby Search", "ATM brand nearby intent"),
    (["noi bai atm"], ["ATM gần sân bay Nội Bài"], "Nearby Search",
     "reference location nearby ATM intent"),
    (["benh vien gan san bay"], ["Bệnh viện gần sân bay"], "Nearby Search",
     "hospital near airport intent"),
    (["ha noi an"], ["Quán ăn Hà Nội", "Ăn đêm Hà Nội"], "Discovery Search",
     "city plus food discovery intent"),
    (["quan an tre em"], ["Nhà hàng phù hợp cho trẻ em"], "Discovery Search",
     "family-friendly food attribute intent"),
    (["do an vat"], ["Quán ăn vặt gần đây"], "Category Search", "snack food category intent"),
    (["quan an khu", "ha noi an", "quan an tre em", "do an vat"],
     ["Quán ăn mở cửa khuya", "Ăn đêm gần đây", "Quán ăn Hà Nội", "Nhà hàng phù hợp cho trẻ em",
      "Quán ăn vặt gần đây"], "Discovery Search", "food discovery and attribute intent"),
    (["tra sua ngon", "tra sua gan"], ["Trà sữa gần đây", "Trà sữa ngon"], "Discovery Search",
     "milk tea slang/category intent"),
    (["san bay noi bai"], ["Sân bay Nội Bài"], "POI Search", "airport POI completion"),
    (["vincom dong khoi"], ["Vincom Center Đồng Khởi"], "POI Search",
     "shopping mall POI completion"),
    (["galaxy"], ["Galaxy Cinema", "Samsung Galaxy Store", "Galaxy Hotel"], "Ambiguous",
     "ambiguous brand/entity completion"),
    (["big c"], ["GO! / Big C", "Big C Thăng Long", "Big C Miền Đông"], "Ambiguous",
     "brand alias ambiguity"),
    (["rooftop quan 1"], ["Rooftop Quận 1", "Quán bar rooftop Quận 1"], "Discovery Search",
     "rooftop attribute plus district intent"),
    (["halal hcm"], ["Nhà hàng halal TP.HCM"], "Category Search",
     "special food attribute plus city"),
    (["quan chay"], ["Nhà hàng chay gần đây", "Quán chay"], "Category Search",
     "vegetarian category intent"),
    (["bien my khe"], ["Bãi biển Mỹ Khê"], "POI Search", "beach POI completion"),
    (["dai hoc bach khoa", "dh bach khoa"], ["Đại học Bách Khoa Hà Nội", "Đại học Bách Khoa"],
     "POI Search", "university abbreviation completion"),
    (["phuc long"], ["Phúc Long gần đây", "Phúc Long Coffee & Tea"], "Brand Search",
     "brand suggestion"),
    (["cong cafe"], ["Cộng Cà Phê gần đây", "Cộng Cà Phê Hồ Gươm"], "Brand Search",
     "brand suggestion"),
    (["pizza 4"], ["Pizza 4P's", "Pizza 4P's Bến Nghé"], "Brand Search", "brand suggestion"),
    (["win"], ["WinMart", "WinMart+ gần đây"], "Brand Search", "brand suggestion"),
    (["lotte"], ["Lotte Mart", "Lotteria", "Lotte Cinema"], "Brand Search", "brand ambiguity"),
    (["ho guom cafe"], ["Quán cà phê gần Hồ Gươm"], "Discovery Search",
     "alias plus nearby cafe intent"),
    (["sua xe gan"], ["Tiệm sửa xe gần đây"], "Category Search",
     "vehicle repair category completion"),
    (["garage o to"], ["Garage ô tô gần đây"], "Category Search",
     "garage missing-accent category"),
    (["duong den ben"], ["Chỉ đường đến Chợ Bến Thành", "Chỉ đường đến bến xe"], "Navigation",
     "navigation command intent"),
    (["chi duong san bay"],
     ["Chỉ đường đến sân bay Nội Bài", "Chỉ đường đến sân bay Tân Sơn Nhất"], "Navigation",
     "navigation command intent"),
    (["10.77"], ["10.7769,106.7009"], "Coordinate Search", "coordinate prefix intent"),
    (["da lat check"], ["Địa điểm check-in đẹp ở Đà Lạt"], "Discovery Search",
     "Da Lat check-in discovery"),
    (["spa gan day"], ["Spa gần đây"], "Category Search", "wellness category intent"),
    (["gym 24"], ["Phòng gym mở cửa 24/7"], "Discovery Search", "24/7 gym attribute intent"),
    (["quan nuong quan 7"], ["Quán nướng Quận 7"], "Category Search",
     "grill category plus district"),
    (["ben xe mien dong"], ["Bến xe Miền Đông mới", "Bến xe Miền Đông cũ"], "POI Search",
     "bus station ambiguity"),
]
NEARBY_CAFE_REASON = "mixed language nearby cafe intent"

# fixed values: factor weights
FACTORS = [
    "lexical", "intent", "source", "popularity", "poiQuality", "locality", "personalization",
    "diversity",
]
DEFAULT_WEIGHTS = {
    "lexical": 0.3, "intent": 0.2, "source": 0.15, "popularity": 0.1, "poiQuality": 0.1,
    "locality": 0.05, "personalization": 0.05, "diversity": 0.05,
}
LEARNED_WEIGHTS = {
    "lexical": 0.3620541218189766, "intent": 0.26300701175166596, "source": 0.09314885834125675,
    "popularity": 0.058682762499052445, "poiQuality": 0.0, "locality": 0.005362823769400796,
    "personalization": 0.005362823769400796, "diversity": 0.21238159805024667,
}
PRESETS = {
    "default-v1": DEFAULT_WEIGHTS,
    "lexical-intent-heavy": {
        "lexical": 0.38, "intent": 0.24, "source": 0.12, "popularity": 0.08, "poiQuality": 0.06,
        "locality": 0.04, "personalization": 0.03, "diversity": 0.05,
    },
    "semantic-diverse": {
        "lexical": 0.24, "intent": 0.18, "source": 0.2, "popularity": 0.08, "poiQuality": 0.08,
        "locality": 0.04, "personalization": 0.04, "diversity": 0.14,
    },
    "popularity-quality": {
        "lexical": 0.24, "intent": 0.18, "source": 0.12, "popularity": 0.18, "poiQuality": 0.14,
        "locality": 0.05, "personalization": 0.04, "diversity": 0.05,
    },
}

# fixed values: per candidate source (source factor, diversity factor, tie priority, label)
SOURCES = {
    "autocomplete": (0.95, 0.66, 0, "historical autocomplete pair"),
    "popular-query": (0.86, 0.66, 1, "popular query trend"),
    "poi": (0.8, 0.66, 2, "POI dataset row"),
    "generated": (0.94, 0.92, 3, "data-derived query pattern"),
    "predicted": (0.9, 0.92, 4, "prefix-completion language model"),
    "template": (0.92, 0.92, 5, "curated semantic fallback"),
    "embedding": (0.88, 0.6, 6, "embedding kNN neighbor"),
    "semantic": (0.82, 0.6, 7, "semantic retrieval evidence"),
}
# fixed values: the order in which sources are concatenated
SOURCE_ORDER = [
    "autocomplete", "poi", "popular-query", "embedding", "semantic", "generated", "predicted",
    "template",
]
FACTOR_LABELS = {
    "lexical": "text match", "intent": "intent fit", "source": "source reliability",
    "popularity": "popularity", "poiQuality": "POI quality", "locality": "location context",
    "personalization": "personalization", "diversity": "result diversity",
}

# fixed values: rule profiles (id, label, home city, terms, reason, boost)
PROFILES = [
    ("coffee-loyal", "Coffee loyalist", None,
     ["cafe", "ca phe", "coffee", "highlands", "cong ca phe", "phuc long"],
     "coffee category and cafe-brand preference", 1.0),
    ("danang-traveler", "Da Nang traveler", "Đà Nẵng",
     ["da nang", "khach san", "hotel", "gan bien", "my khe", "san bay"],
     "Da Nang travel and hotel preference", 1.0),
    ("commuter", "Daily commuter", None,
     ["atm", "xang", "cay xang", "tram xang", "san bay", "duong den", "chi duong"],
     "commuter preference for route, fuel, ATM, and airport tasks", 1.0),
]

# fixed values: compact spellings (compact, rewrites, intent, entity kind, value, conf, confidence)
COMPACT_FORMS = [
    ("caphe", ["cà phê", "quán cà phê"], "Category Search", "category", "cà phê", 0.92, 0.91,
     "caphe resembles Vietnamese no-space form of ca phe"),
    ("khachsan", ["khách sạn"], "Category Search", "category", "khách sạn", 0.91, 0.9,
     "khachsan resembles Vietnamese no-space form of khach san"),
    ("benhvien", ["bệnh viện"], "Nearby Search", "category", "bệnh viện", 0.91, 0.89,
     "benhvien resembles Vietnamese no-space form of benh vien"),
    ("nhahang", ["nhà hàng"], "Category Search", "category", "nhà hàng", 0.88, 0.87,
     "nhahang resembles Vietnamese no-space form of nha hang"),
    ("trasua", ["trà sữa"], "Discovery Search", "category", "trà sữa", 0.87, 0.86,
     "trasua resembles Vietnamese no-space form of tra sua"),
    ("cayxang", ["cây xăng"], "Nearby Search", "category", "cây xăng", 0.9, 0.89,
     "cayxang resembles Vietnamese no-space form of cay xang"),
    ("duongden", ["đường đến"], "Navigation", "navigation", "đường đến", 0.9, 0.88,
     "duongden resembles Vietnamese no-space navigation command duong den"),
]
# fixed values: terms a rewrite must keep
PROTECTED_TERMS = [
    "vincom", "vinmec", "vietcombank", "highlands", "noi bai", "ben thanh", "nguyen hue",
]

# fixed values: display labels of place categories and tags
CATEGORY_LABELS = {
    "atm": "ATM", "bai bien": "Bãi biển", "ben xe": "Bến xe", "benh vien": "Bệnh viện",
    "cay xang": "Cây xăng", "cho": "Chợ", "dai hoc": "Đại học", "khach san": "Khách sạn",
    "nha hang": "Nhà hàng", "quan bar": "Quán bar", "quan ca phe": "Quán cà phê",
    "rap chieu phim": "Rạp chiếu phim", "san bay": "Sân bay",
    "trung tam thuong mai": "Trung tâm thương mại",
}
TAG_LABELS = {
    "24 7": "Mở cửa 24/7", "an uong": "Ăn uống", "bien": "Gần biển", "benh vien": "Bệnh viện",
    "bieu tuong": "Địa điểm biểu tượng", "cap cuu": "Có cấp cứu", "cafe": "Cà phê",
    "check in": "Phù hợp check-in", "dat ban": "Có đặt bàn", "dau xe": "Có đậu xe",
    "dia phuong": "Địa phương", "di chuyen": "Di chuyển", "du lich": "Du lịch",
    "fast food": "Fast food", "gan bien": "Gần biển", "gia dinh": "Phù hợp gia đình",
    "giai tri": "Giải trí", "hen ho": "Phù hợp hẹn hò", "ho boi": "Có hồ bơi",
    "khach san": "Khách sạn", "lam viec": "Phù hợp làm việc", "lien tinh": "Liên tỉnh",
    "mo cua khuya": "Mở cửa khuya", "mua sam": "Mua sắm", "ngan hang": "Ngân hàng",
    "nhanh": "Nhanh", "nhom": "Phù hợp nhóm", "o cam": "Có ổ cắm", "phim": "Rạp phim",
    "pho": "Phở", "quoc te": "Quốc tế", "rooftop": "Rooftop", "san bay": "Sân bay",
    "takeaway": "Có takeaway", "tien loi": "Tiện lợi", "toilet": "Có toilet",
    "tre em": "Phù hợp trẻ em", "view dep": "View đẹp", "wifi": "Có Wi-Fi", "xang": "Cây xăng",
    "y te": "Y tế", "yen tinh": "Yên tĩnh",
}
# fixed values: opening hours by category/tag word (words, hours, confidence)
HOURS_RULES = [
    (["24 7", "atm", "cay xang", "benh vien", "cap cuu", "hospital", "gas"], "00:00-24:00", 0.68),
    (["quan ca phe", "cafe", "coffee", "nha hang", "pho", "fast food"], "07:00-22:00", 0.58),
    (["khach san", "hotel", "san bay", "ben xe"], "00:00-24:00", 0.6),
]
# fixed values: hours of other places, and the order in which evidence counts
HOURS_DEFAULT = ("09:00-22:00", 0.48)
EVIDENCE_PRIORITY = [
    "tag:wifi", "tag:gan-bien", "tag:24-7", "tag:yen-tinh", "tag:lam-viec", "quality:",
    "popularity:",
]

# fixed values: word of an expected-type label -> intent, the first word wins
LABEL_INTENTS = [
    ("brand", "Brand Search"), ("category", "Category Search"), ("nearby", "Nearby Search"),
    ("poi", "POI Search"), ("address", "Address Suggestion"), ("location", "Location Search"),
    ("discovery", "Discovery Search"), ("navigation", "Navigation"),
    ("attribute", "Attribute Search"), ("coordinate", "Coordinate Search"),
]
# fixed values: words of a category or query that decide a suggestion's type
NEARBY_CATEGORY_WORDS = ["atm", "benh vien", "cay xang", "tram xang"]
POI_CATEGORY_WORDS = ["san bay", "ben xe", "dai hoc"]
NEARBY_QUERY_WORDS = ["gan day", "gan nhat"]
DISCOVERY_QUERY_WORDS = ["gan bien", "24 7", "hoc bai", "an dem"]
NEARBY_PLACE_WORDS = ["atm", "cay xang", "benh vien"]
# fixed values: patterns of route wishes
ROUTE_MINUTES = "(\\d{1,2})\\s*(?:minute|min|minutes|phut|phút)"
ROUTE_OPEN_NOW = "open now|đang mở|mo cua|mở cửa"
ROUTE_CHARGER = "charger|charging|ev|sạc|sac"
ROUTE_CAFE = "coffee|cafe|cà phê|ca phe"
ROUTE_DETOUR = "detour|minute|min|phút|phut"
