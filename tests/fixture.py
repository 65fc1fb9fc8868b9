"""A miniature catalog of our own rows, in the shapes the jobs expect."""

from prefixlake.sources.catalog import Catalog


def mini_catalog(spark) -> Catalog:
    pois = [
        ("P1", "Highlands Coffee Nguyễn Huệ", "Quán cà phê", "Highlands Coffee", "86 Nguyễn Huệ, Quận 1, TP.HCM", "TP.HCM",
         10.7759, 106.7031, 4.3, 1250, 88, ["wifi", "yên tĩnh", "làm việc", "takeaway"]),
        ("P2", "Chợ Bến Thành", "Chợ", "", "Lê Lợi, Quận 1, TP.HCM", "TP.HCM", 10.772, 106.698, 4.4, 9800, 98,
         ["du lịch", "mua sắm"]),
        ("P3", "ATM Vietcombank Nguyễn Huệ", "ATM", "Vietcombank", "Nguyễn Huệ, Quận 1, TP.HCM", "TP.HCM", 10.7751, 106.7035,
         4.1, 310, 75, ["atm", "24/7"]),
        ("P4", "Bệnh viện Bạch Mai", "Bệnh viện", "", "78 Giải Phóng, Đống Đa, Hà Nội", "Hà Nội", 21.0018, 105.8412, 4.1, 3200, 92,
         ["y tế", "cấp cứu"]),
        ("P5", "Khách sạn Mường Thanh Đà Nẵng", "Khách sạn", "Mường Thanh", "270 Võ Nguyên Giáp, Sơn Trà, Đà Nẵng", "Đà Nẵng",
         16.061, 108.2446, 4.1, 1950, 84, ["khách sạn", "gần biển"]),
        ("P6", "Phở Sáng Lê Lợi", "Nhà hàng", "", "5 Lê Lợi, Quận 1, TP.HCM", "TP.HCM", 10.7731, 106.6999, 4.0, 900, 70, ["phở", "ăn sáng"]),
    ]
    pairs = [
        ("S1", "vin", "Vincom Center", "Brand Search", 0.98, 3355), ("S2", "vin", "Vinmec", "Brand Search", 0.95, 565),
        ("S3", "cafe", "Quán cà phê gần đây", "Category Search", 0.97, 6265),
        ("S4", "cafe", "Highlands Coffee", "Brand Search", 0.94, 1332),
        ("S5", "cafe", "Cà phê mở cửa 24/7", "Discovery Search", 0.88, 8383),
        ("S6", "atm", "ATM Vietcombank gần nhất", "Nearby Search", 0.96, 6182),
        ("S7", "atm", "ATM gần sân bay", "Nearby Search", 0.86, 2806),
        ("S8", "nguyen hue", "Nguyễn Huệ, Quận 1, TP.HCM", "Address Suggestion", 0.95, 8176),
    ]
    popular = [
        ("Q1", "quán cà phê gần đây", "Category Search", 12000, "TP.HCM"), ("Q2", "atm vcb gần nhất", "Nearby Search", 8900, "Đà Nẵng"),
        ("Q3", "chợ bến thành", "POI Search", 15000, "Hà Nội"), ("Q4", "cây xăng gần đây", "Nearby Search", 9800, "Đà Nẵng"),
    ]
    short = [("q1", "Quận 1", "district"), ("ks", "Khách sạn", "category"), ("bv", "Bệnh viện", "category"), ("vcb", "Vietcombank", "brand")]
    cases = [
        ("C1", "vin", "Brand Suggestions", ["Vincom Center", "Vinmec"], "Easy"),
        ("C2", "cafe", "Category Suggestions", ["Quán cà phê gần đây", "Highlands Coffee"], "Medium"),
        ("C3", "benh vien bach", "POI Suggestions", ["Bệnh viện Bạch Mai"], "Hard"),
    ]
    number = lambda rows: [(*row, i) for i, row in enumerate(rows)]
    return Catalog(
        pairs=spark.createDataFrame(
            number(pairs),
            "suggestion_id string, input_prefix string, suggestion_text string, suggestion_type string, score double, query_frequency bigint, row_ord bigint",
        ),
        pois=spark.createDataFrame(
            number(pois),
            "poi_id string, poi_name string, category string, brand string, address string, city string, latitude double, "
            "longitude double, rating double, review_count bigint, popularity_score bigint, tags array<string>, row_ord bigint",
        ),
        popular=spark.createDataFrame(
            number(popular), "query_id string, query_text string, intent_type string, monthly_frequency bigint, region string, row_ord bigint"
        ),
        abbreviations=spark.createDataFrame(number(short), "abbreviation string, expanded_form string, type string, row_ord bigint"),
        eval_cases=spark.createDataFrame(
            cases, "case_id string, input_prefix string, expected_suggestion_type string, expected_top_suggestions array<string>, difficulty string"
        ),
    )
