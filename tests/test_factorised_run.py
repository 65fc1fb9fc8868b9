"""The suggestion run shares work between requests and drops early what cannot be shown: its results equal a plain run's."""

from pyspark.sql import functions as F

from prefixlake.functions.text import normalize_text
from prefixlake.operators import rank, vectors
from prefixlake.operators.behavior import personalization
from prefixlake.operators.intent import predict_intent
from prefixlake.plans import suggest as plan
from prefixlake.rules import PROFILES

REQUEST = "request_id bigint, q string, city string, lat double, lon double, now string, user_id string, limit int"
EVENT = "user_id string, query string, selected_text string, selected_type string, brand string, category string, city string, occurred_at string, ingest_seq bigint"
SHOWN = ["request_id", "rank", "id", "text", "type", "source", "score", "reason", "personal_reason", "intent_type"]


def _plain_ranking(run, model, events, now):
    """Every candidate of every context scored with its own locality and history, nothing shared and nothing dropped."""
    contexts, vote = run.contexts, vectors.vote_intent(run.neighbours)
    cands = plan.collect_candidates(contexts, model, run.entities, run.neighbours)
    intent = predict_intent(cands, contexts, run.entities, vote)
    placed = rank.locality_context(cands, contexts).join(intent.select("request_id", F.col("type").alias("intent_type")), "request_id")
    placed = placed.withColumn("cand_id", F.concat_ws("/", "src_ord", "id", "row_ord"))
    tags = F.array_join(F.coalesce("poi.tags", F.array().cast("array<string>")), " ")
    hay = normalize_text(F.concat_ws(" ", "text", "type", "reason", "poi.category", "poi.brand", "poi.city", "poi.address", tags))
    known = contexts.filter("coalesce(user_id, '') <> ''")
    personal = personalization(placed.select("request_id", "cand_id", hay.alias("haystack")), known, events, now)
    placed = placed.join(personal.select("request_id", "cand_id", F.col("boost").alias("personal_boost"), F.col("reason").alias("personal_reason")), ["request_id", "cand_id"], "left")
    weighted = rank.score_factors(placed).join(rank.resolve_weights(contexts).select("request_id", "weights", "limit"), "request_id")
    reason = F.when(F.size("context") > 0, F.concat_ws("; ", "reason", F.array_join("context", "; "))).otherwise(F.col("reason"))
    scored = weighted.withColumn("score", rank.weighted_score()).withColumn("norm_text", normalize_text(F.col("text"))).withColumn("reason", reason)
    return rank.top_k(rank.dedupe_text(scored.drop("weights", "context")), F.col("limit"))


def test_shared_and_bounded_work_changes_no_result(spark, model):
    users = [None, "u1", "u2", PROFILES[0][0]]
    places = [(None, None, None), ("TP.HCM", None, None), (None, 10.7751, 106.7035), ("hn", None, None)]
    asked = ["cafe", "vin", "atm", "ca phe gan", "nguyen hue", "", "khach san wifi", "pho"]
    rows, times = [], [None, "2024-05-01T23:30:00", "2024-05-01T07:30:00"]
    for i, q in enumerate(asked):
        for j, place in enumerate(places):
            for k, user in enumerate(users):
                rows.append((len(rows), q, *place, times[(i + j + k) % 3], user, [None, 3, 12][(i + k) % 3]))
    requests = spark.createDataFrame(rows, REQUEST)
    events = spark.createDataFrame(
        [
            ("u1", "cafe", "Highlands Coffee", "Brand Search", "Highlands", "Quán cà phê", "TP.HCM", "2024-04-30T10:00:00", 1),
            ("u1", "atm", "ATM", "POI Search", None, "ATM", None, "2024-04-01T10:00:00", 2),
            ("u2", "vincom", "Vincom Center", "POI Search", "Vincom", None, "Hà Nội", "2024-04-29T10:00:00", 3),
            ("u2", "pho", "Phở", "Category Search", None, "Nhà hàng", None, "bad date", 4),
        ],
        EVENT,
    )
    now = F.lit("2024-05-01 00:00:00").cast("timestamp")
    run = plan.run(requests, model, events=events, now=now, rewrite=False)
    got = sorted(map(str, run.ranked.select(*SHOWN).collect()))
    want = sorted(map(str, _plain_ranking(run, model, events, now).select(*SHOWN).collect()))
    assert run.contexts.count() == len(rows) and len(got) > 300
    assert any("Local learner" in r for r in got) and got == want
    assert run.contexts.select("view").distinct().count() < len(rows) / 2
