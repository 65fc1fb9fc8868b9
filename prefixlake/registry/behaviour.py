"""Registered queries of personalization, streams and alias memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefixlake.functions.text import normalize_text
from prefixlake.operators import aliases as L
from prefixlake.operators import behavior as H
from prefixlake.registry import duck as d
from prefixlake.registry.core import inp, query, table
from prefixlake.session import work_folder
from prefixlake.sources.tables import NOW
from prefixlake.streaming import events as stream

c = F.col
AGE = f"greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(occurred_at)) / 86400000000.0::DOUBLE"


def now():
    return F.lit(NOW).cast("timestamp")


@query("h1_recency_weight", d.with_(d.inputs("events"), f"SELECT ingest_seq, round(exp(-({AGE}) / 14), 6) AS weight FROM in_events"))
def h1(spark, sf):
    return inp(spark, sf, "events").select("ingest_seq", F.round(H.recency_weight(c("occurred_at"), now()), 6).alias("weight"))


TERMS = d.inputs("events") + [
    "et0 AS (SELECT user_id, city, ingest_seq, occurred_at, unnest([query, selected_text, selected_type, brand, category, city]) AS label, unnest([0, 1, 2, 3, 4, 5]) AS slot FROM in_events)",
    f"et AS MATERIALIZED (SELECT *, {d.norm('label')} AS term FROM et0 WHERE coalesce(label, '') <> '')",
]


@query("h2_event_terms", d.with_(TERMS, "SELECT ingest_seq, slot, term FROM et WHERE length(term) >= 3"))
def h2(spark, sf):
    return H.event_terms(inp(spark, sf, "events")).select("ingest_seq", "slot", "term")


HAY_SQL = d.norm("(poi_name || ' ' || category || ' ' || brand || ' ' || city)")
BKEY = lambda x: f"CASE WHEN {d.has_phrase(x, chr(39) + 'ho chi minh' + chr(39))} THEN 'tp.hcm' ELSE {d.city_key(x)} END"
BOOST = TERMS + d.inputs("pois") + [
    f"rq AS MATERIALIZED (SELECT row_ord AS request_id, CAST(row_ord % 150 AS VARCHAR) AS user_id, CASE WHEN row_ord % 3 = 0 THEN city END AS city, {HAY_SQL} AS hay FROM in_pois)",
    f"rk AS MATERIALIZED (SELECT *, CASE WHEN city IS NULL THEN '' ELSE {BKEY(d.norm('city'))} END AS scope FROM rq)",
    f"ev AS (SELECT *, CASE WHEN city IS NOT NULL THEN {BKEY(d.norm('city'))} END AS ek FROM in_events)",
    "sc AS (SELECT DISTINCT user_id, scope FROM rk)",
    "rc AS MATERIALIZED (SELECT sc.user_id, scope, ingest_seq FROM sc JOIN ev USING (user_id) WHERE scope = '' OR ek IS NULL OR ek = scope QUALIFY row_number() OVER (PARTITION BY sc.user_id, scope ORDER BY ingest_seq DESC) <= 80)",
    f"ut AS MATERIALIZED (SELECT rc.user_id, scope, term, sum(exp(-({AGE}) / 14)) AS w FROM rc JOIN et USING (ingest_seq) WHERE length(term) >= 3 GROUP BY ALL)",
    "hb AS MATERIALIZED (SELECT request_id, sum(w) AS total, count(*) AS n FROM rk JOIN ut USING (user_id, scope) WHERE contains(hay, term) GROUP BY request_id)",
    "bo AS MATERIALIZED (SELECT request_id, total, least(1.0::DOUBLE, 0.36::DOUBLE + least(0.34::DOUBLE, ln(1 + total) * 0.22::DOUBLE) + least(0.24::DOUBLE, n * 0.06::DOUBLE)) AS boost FROM hb)",
]


def _rows(spark, sf):
    """Every place as the candidate of one request by one user."""
    hay = normalize_text(F.concat_ws(" ", "poi_name", "category", "brand", "city"))
    return inp(spark, sf, "pois").select(
        c("row_ord").alias("request_id"), (c("row_ord") % 150).cast("string").alias("user_id"), F.when(c("row_ord") % 3 == 0, c("city")).alias("city"),
        c("poi_id").alias("cand_id"), hay.alias("haystack"), c("poi_name").alias("text"), (c("popularity_score") / 200.0).alias("score"), F.lit(0.0).alias("personalization"),
    )


@query("h3_behavior_boost", d.with_(BOOST, "SELECT request_id, round(boost, 6) AS boost, round(total, 6) AS total_weight FROM bo"))
def h3(spark, sf):
    rows = _rows(spark, sf)
    out = H.behavior_boost(rows.select("request_id", "cand_id", "haystack"), rows, inp(spark, sf, "events"), now())
    return out.select("request_id", F.round("behavior_boost", 6).alias("boost"), F.round("total_weight", 6).alias("total_weight"))


PROFILE_SQL = (
    f"CASE request_id % 4 WHEN 0 THEN CASE WHEN {d.has_any('hay', ['cafe', 'ca phe', 'coffee', 'highlands', 'cong ca phe', 'phuc long'])} THEN 1.0::DOUBLE END "
    f"WHEN 1 THEN CASE WHEN (city IS NULL OR {d.city_key(d.norm('city'))} = 'da nang') AND {d.has_any('hay', ['da nang', 'khach san', 'hotel', 'gan bien', 'my khe', 'san bay'])} THEN 1.0::DOUBLE END "
    f"WHEN 2 THEN CASE WHEN {d.has_any('hay', ['atm', 'xang', 'cay xang', 'tram xang', 'san bay', 'duong den', 'chi duong'])} THEN 1.0::DOUBLE END END"
)


def _profiled(spark, sf):
    who = F.when(c("request_id") % 4 == 0, "coffee-loyal").when(c("request_id") % 4 == 1, "danang-traveler").when(c("request_id") % 4 == 2, "commuter").otherwise(c("user_id"))
    return _rows(spark, sf).withColumn("user_id", who)


@query("h4_profile_boost", d.with_(BOOST, f"SELECT request_id, b AS boost FROM (SELECT request_id, {PROFILE_SQL} AS b FROM rq) WHERE b IS NOT NULL"))
def h4(spark, sf):
    rows = _profiled(spark, sf)
    return H.profile_boost(rows.select("request_id", "cand_id", "haystack"), rows.select("request_id", "user_id", "city")).select("request_id", c("profile_boost").alias("boost"))


@query(
    "h5_personalization",
    d.with_(BOOST, f"SELECT request_id, round(greatest(coalesce(p, 0), coalesce(b, 0)), 6) AS boost FROM (SELECT rq.request_id, {PROFILE_SQL.replace('request_id %', 'rq.request_id %')} AS p, CASE WHEN rq.request_id % 4 = 3 THEN bo.boost END AS b FROM rq LEFT JOIN bo USING (request_id)) WHERE p IS NOT NULL OR b IS NOT NULL"),
)
def h5(spark, sf):
    rows = _profiled(spark, sf)
    return H.personalization(rows.select("request_id", "cand_id", "haystack"), rows.select("request_id", "user_id", "city"), inp(spark, sf, "events"), now()).select("request_id", F.round("boost", 6).alias("boost"))


@query(
    "h6_rerank_with_behavior",
    d.with_(
        BOOST + [f"s AS (SELECT rq.request_id, row_ord % 150 AS u, poi_id, poi_name, popularity_score / 200.0::DOUBLE AS score, bo.boost FROM in_pois JOIN rq ON rq.request_id = row_ord LEFT JOIN bo USING (request_id))",
                 f"m AS (SELECT *, CASE WHEN boost IS NULL THEN score ELSE {d.clamp01(d.round3('score + least(0.2::DOUBLE, boost * 0.24::DOUBLE)'))} END AS s2 FROM s)"],
        "SELECT request_id, poi_id AS cand_id, s2 AS score, row_number() OVER (PARTITION BY request_id ORDER BY s2 DESC) AS rank FROM m",
    ),
)
def h6(spark, sf):
    rows = _rows(spark, sf)
    out = H.rerank_with_behavior(rows.drop("user_id", "city"), rows.select("request_id", "user_id", "city"), inp(spark, sf, "events"), now())
    return out.select("request_id", "cand_id", "score", "rank")


@query("h7_latest_events", "SELECT event_id AS ingest_seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 120")
def h7(spark, sf):
    return H.latest_events(inp(spark, sf, "events")).select("ingest_seq")


def _folder(spark) -> str:
    return work_folder(spark, "stream")


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return spark, raw


@query("h7_ingest_events", "SELECT event_id, user_id, event_type FROM events")
def h7b(spark, sf):
    path, mark = _folder(spark), _folder(spark)
    _, raw = _event_stream(spark, sf)
    stream.ingest_events(raw, path, mark).awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


@query(
    "h7_retained_events",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS user_rank FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 5000) QUALIFY user_rank <= 120",
)
def h7c(spark, sf):
    source, path, mark = _folder(spark), _folder(spark), _folder(spark)
    events = table(spark, sf, "events").withColumn("ingest_seq", c("event_id"))
    # several files, each with old and new events: one micro-batch a file
    events.repartition(4, "event_id").write.option("maxRecordsPerFile", 1_000_000).parquet(source)
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    done = stream.retain_events(arriving, path, mark)
    done.awaitTermination()
    last = max(p["batchId"] for p in done.recentProgress)
    kept = spark.read.schema(events.schema).parquet(f"{path}/v={last}")
    return stream.latest_events(kept).select("event_id", "user_id", c("user_rank").cast("bigint").alias("user_rank"))


@query(
    "h8_live_profiles",
    d.with_(
        TERMS + ["rc AS (SELECT ingest_seq FROM in_events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ingest_seq DESC) <= 80)"],
        f"SELECT user_id AS user_key, term, round(sum(exp(-({AGE}) / 14)), 6) AS weight FROM et JOIN rc USING (ingest_seq) WHERE length(term) >= 3 GROUP BY user_id, term",
    ),
)
def h8(spark, sf):
    from prefixlake.sources.tables import INPUT_SQL

    path, mark = _folder(spark), _folder(spark)
    _, raw = _event_stream(spark, sf)
    shaped = spark.sql(INPUT_SQL["events"].replace("VARCHAR(20)", "STRING").replace("VARCHAR(9)", "STRING"), events=raw)
    now_us = int(spark.sql(f"SELECT unix_micros(TIMESTAMP '{NOW}')").first()[0])
    live = stream.live_profiles(shaped, now_us)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    live.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(path)
    newest = rows.groupBy("user_key").agg(F.max("version").alias("version"))
    return rows.join(newest, ["user_key", "version"]).select("user_key", "term", F.round("weight", 6).alias("weight"))


OBS = (
    "ob AS (SELECT event_type || ' ' || CAST(user_id % 40 AS VARCHAR) AS raw_query, 'k' || json_extract_string(props, '$.k') AS rewrite, event_type AS intent, "
    "CASE WHEN user_id % 2 = 0 THEN 'user' END AS scope, value > 50 AS accepted, event_id AS seq, ts FROM events)"
)
OBS_KEYED = [OBS, f"ok AS (SELECT *, coalesce(scope, 'user') AS sc, {d.norm('raw_query')} AS rn, {d.norm('rewrite')} AS wn FROM ob)"]
FOLDED = OBS_KEYED + [
    "fo AS (SELECT sc AS scope, rn AS raw_norm, wn AS rewrite_norm, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS r, arg_max(intent, seq) AS intent FROM ok WHERE rn <> '' AND wn <> '' AND rn <> wn GROUP BY ALL)"
]
STATUS = "CASE WHEN r > a THEN 'rejected' WHEN a >= 3 AND a >= r * 2 THEN 'approved' ELSE 'candidate' END"


def alias_observations(spark, sf, raw=None):
    events = table(spark, sf, "events") if raw is None else raw
    return events.select(
        F.concat_ws(" ", "event_type", (c("user_id") % 40).cast("string")).alias("raw_query"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("rewrite"),
        c("event_type").alias("intent"), F.when(c("user_id") % 2 == 0, F.lit("user")).alias("scope"), (c("value") > 50).alias("accepted"), c("event_id").alias("seq"), c("ts").alias("seen_at"),
    )


def _memory_rows(df):
    return df.select("scope", "raw_norm", "rewrite_norm", "accepted_count", "rejected_count", "status", "intent")


L_SQL = d.with_(FOLDED, f"SELECT scope, raw_norm, rewrite_norm, a AS accepted_count, r AS rejected_count, {STATUS} AS status, intent FROM fo")


@query("l1_upsert_aliases", L_SQL)
def l1(spark, sf):
    return _memory_rows(L.upsert_aliases(L.empty_memory(spark), alias_observations(spark, sf)))


@query("l2_alias_status", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + STATUS + " AS status FROM (SELECT *, CAST(l_quantity AS BIGINT) % 9 AS a, l_suppkey % 5 AS r FROM lineitem)")
def l2(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (c("l_quantity").cast("bigint") % 9).alias("a"), (c("l_suppkey") % 5).alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", L.alias_status(c("a"), c("r")).alias("status"))


@query("l3_alias_key", d.with_(OBS_KEYED, "SELECT seq, sc AS scope, rn AS raw_norm, wn AS rewrite_norm FROM ok WHERE rn <> '' AND wn <> '' AND rn <> wn"))
def l3(spark, sf):
    return L.alias_key(alias_observations(spark, sf)).select("seq", "scope", "raw_norm", "rewrite_norm")


@query(
    "l4_proposals_to_observations",
    "SELECT event_id AS seq, event_type AS raw_query, 'k' || json_extract_string(props, '$.k') AS rewrite, CASE WHEN user_id % 2 = 0 THEN 'user' ELSE 'global-candidate' END AS scope FROM events",
)
def l4(spark, sf):
    proposals = table(spark, sf, "events").select(
        c("event_type").alias("query"), F.array(F.concat(F.lit("k"), F.get_json_object("props", "$.k")), F.lit("other")).alias("rewrites"), c("event_type").alias("intent"),
        F.when(c("user_id") % 2 == 0, "alias-memory").otherwise("agent").alias("source"), c("event_id").alias("seq"), c("ts").alias("seen_at"),
    )
    return L.proposals_to_observations(proposals).select("seq", "raw_query", "rewrite", "scope")


@query("l5_stream_upsert", L_SQL)
def l5(spark, sf):
    path, mark = _folder(spark), _folder(spark)
    _, raw = _event_stream(spark, sf)
    done = stream.stream_upsert(alias_observations(spark, sf, raw), path, mark)
    done.awaitTermination()
    last = max(p["batchId"] for p in done.recentProgress)
    return _memory_rows(spark.read.schema(L.MEMORY).parquet(f"{path}/v={last}"))
