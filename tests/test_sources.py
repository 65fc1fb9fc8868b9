"""Files read in many byte ranges, and events kept over several batches."""

import csv
import io
import json
import random
from datetime import datetime

import pytest

from prefixlake.operators.aliases import MEMORY
from prefixlake.session import work_folder
from prefixlake.sources import readers
from prefixlake.sources.records import text_records
from prefixlake.streaming.events import latest_events, retain_events, retained, stream_upsert


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "48b")
    yield
    spark.conf.set(key, before)


def _write(spark, tmp_path, **files: str) -> str:
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    return str(tmp_path)


def _rows(seed: int, n: int) -> list[list[str]]:
    rng = random.Random(seed)
    parts = ["a", "é", ",", '"', "\n", "\n\n", "phở bò", " ", "long " * 30]
    return [[str(i), "".join(rng.choices(parts, k=rng.randrange(6))), rng.choice(["", "x", "y\nz"])] for i in range(n)]


def _text(rows: list[list[str]], end: str = "\n") -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_in_many_ranges_equals_the_whole_read(spark, small_ranges, tmp_path, end):
    first, second = _rows(1, 60), _rows(2, 25)
    head = ["id", "name", "kind"]
    path = _write(spark, tmp_path, a="﻿" + _text([head, *first], end), b=_text([head, *second], end))
    assert text_records(spark, path).select("file").count() == 2 + len(first) + len(second)
    got = [tuple(r) for r in readers.read_csv(spark, path, ["kind", "id", "name"]).orderBy("row_ord").select("id", "name", "kind").collect()]
    assert got == [tuple(x.strip(" ") for x in row) for row in first + second]


def test_a_record_may_cover_several_ranges(spark, small_ranges, tmp_path):
    body = "\n".join(f"line {i}" for i in range(100))
    path = _write(spark, tmp_path, a=_text([["id", "name"], ["1", body], ["2", "short"], ["3", body]]))
    got = {r["id"]: r["name"] for r in readers.read_csv(spark, path, ["id", "name"]).collect()}
    assert got == {"1": body, "2": "short", "3": body}
    whole = text_records(spark, path).collect()
    assert sorted(r["record"] for r in whole) == [0, 1, 2, 3]


def test_blank_rows_missing_cells_and_headers(spark, small_ranges, tmp_path):
    path = _write(spark, tmp_path, a='\n , \n﻿ id , "name",kind\n1,a\n\n , ,\n"2", "" , k \n3')
    got = sorted(tuple(r) for r in readers.read_csv(spark, path, ["id", "name", "kind"]).drop("row_ord").collect())
    assert got == [("1", "a", ""), ("2", "", "k"), ("3", "", "")]
    with pytest.raises(ValueError, match="missing required column.*: colour, size"):
        readers.read_csv(spark, path, ["id", "colour", "size"])
    other = _write(spark, tmp_path, b="id,name\n9,z\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, other, ["id"])


def test_a_file_without_rows(spark, tmp_path):
    assert readers.read_csv(spark, _write(spark, tmp_path, a="id,name\n"), ["id", "name"]).count() == 0


def test_alias_memory_leaves_out_malformed_records(spark, tmp_path):
    fine = {
        "rawQuery": "cf", "rewrite": "cafe", "intent": "POI Search", "entities": [{"kind": "brand", "value": "x", "source": "rule", "confidence": 0.5}], "scope": "user", "source": "agent",
        "acceptedCount": 3, "rejectedCount": 0, "status": "approved", "lastSeenAt": "2024-01-01T00:00:00Z",
    }
    bad = [{**fine, "scope": "world"}, {**fine, "source": "x"}, {**fine, "status": None}, {k: v for k, v in fine.items() if k != "rewrite"}]
    (tmp_path / "memory.json").write_text(json.dumps([fine, *bad, {**fine, "rewrite": "coffee", "entities": []}], indent=2))
    assert sorted(r["rewrite"] for r in readers.read_alias_memory(spark, str(tmp_path)).collect()) == ["cafe", "coffee"]


EVENT = "event_id long, user_id string, ingest_seq long"


def _stream(spark, folder: str, batches: list[list[tuple]], kind: str = EVENT):
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def test_retained_is_a_top_n_over_all_partitions(spark):
    rows = [(i, f"u{i % 3}", (i * 7919) % 5003) for i in range(5003)]
    events = spark.createDataFrame(rows, EVENT).repartition(150)
    assert sorted(r["ingest_seq"] for r in retained(events, 40).collect()) == list(range(4963, 5003))
    assert retained(events, 9000).count() == 5003 and retained(events.filter("false"), 5).count() == 0


def test_both_limits_over_late_and_repeated_batches(spark):
    folder, path, mark = (work_folder(spark, n) for n in ("in", "kept", "mark"))
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), i) for i in range(120)]
    late = sorted(rows, key=lambda r: (r[0] % 4, -r[0]))
    done = retain_events(_stream(spark, folder, [late[i : i + 30] for i in range(0, 120, 30)]), path, mark, n=50)
    done.awaitTermination()
    last = max(p["batchId"] for p in done.recentProgress)
    assert last == 3
    kept = spark.read.schema(EVENT).parquet(f"{path}/v={last}")
    assert sorted(r["event_id"] for r in kept.collect()) == list(range(70, 120))
    got = {(r["user_id"], r["user_rank"]): r["event_id"] for r in latest_events(kept, 8).collect()}
    want = {(u, i + 1): e for u in "ab" for i, e in enumerate([r[0] for r in reversed(rows[70:]) if r[1] == u][:8])}
    assert got == want
    versions = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = {s.getPath().getName() for s in versions.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(versions)}
    assert names == {"v=2", "v=3"}


def test_alias_memory_of_a_stream_keeps_two_versions(spark):
    kind = "raw_query string, rewrite string, intent string, scope string, accepted boolean, seq long, seen_at timestamp"
    folder, path, mark = (work_folder(spark, n) for n in ("in", "memory", "mark"))
    batches = [[("cf", "cafe", "x", "user", True, i, datetime(2024, 1, 1 + i))] for i in range(4)]
    stream_upsert(_stream(spark, folder, batches, kind), path, mark).awaitTermination()
    row = spark.read.schema(MEMORY).parquet(f"{path}/v=3").first()
    assert (row["accepted_count"], row["status"]) == (4, "approved")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert {s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)} == {"v=2", "v=3"}
