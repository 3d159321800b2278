from datetime import datetime

import pytest

from jangbu.operators import timestamps

SYSTEMS = [("KR", "Asia/Seoul", "ymd"), ("DE", "Europe/Berlin", "dmy"), ("US", "America/New_York", "mdy"), ("UT", "UTC", "ymd")]
CASES = [
    ("2023/10/29 23:30", "KR", "2023-10-29 14:30"), ("08/07/2025 17:00", "DE", "2025-07-08 15:00"), ("08-03-2024 02:30", "US", "2024-08-03 06:30"), ("24.04.08 12:30", "KR", "2024-04-08 03:30"), ("03/22/24 20:30", "US", "2024-03-23 00:30"),
    ("2025. 8. 3.(일) 오전 10:00", "KR", "2025-08-03 01:00"), ("2023년 7월 14일 24시", "KR", "2023-07-14 15:00"), ("2025년 4월 29일 2시 30분", "KR", "2025-04-28 17:30"), ("2024-09-28 오후 9시", "KR", "2024-09-28 12:00"), ("2024-11-27 오전 12:30", "KR", "2024-11-26 15:30"),
    ("2025-04-30 00:00:00 (UTC+09:00)", "US", "2025-04-29 15:00"), ("2024-08-05 23:00 EDT", "KR", "2024-08-06 03:00"), ("KST 2023.03.13 18:30", "DE", "2023-03-13 09:30"), ("2025년 5월 13일 09:00 (한국시간)", "DE", "2025-05-13 00:00"), ("2023-10-02 23:00:00 Asia/Seoul", "DE", "2023-10-02 14:00"),
    ("20230809T113000Z", "KR", "2023-08-09 11:30"), ("20231029100000", "KR", "2023-10-29 01:00"), ("1701549000", None, "2023-12-02 20:30"), ("1740042000000", "KR", "2025-02-20 09:00"), ("2023-02-24T17:00:00.000+0900", "UT", "2023-02-24 08:00"), ("2025-03-08T17:30:00.000000Z", "KR", "2025-03-08 17:30"),
    ("30.4.2023, 03:00 Uhr", "DE", "2023-04-30 01:00"), ("Jun 12, 2024 7:30 PM", "US", "2024-06-12 23:30"), ("4 Jun 2023 22:00 CEST", "KR", "2023-06-04 20:00"), ("2024-06-15", "KR", "2024-06-14 15:00"), ("2023.05.23. 00:00", "KR", "2023-05-22 15:00"), ("２０２４-０６-１５　１０：００", "UT", "2024-06-15 10:00"),
    ("2024-02-30", "KR", None), ("2024-13-01 10:00", "KR", None), ("2024-01-01 24:30", "KR", None), ("2024-01-01 25:00", "KR", None), ("협의", "KR", None), ("", "KR", None), (None, "KR", None), ("2024-06-15 10:00", None, None), ("2024-06-15 10:00 XYZ", "KR", None), ("2024-06-15 10:00 Mars/Base", "KR", None), ("1" * 60_000, "KR", None),
]


def normalised(spark, cases, policy="standard"):
    df = spark.createDataFrame([(i, t, s, "x", "y") for i, (t, s, *_) in enumerate(cases)], "k int, raw string, collection_system string, instant string, _t string")
    systems = spark.createDataFrame(SYSTEMS, "collection_system string, home_zone string, date_order string")
    out = timestamps.instants(df, "raw", systems, policy)
    assert out.columns == ["k", "raw", "collection_system", "_t", "instant", "time_issue"]
    return {r.k: r for r in out.collect()}


def test_notations(spark):
    got = normalised(spark, CASES)
    for i, (text, system, want) in enumerate(CASES):
        assert got[i].instant == (want and datetime.fromisoformat(want)), (text, system)


@pytest.mark.parametrize(("policy", "twice", "skipped"), [("standard", "2023-10-29 00:30", "2023-03-26 01:30"), ("later", "2023-10-29 01:30", "2023-03-26 01:30"), ("null", None, None)])
def test_daylight_saving(spark, policy, twice, skipped):
    got = normalised(spark, [("29.10.2023 02:30", "DE"), ("26.03.2023 02:30", "DE"), ("29.10.2023 03:30", "DE")], policy)
    assert [got[i].time_issue for i in range(3)] == ["ambiguous", "nonexistent", None]
    assert [got[i].instant for i in range(3)] == [twice and datetime.fromisoformat(twice), skipped and datetime.fromisoformat(skipped), datetime(2023, 10, 29, 2, 30)]


def test_pairs(spark):
    schema = "record_id long, document_id string, collection_system string, bid_deadline_raw string, notice_date string, instant string"
    data = [(1, "a", "KR", "2024-06-15 10:00", None, ""), (2, "a", "UT", "2024-06-15T01:00:00Z", "x", ""), (3, "a", "KR", "2024-06-15 10:00", None, ""), (4, "b", "UT", "2024-06-15T01:00:00Z", None, ""), (5, None, "UT", "2024-06-15 01:00", None, ""), (6, None, "UT", "2024-06-15T01:00Z", None, "")]
    systems = spark.createDataFrame(SYSTEMS, "collection_system string, home_zone string, date_order string")
    df = spark.createDataFrame(data, schema)
    assert sorted(map(tuple, timestamps.same_instant_pairs(df, systems).collect())) == [("bid_deadline_raw", 1, 2), ("bid_deadline_raw", 2, 3)]
    assert timestamps.same_instant_pairs(df.limit(0), systems).count() == 0


def test_gaps_that_are_no_hour(spark):
    """A zone whose clock goes back by half an hour."""
    data = [(1, "2023-04-02 01:45 Australia/Lord_Howe", "x"), (2, "2023-04-02 02:15 Australia/Lord_Howe", "x"), (3, "2023-10-01 02:15 Australia/Lord_Howe", "x"), (4, "2023-04-02 01:20 Australia/Lord_Howe", "x")]
    systems = spark.createDataFrame([("x", "UTC", "ymd")], "collection_system string, home_zone string, date_order string")
    df = spark.createDataFrame(data, "i long, t string, collection_system string")
    issue = {r.i: r.time_issue for r in timestamps.instants(df, "t", systems).collect()}
    assert issue == {1: "ambiguous", 2: None, 3: "nonexistent", 4: None}
    first, later = ({r.i: r.instant for r in timestamps.instants(df, "t", systems, p).collect()} for p in ("standard", "later"))
    assert (later[1] - first[1]).total_seconds() == 1800 and later[2] == first[2]
