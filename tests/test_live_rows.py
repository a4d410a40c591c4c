from datetime import datetime, timedelta

from freshet.plans import streams


def test_expiry_and_reappearance(spark, monkeypatch):
    """Seen again while live: no new row. Seen again once the watermark has passed its expiry: live anew."""
    monkeypatch.setattr(streams, "LANDED_FILES", 1)
    start = datetime(2020, 1, 1)
    seen = [("a", 0), ("a", 5), ("b", 40), ("b", 44), ("c", 80), ("a", 120), ("a", 122)]
    rows = spark.createDataFrame([(i, start + timedelta(days=d)) for i, d in seen], "id string, posted_at timestamp")
    root = streams.workdir(spark)
    streams.land_in_order(rows, f"{root}/landed")
    live = streams.live_of_landed(spark, root)
    assert sorted((r["id"], (r["posted_at"] - start).days) for r in live.collect()) == [("a", 0), ("a", 120), ("b", 40), ("c", 80)]
