"""The feeds as streams: slots, pages by cursor, retries, failures, warm start and polls, from recorded answers."""

import datetime
import json
import time

import pytest
from test_sources import message

from vialens.sources import feeds, paged

BASE = 1800000000  # a whole minute


def page(minute, k, rows, last=True, second=50):
    name = paged.minute_name(minute)
    at = datetime.datetime.fromtimestamp(minute + second, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    data = [{"id_veiculo": f"v{minute - BASE}-{k}-{i}", "fornecedor": "sonda", "latitude": -22.9, "longitude": -43.4, "datetime": at, "datetime_servidor": at} for i in range(rows)]
    return name, json.dumps({"minuto_utc": name, "data": data, "next_cursor": None if last else str(k + 1)})


def record(folder, minute, pages, attempt=None):
    for k, rows in enumerate(pages):
        name, body = page(minute, k, rows, k == len(pages) - 1)
        (folder / f"{name.replace(':', '')}.{k}{'' if attempt is None else f'.{attempt}'}.json").write_text(body)


def test_slots():
    assert [paged.slot_at(BASE + s) - paged.slot_at(BASE) for s in (0, 7.9, 8, 18, 53, 60, 68)] == [0, 0, 1, 2, 5, 5, 6]
    first = paged.slot_at(BASE)
    assert paged.reads(first, first) == [] and paged.reads(first, first + 1) == [(BASE, False)]
    assert paged.reads(first + 1, first + 2) == [(BASE - 60, True)]
    assert paged.reads(first, first + 13) == [(BASE - 60, True), (BASE, True), (BASE + 60, True), (BASE + 120, False)]
    seen = [r for k in range(40) for r in paged.reads(first + k, first + k + 1)]
    assert [m for m, closed in seen if closed] == [BASE + 60 * k for k in range(-1, 7)]


def read(folder, part, **options):
    return list(paged.MinuteBatch({"path": str(folder), "from": 0, "to": 0, "typical": 10, "retry_s": 0, **options}).read(part))


def test_pages_and_retries(tmp_path):
    record(tmp_path, BASE, [4, 3, 2])
    rows = read(tmp_path, paged.Minute(BASE, True, False))
    assert [(r[1], r[3], r[4], r[6]) for r in rows] == [(0, 4, True, None), (1, 3, True, None), (2, 2, True, None)]
    record(tmp_path, BASE + 60, [1] * 12)
    assert len(read(tmp_path, paged.Minute(BASE + 60, True, False))) == paged.MAX_PAGES
    for attempt, pages in enumerate(([1], [2], [9])):  # a stub twice, whole at the third try
        record(tmp_path, BASE + 120, pages, attempt)
    assert [(r[3], r[4]) for r in read(tmp_path, paged.Minute(BASE + 120, True, False))] == [(9, True)]
    record(tmp_path, BASE + 180, [2])  # a stub for good: taken after the retries, flagged
    assert [(r[3], r[4], r[6]) for r in read(tmp_path, paged.Minute(BASE + 180, True, False))] == [(2, False, None)]


def test_a_page_that_fails(tmp_path):
    """The first page comes as a stub, its second page fails at the fourth try: the minute is an error, not half of it."""
    name = paged.minute_name(BASE).replace(":", "")
    record(tmp_path, BASE, [1, 1])
    (tmp_path / f"{name}.1.3.err").write_text("answer 503")
    assert [(r[1], r[2], r[4], r[6]) for r in read(tmp_path, paged.Minute(BASE, True, False))] == [(-1, None, False, "OSError: answer 503")]
    (tmp_path / f"{paged.minute_name(BASE + 60).replace(':', '')}.0.json").write_text("{cut off")
    assert read(tmp_path, paged.Minute(BASE + 60, True, False))[0][6].startswith("JSONDecodeError")
    assert "no page" in read(tmp_path, paged.Minute(BASE + 120, True, False))[0][6]


def until(query, done, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not done():
        assert query.exception() is None
        time.sleep(0.3)
    query.stop()


def test_stream_after_a_warm_start_is_one_batch(spark, tmp_path):
    spark.dataSource.register(paged.PagedMinutes)
    answers, clock = tmp_path / "answers", tmp_path / "clock"
    answers.mkdir()
    for k in range(8):
        if k != 6:  # one minute fails
            record(answers, BASE + 60 * k, [3, 2] if k % 2 else [6])
    (answers / "open.0.json").write_text(page(BASE + 1000, 0, 0)[1])
    options = {"path": f"file://{answers}", "typical": "5", "retry_s": "0"}
    warm, goes_on = paged.warm_start(spark, options, BASE + 250, 3)  # minutes 1 to 3
    assert {(r["minute"], r["warming"]) for r in warm.collect()} == {(paged.minute_name(BASE + 60 * k), True) for k in (1, 2, 3)}
    clock.write_text(str(BASE + 250))
    counts, seen = paged.FetchCounts(), []
    spark.streams.addListener(counts)
    try:
        stream = paged.observed(spark.readStream.format("minutes_paged").options(**goes_on, clock=f"file://{clock}").load(), "minutes")
        q = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r["minute"], r["page"], r["value"]) for r in df.where("rows > 0").collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        time.sleep(4)
        clock.write_text(str(BASE + 500))  # the closed minutes 4 to 7 come up
        until(q, lambda: {m for m, *_ in seen} >= {paged.minute_name(BASE + 60 * k) for k in (4, 5, 7)} and counts.counts.get("minutes", {}).get("failed"))
        time.sleep(1)
    finally:
        spark.streams.removeListener(counts)
    whole = spark.read.format("minutes_paged").options(**options, **{"from": BASE + 60, "to": BASE + 480}).load()
    both = [(r["minute"], r["page"], r["value"]) for r in warm.collect()] + seen
    assert sorted(both) == sorted((r["minute"], r["page"], r["value"]) for r in whole.where("error is null").collect())
    assert counts.counts["minutes"]["failed"] == 1 and counts.counts["minutes"]["incomplete"] == 0
    fixes = feeds.fixes_of_pages(spark.createDataFrame(both, "minute string, page int, value string"))
    assert fixes.select("vehicle").distinct().count() == sum(5 if k % 2 else 6 for k in (1, 2, 3, 4, 5, 7))


def test_polls_of_the_binary_feed(spark, tmp_path):
    spark.dataSource.register(paged.PolledFeed)
    (tmp_path / "feed").mkdir()
    n = BASE // 30
    (tmp_path / f"feed/{n + 3}.pb").write_bytes(message())
    clock, counts, seen = tmp_path / "clock", paged.FetchCounts(), []
    clock.write_text(str(BASE))
    spark.streams.addListener(counts)
    try:
        rows = paged.observed(spark.readStream.format("feed_polled").options(path=f"file://{tmp_path}/feed", clock=f"file://{clock}").load(), "feed")
        q = feeds.fixes_of_messages(rows).writeStream.foreachBatch(lambda df, _: seen.extend(r["vehicle"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        time.sleep(4)
        clock.write_text(str(BASE + 90))  # two polls were missed, the newest is made
        until(q, lambda: seen)
    finally:
        spark.streams.removeListener(counts)
    assert seen == ["901"] and counts.counts["feed"]["failed"] == 0
    reader = paged.PollStream({"path": str(tmp_path / "feed")})
    assert [(r[0], r[2][:17]) for r in reader.read(paged.Poll(1, 30))] == [(None, "FileNotFoundError")]
    with pytest.raises(KeyError):
        paged.PollStream({})
