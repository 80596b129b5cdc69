"""The feed as a stream, and the last versions of keys, both stopped and started again."""

import datetime as dt
import glob
import http.server
import os
import shutil
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F
from quillwork.plans import ingest
from quillwork.sources import atom, tables
from quillwork.streaming import incremental, latest


@pytest.fixture
def feed():
    """A server of five entries for each category and window; it notes what it is asked for."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            category, start, size = q["search_query"].split()[0][4:], int(q["start"]), int(q["max_results"])
            first = q["search_query"].split("[")[1][:8]
            asked.append((category, first, start))
            entries = "".join(f"<entry><id>http://arxiv.org/abs/{first}.{category}{k}v1</id><title>T{k}</title><summary>s</summary><published>2026-01-01T00:00:00Z</published><updated>2026-01-01T00:00:00Z</updated><author><name>A{k % 2}</name></author><category term='{category}'/></entry>" for k in range(start, min(5, start + size)))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"<feed xmlns='http://www.w3.org/2005/Atom'>{entries}</feed>".encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/q", asked
    server.shutdown()


def test_a_stopped_feed_lands_every_page_once(spark, tmp_path, feed):
    url, asked = feed
    spark.dataSource.register(atom.FeedSource)
    store = tables.Versions(spark, f"{tmp_path}/s")
    ingest.create(store)
    stamp, done, broken = F.lit(dt.datetime(2026, 2, 1)), [], [True]
    stream = lambda: spark.readStream.format("atom-feed").options(url=url, categories="cs.AI,cs.CL", windows="2026-01-01:2026-01-07,2026-01-08:2026-01-14", pageSize="2", quota="4", gap="0").load()

    def apply(df, n):
        pages = [(r.category, r.win_start, r.offset) for r in df.select("category", "win_start", "offset").collect()]
        if broken and len(done) == 3:
            broken.clear()
            raise OSError("down")
        with store.begin() as draft:
            ingest.merge(draft, atom.parse(df), stamp)
            draft.publish(keep=2)
        done.extend(pages)

    with pytest.raises(Exception, match="down"):
        incremental.until_idle(stream(), apply, f"{tmp_path}/c")
    assert len(done) == 3
    incremental.until_idle(stream(), apply, f"{tmp_path}/c")
    want = [(c, w, o) for w in ("2026-01-01", "2026-01-08") for c in ("cs.AI", "cs.CL") for o in (0, 2)]
    assert done == want  # the quota of four ends each window after two pages
    assert store.read()["papers"].count() == 16 and set(asked) == {(c, w.replace("-", ""), o) for c, w, o in want}
    incremental.until_idle(stream(), apply, f"{tmp_path}/c")
    assert done == want


def test_last_versions_of_a_shuffled_stream(spark, small, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.read.parquet(f"{small}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value")
    for k in range(4):  # by days, shuffled inside, with repeats of earlier ones
        part = rows.where(f"event_id % 4 = {k}").unionAll(rows.where("event_id % 10 = 1"))
        part.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    held, sizes = {}, []

    def apply(df, n):
        for r in df.collect():
            assert r.user_id not in held or (r.ts, r.event_id) > (held[r.user_id].ts, held[r.user_id].event_id)
            held[r.user_id] = r

    for folder in ("0", "*"):
        held.clear()
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/{folder}")
        query = latest.latest_stream(stream, "user_id", "ts", ("event_id",), "60 days").writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", f"{tmp_path}/c{len(folder)}{folder == '*'}").start()
        try:
            query.processAllAvailable()
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        finally:
            query.stop()
    want = {r.user_id: (r.ts, r.event_id, r.event_type, r.value) for r in incremental.latest_version(rows.select("user_id", F.struct("ts", "event_id").alias("v"), "ts", "event_id", "event_type", "value"), "user_id", "v").collect()}
    assert {k: (r.ts, r.event_id, r.event_type, r.value) for k, r in held.items()} == want
    assert max(sizes) <= 4 * len(want)


def test_state_goes_when_the_watermark_has_passed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    for k in range(6):
        spark.createDataFrame([(10 * k + j, day(10 * k), k) for j in range(10)] + [(0, day(0), 99), (None, day(1), 1)], "k long, v timestamp, x int").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen, states = [], []
    for folders in ("[0-2]", "*"):  # stopped, and started again with more files on the same checkpoint
        os.makedirs(f"{tmp_path}/s", exist_ok=True)
        for path in glob.glob(f"{tmp_path}/in/{folders}/*.parquet"):
            os.path.exists(f"{tmp_path}/s/{os.path.basename(path)}") or shutil.copy(path, f"{tmp_path}/s/")
        stream = spark.readStream.schema("k long, v timestamp, x int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s")
        query = latest.latest_stream(stream, "k", "v", ("x",), "1 day").writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/c").start()
        try:
            query.processAllAvailable()
            states += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        finally:
            query.stop()
    assert {r[0] for r in seen} <= set(range(60)) and len(seen) >= 20
    assert states[-1] < 60
