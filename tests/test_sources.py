import base64
import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer

import pytest

from wattloom.schema import FEATURES, HOURLY, SchemaError, available, select_features, validate
from wattloom.sources import readers as R
from wattloom.sources.chunked import ChunkedJson, date_ranges
from wattloom.sources.metrics import log_metrics, read_metrics
from wattloom.streaming.hourly import hourly_means


def test_csv_series(spark, tmp_path):
    (tmp_path / "SOLAR.csv").write_text("date;Production\n2024-01-01 00:00:00;1.5\n2024-01-01 01:00:00;\n")
    (tmp_path / "WIND.csv").write_text("date;Production\n2024-01-01 00:00:00;x\n")
    got = R.read_series(spark, str(tmp_path / "SOLAR.csv")).orderBy("timestamp").collect()
    assert [tuple(r) for r in got] == [(datetime(2024, 1, 1), 1.5), (datetime(2024, 1, 1, 1), None)]
    folder = R.read_series_folder(spark, str(tmp_path)).collect()
    assert sorted((r["series"], r["value"] is None) for r in folder) == [("SOLAR", False), ("SOLAR", True), ("WIND", True)]


def test_json_offsets(spark):
    doc = {"actual_generations_per_production_type": [{"production_type": "SOLAR", "values": [{"start_date": "2024-03-31T02:00:00+02:00", "value": 1.0}, {"start_date": "", "value": 2.0}, {"start_date": "2024-03-31T03:00:00+02:00"}]}]}
    got = R.parse_generation(spark.createDataFrame([(json.dumps(doc),), ("{}",), (None,)], "value string")).collect()
    assert [tuple(r) for r in got] == [(datetime(2024, 3, 31), "SOLAR", 1.0)]
    use = {"short_term": [{"values": [{"start_date": "2024-03-31T02:00:00+02:00", "value": 4.0}]}]}
    assert [tuple(r) for r in R.parse_consumption(spark.createDataFrame([(json.dumps(use),)], "value string")).collect()] == [(datetime(2024, 3, 31), 4.0)]


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), *([1.0] * 6)), (datetime(2024, 2, 1), *([2.0] * 6))], HOURLY)
    R.write_store(rows, str(tmp_path / "store"))
    back = R.read_store(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert validate(rows) is rows
    with pytest.raises(SchemaError, match="SOLAR"):
        select_features(rows.drop("SOLAR"))
    with pytest.raises(SchemaError):
        validate(rows.drop("temp"))
    assert available(rows, ["temp", "SOLAR", "none"]) == ["SOLAR", "temp"]
    assert R.records(spark, [[1] * 6, [2] * 6], list(FEATURES)).count() == 2


def test_chunked_source(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ok = "a=2024-05" not in self.path
            self.send_response(200 if ok else 500)
            self.end_headers()
            self.wfile.write(b'{"x": 1}' if ok else b"")

        def log_message(self, *args):
            pass

    assert len(list(date_ranges(datetime(2024, 1, 1), datetime(2024, 12, 31), 150))) == 3
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(ChunkedJson)
    template = f"http://127.0.0.1:{server.server_port}/?a={{start}}&b={{end}}"
    got = spark.read.format("chunked_json").option("template", template).option("start", "2024-01-01T00:00:00").option("end", "2024-12-31T00:00:00").option("pause", "0.01").load().collect()
    server.shutdown()
    failed = [r for r in got if r["value"] is None]
    assert sorted(r["chunk_start"] for r in got if r["value"]) == ["2024-01-01T00:00:00", "2024-10-27T00:00:00"]
    assert [(r["chunk_start"], r["status"]) for r in failed] == [("2024-05-30T00:00:00", 500)] and "500" in failed[0]["error"]


def served(handler):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_tokens_are_fetched_renewed_and_requests_tried_again(spark):
    seen = {"tokens": 0, "asked": {}}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status, body):
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            assert self.headers["Authorization"] == "Basic " + base64.b64encode(b"me:secret").decode() and body == "grant_type=client_credentials"
            with lock:
                seen["tokens"] += 1
                self.answer(200, {"access_token": f"t{seen['tokens']}", "expires_in": 3600})

        def do_GET(self):
            with lock:
                seen["asked"][self.path] = seen["asked"].get(self.path, 0) + 1
                times = seen["asked"][self.path]
            if self.headers["Authorization"] == "Bearer t1":  # the first token has expired, whatever was said
                self.answer(401, {})
            elif "2024-01-02" in self.path and times < 3:
                self.answer(503, {})
            elif "2024-01-03T00" in self.path.split("b=")[0]:
                self.answer(404, {})
            else:
                self.answer(200, {"data": [{"time": "2024-01-01 05:00:00", "temp": 3.5}, {"time": "bad", "temp": 1}]})

        def log_message(self, *args):
            pass

    server, url = served(Handler)
    spark.dataSource.register(ChunkedJson)
    options = {"template": url + "/?a={start}&b={end}", "token_url": url + "/token", "client_id": "me", "client_secret": "secret", "start": "2024-01-01T00:00:00", "end": "2024-01-05T00:00:00", "days": "1", "pause": "0.01", "tries": "4"}
    got = spark.read.format("chunked_json").options(**options).load().orderBy("chunk_start").collect()
    server.shutdown()
    assert [(r["chunk_start"][8:10], r["status"], r["value"] is not None) for r in got] == [("01", 200, True), ("02", 200, True), ("03", 404, False), ("04", 200, True)]
    assert seen["tokens"] >= 2 and seen["asked"][next(p for p in seen["asked"] if "2024-01-02T00" in p.split("b=")[0])] >= 3
    weather = R.parse_weather(spark.createDataFrame(got))
    assert [tuple(r) for r in weather.collect()] == [(datetime(2024, 1, 1, 5), 3.5)]


def test_stream_of_ranges_goes_on_from_its_offset(spark, tmp_path):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"{}")

        def log_message(self, *args):
            pass

    server, url = served(Handler)
    spark.dataSource.register(ChunkedJson)
    for end, days in (("2024-01-04T10:00:00", 3), ("2024-01-06T00:00:00", 5)):
        stream = spark.readStream.format("chunked_json").options(template=url + "/?a={start}&b={end}", start="2024-01-01T00:00:00", end=end, days="1").load()
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        run.awaitTermination()
        starts = sorted(r["chunk_start"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert starts == [f"2024-01-0{i + 1}T00:00:00" for i in range(days)]
    server.shutdown()
    assert len(asked) == len(set(asked)) == 5


def test_metrics_are_written_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "metrics")
    log_metrics(spark, path, "a", {"mae": 0.5, "mse": 0.3}, tags={"family": "hist"})
    log_metrics(spark, path, "b", {"mae": 0.4})
    rows = read_metrics(spark, path)
    assert sorted((r["run"], r["name"], r["value"]) for r in rows.collect()) == [("a", "mae", 0.5), ("a", "mse", 0.3), ("b", "mae", 0.4)]
    assert rows.where("run = 'a'").first()["tags"] == {"family": "hist"}
    broken = spark.range(0, 200, 1, 4).selectExpr("'c' AS run", "'n' AS name", "CAST(id AS double) AS value", "IF(id = 199, raise_error('lost'), id) AS step", "CAST(NULL AS map<string,string>) AS tags")
    with pytest.raises(Exception, match="lost"):
        broken.write.format("run_metrics").mode("append").option("path", path).save()
    assert read_metrics(spark, path).count() == 3 and not [p for p in (tmp_path / "metrics").iterdir() if p.name.startswith("_")]
    spark.createDataFrame([("d", "mae", 1.0, 0, None)], rows.schema).write.format("run_metrics").mode("overwrite").option("path", path).save()
    assert [r["run"] for r in read_metrics(spark, path).collect()] == ["d"]


def test_stream_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, h, m), "view", float(h + m)) for h in range(3) for m in (0, 30)], "ts timestamp_ntz, event_type string, value double")
    rows.write.parquet(str(tmp_path / "in"))
    run = hourly_means(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("test_means").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["timestamp"].hour, r["mean_value"]) for r in spark.table("test_means").collect()) == [(0, 15.0), (1, 16.0), (2, 17.0)]
