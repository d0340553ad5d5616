"""Shards behind signed addresses, conditions pushed into the source, streams of new shards, and scans that go on where they broke off."""

import io
import json
import tarfile
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from motilis.sources import scans, stores, tar_shards


def sidecar(factory, i):
    return json.dumps({"factory_id": factory, "worker_id": "worker_002", "video_index": i, "duration_sec": 61.0, "fps": 30.0, "width": 1920, "height": 1080, "codec": "h265"}).encode()


def archive(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as t:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def corpus(shards=6):
    return {f"factory_{1 + k // 3:03d}/s{k}.tar": archive([x for i in range(4) for x in ((f"v{k}_{i}.json", sidecar(f"factory_{1 + k // 3:03d}", 10 * k + i)), (f"v{k}_{i}.mp4", bytes(20_000)))]) for k in range(shards)}


def members_of(data):
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        return [(m.name, m.offset_data, m.size) for m in t.getmembers()]


class Host(ThreadingHTTPServer):
    """A repository: an index for those with the token, redirects to signed addresses, which serve `lasts` ranges each; the first request for some ranges finds the server busy."""

    def __init__(self, shards, lasts=3):
        super().__init__(("127.0.0.1", 0), Handler)
        self.shards, self.lasts, self.uses, self.met, self.issued, self.scanned, self.lock = shards, lasts, Counter(), Counter(), 0, Counter(), threading.Lock()
        self.broken = set()
        self.root = f"http://127.0.0.1:{self.server_address[1]}/repo"
        threading.Thread(target=self.serve_forever, daemon=True).start()


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def say(self, code, body=b"", **headers):
        self.send_response(code)
        for k, v in {**headers, "Content-Length": str(len(body))}.items():
            self.send_header(k, v)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(body)

    def do_HEAD(self):
        self.do_GET()

    def do_GET(self):
        host = self.server
        with host.lock:
            if self.path == "/repo/index.json":
                if self.headers.get("Authorization") != "Bearer t0ken":
                    return self.say(401)
                return self.say(200, json.dumps({"revision": "r7", "shards": [*host.shards, "README.md"]}).encode())
            _, kind, *rest = self.path.split("/")
            if kind == "repo":
                host.issued += 1
                return self.say(302, Location=f"{host.root.removesuffix('repo')}signed/{host.issued}/{'/'.join(rest[1:])}")
            shard = "/".join(rest[1:])
            host.uses[rest[0]] += 1
            if host.uses[rest[0]] > host.lasts:
                return self.say(403)
            if shard in host.broken:
                return self.say(404)
            data = host.shards[shard]
            a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            host.met[shard, a] += 1
            if host.met[shard, a] == 1 and a // 8192 == 3:
                return self.say(503)
            if a >= len(data):
                return self.say(416)
            host.scanned[shard] += a == 0
            return self.say(206, data[a : b + 1])


@pytest.fixture
def host():
    server = Host(corpus())
    yield server
    server.shutdown()


@pytest.fixture
def options():
    return {"token": "t0ken", "revision": "r7"}


def test_source_over_signed_addresses_agrees_with_tarfile(spark, host, options):
    got = tar_shards.read_members(spark, host.root, **options).collect()
    assert sorted((r.shard, r.name, r.offset, r.size) for r in got) == sorted((s, *m) for s, data in host.shards.items() for m in members_of(data))
    assert all(r.error is None and (r.content is not None) == r.name.endswith(".json") for r in got)
    assert host.issued > len(host.shards)  # signatures ran out and were asked for again
    clips, left = tar_shards.clip_records(tar_shards.read_members(spark, host.root, "factory_002/", shardsPerTask="2", **options))
    assert {r.factory_id for r in clips.collect()} == {"factory_002"} and clips.count() == 12 and left.filter("error is not null").count() == 0


def test_a_shard_that_is_gone_is_a_row_and_a_refused_index_an_error(spark, host, options):
    host.broken.add("factory_001/s1.tar")
    got = tar_shards.read_members(spark, host.root, **options)
    assert [(r.shard, r.name) for r in got.filter("error is not null").collect()] == [("factory_001/s1.tar", None)]
    assert got.count() == 5 * 8 + 1
    with pytest.raises(Exception, match="401"):
        tar_shards.read_members(spark, host.root, token="other").count()


def test_conditions_are_pushed_into_the_source(spark, host, options):
    df = tar_shards.read_members(spark, host.root, **options)
    one = df.filter("shard = 'factory_002/s4.tar' and name like 'v4_1.%'")
    assert sorted(r.name for r in one.collect()) == ["v4_1.json", "v4_1.mp4"]
    assert set(host.scanned) == {"factory_002/s4.tar"} and one.rdd.getNumPartitions() == 1
    host.broken.add("factory_001/s0.tar")
    some = {"starts": df.filter(F.col("shard").startswith("factory_001/")), "in": df.filter(F.col("shard").isin("factory_001/s0.tar", "factory_001/s2.tar")), "ends": df.filter(F.col("name").endswith(".json")), "has": df.filter(F.col("name").contains("_3.")), "none": df.filter("name is null"), "more": df.filter("size > 1000 and error is null"), "not": df.filter("name is not null and not name like '%.mp4'")}
    assert {k: v.count() for k, v in some.items()} == {"starts": 17, "in": 9, "ends": 20, "has": 10, "none": 1, "more": 20, "not": 20}
    assert "FileShards" not in some["in"]._jdf.queryExecution().executedPlan().toString()


def test_own_lister_and_resolver(spark, tmp_path):
    for k, data in enumerate(corpus(3).values()):
        (tmp_path / f"{k}.tar").write_bytes(data)
    df = tar_shards.read_members(spark, str(tmp_path), lister="tests.test_scans:Numbers", resolver="tests.test_scans:Numbers")
    assert {(r.shard, r.n) for r in df.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {("n0", 8), ("n1", 8), ("n2", 8)}


class Numbers:
    def __init__(self, root, options):
        self.root = root

    def listed(self):
        return ["n0", "n1", "n2"], "r"

    def address(self, shard):
        return f"{self.root}/{shard[1:]}.tar"


def test_stream_reads_each_shard_once_over_restarts(spark, tmp_path):
    data, root, out = corpus(6), tmp_path / "in", str(tmp_path / "out")
    root.mkdir()

    def put(names):
        for n in names:
            (root / n.replace("/", "_")).write_bytes(data[n])

    def run():
        q = tar_shards.stream_members(spark, str(root), str(tmp_path / "ledger")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return spark.read.parquet(out).groupBy("shard").count().collect()

    names = sorted(data)
    put(names[2:4])
    assert [r["count"] for r in run()] == [8, 8]
    put([names[0], *names[4:]])  # one before and some behind those already read
    assert [r["count"] for r in run()] == [8] * 5
    assert [r["count"] for r in run()] == [8] * 5
    with pytest.raises(Exception, match="ledger"):
        tar_shards.stream_members(spark, str(root), str(tmp_path / "l")).sparkSession.readStream.format("tar_shards").load(str(root)).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "x")).start().awaitTermination()


def test_a_broken_scan_of_shards_goes_on(spark, tmp_path, host, options, monkeypatch):
    host.lasts, path, committed = 10**9, str(tmp_path / "members"), []
    keep = scans.time.time_ns

    def stops():  # the driver is lost in front of the second wave's commit
        if len(committed) == 1:
            raise KeyboardInterrupt
        committed.append(1)
        return keep()

    monkeypatch.setattr(scans.time, "time_ns", stops)
    with pytest.raises(KeyboardInterrupt):
        scans.scan_shards(spark, host.root, path, waves=3, **options)
    monkeypatch.setattr(scans.time, "time_ns", keep)
    first = {r.shard for r in scans.read_whole(spark, path, "shard").select("shard").distinct().collect()}
    assert 0 < len(first) < 6
    host.broken.add(gone := sorted(set(host.shards) - first)[0])
    assert scans.scan_shards(spark, host.root, path, waves=3, **options) == {"whole": len(first), "broken": 0, "tried": 6 - len(first)}
    assert scans.read_whole(spark, path, "shard").select("shard").distinct().count() == 5
    assert [r.shard for r in scans.read_attempts(spark, path).filter("error is not null").collect()] == [gone]
    host.broken.clear()
    assert scans.scan_shards(spark, host.root, path, waves=3, **options) == {"whole": 5, "broken": 1, "tried": 1}
    assert scans.scan_shards(spark, host.root, path, waves=3, **options) == {"whole": 6, "broken": 0, "tried": 0}
    got = scans.read_whole(spark, path, "shard")
    assert sorted((r.shard, r.name, r.offset, r.size) for r in got.collect()) == sorted((s, *m) for s, data in host.shards.items() for m in members_of(data))
    assert all(host.scanned[s] == 1 for s in host.shards)  # each shard once, the one that was gone on its return


def test_partial_clips_are_done_again_and_foreign_ones_stay(spark, tmp_path):
    path = str(tmp_path / "labels")
    work = spark.createDataFrame([("a", 3, 4.0), ("b", 2, 4.0), ("c", 1, 4.0), ("c", 1, 4.0)], "clip_id string, expected int, fps double")
    short = {"b"}

    def label(clips):
        rows = clips.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("expected") - 1))).withColumn("t_s", F.col("i") / F.col("fps"))
        return rows.filter(~(F.col("clip_id").isin(*short) & (F.col("t_s") > 0))).select("clip_id", "t_s") if short else rows.select("clip_id", "t_s")

    foreign = spark.createDataFrame([("z", 9)], "clip_id string, expected int").withColumn("fps", F.lit(4.0))
    assert scans.resume(foreign, path, lambda c: label(c), "clip_id") == {"whole": 0, "broken": 0, "tried": 1}
    assert scans.resume(work, path, label, "clip_id", waves=2) == {"whole": 0, "broken": 0, "tried": 3}
    counts = lambda: {r.clip_id: r["count"] for r in scans.read_whole(spark, path, "clip_id").groupBy("clip_id").count().collect()}
    assert counts() == {"z": 9, "a": 3, "c": 1}  # b's decoder ended early, so b is not done
    short.clear()
    assert scans.resume(work, path, label, "clip_id", waves=2) == {"whole": 2, "broken": 1, "tried": 1}
    assert counts() == {"z": 9, "a": 3, "b": 2, "c": 1}
    again = scans.read_attempts(spark, path).filter("clip_id = 'a'").withColumn("attempt", F.lit("9"))
    again.write.mode("append").partitionBy("attempt").parquet(path)  # a second labeller did a as well
    assert counts()["a"] == 3 and scans.read_whole(spark, path, "clip_id").columns == ["clip_id", "t_s"]


def test_nothing_to_do(spark, tmp_path):
    work = spark.createDataFrame([], "clip_id string, expected int")
    assert scans.resume(work, str(tmp_path / "none"), lambda c: c, "clip_id") == {"whole": 0, "broken": 0, "tried": 0}
    assert scans.read_whole(spark, str(tmp_path / "none"), "clip_id") is None
    assert scans.pending(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), spark.createDataFrame([("b",)], "k string"), "k").count() == 2
    assert stores.scratch_folder(spark) != stores.scratch_folder(spark)
