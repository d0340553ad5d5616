"""Tar shards against tarfile, JSONL guards, frame pipes and label streams."""

import io
import json
import sys
import tarfile

import pytest
from pyspark.sql import functions as F

from motilis.operators import signals
from motilis.sources import frames, ranges, stores, tar_shards
from motilis.streaming import labels


def sidecar(i, **more):
    return json.dumps({"factory_id": "factory_001", "worker_id": "worker_002", "video_index": i, "duration_sec": 61.0, "fps": 30.0, "width": 1920, "height": 1080, "codec": "h265", **more})


@pytest.fixture
def shards(tmp_path):
    def write(name, members):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        with tarfile.open(path, "w", format=tarfile.USTAR_FORMAT) as t:
            for n, data in members:
                info = tarfile.TarInfo(n)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return path

    write("factory_001/a.tar", [("v1.json", sidecar(1).encode()), ("v1.mp4", b"x" * 700), ("v2.mp4", b"y" * 10), ("v3.json", sidecar(3).encode())])
    write("factory_001/b.tar", [("w1.json", (sidecar(4) + " " * 11_000).encode()), ("w1.mp4", b"z"), ("w2.mp4", b"z" * 2000), ("w2.json", sidecar(5).encode())])
    (tmp_path / "factory_002").mkdir()
    (tmp_path / "factory_002/c.tar").write_bytes(b"name" + b"\0" * 120 + b"notoctal" + b"\0" * 380)
    return tmp_path


def test_members_agree_with_tarfile(spark, shards):
    got = {(r.shard, r.name, r.offset, r.size) for r in tar_shards.read_members(spark, str(shards), "factory_001/").collect()}
    want = set()
    for p in sorted(shards.glob("factory_001/*.tar")):
        with tarfile.open(p) as t:
            want |= {(str(p), m.name, m.offset_data, m.size) for m in t.getmembers()}
    assert got == want


@pytest.mark.parametrize("kind", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_long_names_and_other_kinds_agree_with_tarfile(tmp_path, kind):
    path = tmp_path / "long.tar"
    names = ["short.json", "d" * 60 + "/" + "e" * 60 + "/clip.mp4", "f" * 99, "a/b.mp4"] + ([] if kind == tarfile.USTAR_FORMAT else ["g" * 180 + "/h.mp4", "ü" * 120])
    with tarfile.open(path, "w", format=kind) as t:
        for folder in ("plain", "p" * 90 + "/" + "q" * 40):
            info = tarfile.TarInfo(folder)
            info.type = tarfile.DIRTYPE
            t.addfile(info)
        for i, n in enumerate(names):
            info = tarfile.TarInfo(n)
            info.size = 700 * i
            t.addfile(info, io.BytesIO(b"x" * info.size))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "short.json"
        t.addfile(link)
    data = path.read_bytes()
    with tarfile.open(path) as t:
        want = [(m.name, m.offset_data, m.size) for m in t.getmembers() if m.isfile()]
    assert list(tar_shards.walk_members(lambda a, n: data[a : a + n], len(data))) == want and len(want) == len(names)


class Served:
    """An object behind a URL that expires, a server that is busy at times, and ranges past the end."""

    def __init__(self, data, busy=(), lasts=10**9):
        self.data, self.busy, self.lasts, self.asked, self.issued, self.slept = data, set(busy), lasts, 0, 0, []

    def resolve(self):
        self.issued += 1
        return f"http://x/{self.issued}"

    def __call__(self, request):
        from urllib.error import HTTPError

        self.asked += 1
        fail = lambda code: HTTPError(request.full_url, code, "no", {}, None)
        if self.asked in self.busy:
            raise fail(503)
        if int(request.full_url.rsplit("/", 1)[1]) < self.issued or self.asked % self.lasts == 0:
            raise fail(403)
        a, b = map(int, request.headers["Range"].removeprefix("bytes=").split("-"))
        if a >= len(self.data):
            raise fail(416)
        return io.BytesIO(self.data[a : b + 1])


def test_ranges_over_http():
    data = bytes(range(256)) * 100
    served = Served(data, busy=(2, 3), lasts=5)
    read = ranges.Blocks(ranges.SignedRanges(served.resolve, open_url=served, sleep=served.slept.append), block=1000)
    assert read(0, 10) == data[:10] and read(995, 4000) == data[995:4995] and read(25_590, 100) == data[25_590:] and read(30_000, 5) == b""
    assert served.issued == 1 + served.asked // 5 and served.slept and read.fetched <= 8000
    assert read(3, 900) == data[3:903] and read.requests <= 8
    with pytest.raises(ranges.ShardReadError, match="4 attempts"):
        ranges.SignedRanges(served.resolve, open_url=Served(data, busy=range(99)), sleep=lambda s: None)(0, 1)


@pytest.mark.parametrize("block", [1, 7, 512, 10_000])
def test_blocks_are_one_object(block):
    data = bytes(range(256)) * 9
    read = ranges.Blocks(lambda a, n: data[a : a + n], block=block, keep=3)
    for a, n in [(0, 0), (0, 1), (5, 600), (511, 2), (2300, 10), (2300, 4), (2304, 5), (9000, 1), (0, 9999)]:
        assert read(a, n) == data[a : a + n]


def test_sizes_beyond_eight_gigabytes():
    """Numbers of base 256 and pax sizes, by headers whose payload is passed over."""
    big = (1 << 33) + 5
    for kind in (tarfile.GNU_FORMAT, tarfile.PAX_FORMAT):
        info = tarfile.TarInfo("big.mp4")
        info.size = big
        after = tarfile.TarInfo("after.json")
        head = info.tobuf(kind)
        at = len(head) + tar_shards.padded(big)
        parts = {0: head, at: after.tobuf(kind) + bytes(1024)}

        def read(a, n, parts=parts):
            return next((p[a - k : a - k + n] for k, p in parts.items() if k <= a < k + len(p)), b"")

        assert list(tar_shards.walk_members(read)) == [("big.mp4", len(head), big), ("after.json", at + 512, 0)]


def test_records_count_what_they_leave_out(spark, shards):
    clips, left = tar_shards.clip_records(tar_shards.read_members(spark, str(shards)))
    assert sorted((r.clip_index, r.byte_end - r.byte_start) for r in clips.collect()) == [(1, 700), (5, 2000)]
    by = {r.shard.split("/")[-1]: r for r in left.collect()}
    assert (by["a.tar"].orphan_media, by["a.tar"].orphan_sidecars) == (1, 1) and by["b.tar"].oversized == 1 and "bad size" in by["c.tar"].error
    refs = tar_shards.clip_refs(clips, "r1")
    assert {r.clip_id for r in refs.collect()} == {"factory_001/worker_002/000001", "factory_001/worker_002/000005"}
    with pytest.raises(Exception, match="duplicate clip"):
        tar_shards.clip_refs(clips.unionByName(clips), "r1").collect()


def test_retries():
    tries, pauses = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return 7

    assert ranges.with_retries(flaky, sleep=pauses.append) == 7 and pauses == [0.5, 1.0]
    with pytest.raises(PermissionError):
        ranges.with_retries(lambda: (_ for _ in ()).throw(PermissionError()), sleep=pauses.append)


def label(t, **more):
    return json.dumps({"clip_id": "c", "t_s": t, "corpus_rev": "r", "fps_sampled": 4.0, "label_source": "m", "label_rev": "1", "prompt_variant": "p", "manipulation": True, "hands_visible": 1, **more})


def test_label_store(spark, tmp_path):
    path = tmp_path / "l.jsonl"
    path.write_text("\n".join([label(0.0), "", label(0.25), label(0.25, manipulation=False)]) + "\n")
    plan = spark.createDataFrame([("c", i, i / 4) for i in range(3)], "clip_id string, i int, t_s double")
    out = {r.i: r for r in signals.join_labels(plan, stores.read_labels(spark, str(path))).collect()}
    assert out[0].manipulation is True and out[1].manipulation is False and out[2].manipulation is None and out[2].unreadable_reason == signals.NO_LABEL
    path.write_text(label(0.0) + "\n" + label(0.25, label_rev="2"))
    with pytest.raises(ValueError):
        stores.read_labels(spark, str(path))
    path.write_text("{broken")
    with pytest.raises(Exception):
        stores.read_labels(spark, str(path))


def test_detection_store(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text(json.dumps({"clip_id": "c", "t_s": 0.0, "mask_source": "100doh", "boxes": [{"x": 0, "y": 0, "width": 2, "height": 3, "score": 1}]}))
    assert stores.read_detections(spark, str(path)).first().boxes[0].width == 2.0
    path.write_text(json.dumps({"clip_id": "c", "t_s": 0.0, "mask_source": "other", "boxes": []}))
    with pytest.raises(ValueError):
        stores.read_detections(spark, str(path))


def test_frames_stream_and_fail():
    argv = [sys.executable, "-c", "import sys; sys.stdout.buffer.write(b'abcdefgh')"]
    assert list(frames.stream_frames(argv, 3)) == [b"abc", b"def"]
    with pytest.raises(RuntimeError, match="boom"):
        list(frames.stream_frames([sys.executable, "-c", "import sys; sys.exit('boom')"], 3))
    argv = frames.decoder_argv("http://x/a.tar", 512, 900, 4.0, 960, 540, 2.0)
    assert argv.index("-ss") < argv.index("-i") and "subfile,,start,512,end,900,,:http://x/a.tar" in argv


def test_probe_and_detector_keep_every_instant(spark):
    def frames_of(row):
        if row["clip_id"] == "bad":
            raise OSError("no such clip")
        yield from (b"a", b"b", b"c")

    class Model:
        def boxes(self, frame):
            if frame == b"b":
                raise ValueError("model failed")
            return [{"x": 0.0, "y": 0.0, "width": 1.0, "height": 1.0, "score": 1.0}] if frame == b"a" else []

    clips = spark.createDataFrame([("good", 2), ("bad", 2)], "clip_id string, planned long")
    out = {r.clip_id: r for r in frames.probe(clips, frames_of).collect()}
    assert out["good"].ok and out["good"].frames == 3 and not out["bad"].ok and out["bad"].reason == "no such clip"
    rows = frames.detect(clips.filter("clip_id = 'good'"), frames_of, Model, 4.0, "100doh").orderBy("t_s").collect()
    assert [(len(r.boxes), r.failed_reason) for r in rows] == [(1, None), (0, "model failed"), (0, None)]


def test_label_stream_merges_batches(spark, tmp_path):
    source, state = tmp_path / "in", str(tmp_path / "state")
    source.mkdir()
    schema = "clip_id string, t_s double, seq long, manipulation boolean"
    row = lambda c, t, s, m: json.dumps({"clip_id": c, "t_s": t, "seq": s, "manipulation": m})
    (source / "1.json").write_text("\n".join([row("a", 0.0, 1, True), row("b", 0.0, 1, True)]))
    labels.ingest(spark, str(source), schema, state, str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text("\n".join([row("a", 0.25, 2, True), row("a", 0.0, 3, False)]))
    labels.ingest(spark, str(source), schema, state, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(state)
    assert sorted((r.clip_id, r.t_s, r.manipulation) for r in rows.collect()) == [("a", 0.0, False), ("a", 0.25, True), ("b", 0.0, True)]
    planned = spark.createDataFrame([("a", 2), ("b", 2)], "clip_id string, n_planned long")
    assert [r.clip_id for r in labels.complete_clips(rows, planned).collect()] == ["a"]


def test_windowed_counts_in_batch_and_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    batch = labels.counts_by_window(events, "1 hour").agg(F.sum("n")).first()[0]
    assert batch == events.count()
    q = labels.counts_by_window(spark.readStream.schema(events.schema).parquet(f"{sf}/events*.parquet"), "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == batch
