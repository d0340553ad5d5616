"""Tar shards as a Spark data source: members (shard, name, offset, size, content of small ones), in batch or as a stream of new shards.

Only headers and sidecars are read; payloads are passed over by arithmetic, so a scan's bytes follow the number of members and
not their size. What lists the shards and what turns a shard into an address are classes named by options, so a repository behind
signed addresses is read like a folder. A shard that cannot be read is a row with an error, not a failed task.

    spark.read.format("tar_shards").load("/corpus")                       files of any filesystem that pyarrow opens
    spark.read.format("tar_shards").load("https://host/repo")             index.json lists, redirects sign (ranges.py)
      .option("prefix", "factory_001/")   shards whose path begins so     .option("shardsPerTask", 8)   shards read by one task
      .option("lister", "package.module:Class")                           .option("resolver", "package.module:Class")
    spark.readStream.format("tar_shards").option("ledger", "/shared/ledger").load(...)

A lister is made with (root, options) and has listed() -> (shards, revision); a resolver is made alike and has address(shard).
With `spark.sql.python.filterPushdown.enabled`, conditions on shard choose the partitions and conditions on name choose the
members whose content is fetched, before anything is read.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .ranges import Blocks, FileRanges, HttpIndex, RedirectResolver, ShardReadError, SignedRanges, with_retries

HEADER = 512
SIDECAR_MAX = 10_000
SCHEMA = "shard string, name string, offset long, size long, content string, error string"
SIDECAR = "factory_id string, worker_id string, video_index int, duration_sec double, fps double, width int, height int, codec string"


def padded(size: int) -> int:
    return -(-size // HEADER) * HEADER


def _text(field: bytes) -> str:
    return field.split(b"\0", 1)[0].decode("utf-8", "replace")


def _pax_records(data: bytes) -> dict[bytes, bytes]:
    """Records of an extended header: each is "length key=value" and a line end."""
    found = {}
    while data:
        length, _, rest = data.partition(b" ")
        if not length.isdigit() or not 0 < int(length) <= len(data):
            break
        key, _, value = rest[: int(length) - len(length) - 2].partition(b"=")
        found[key] = value
        data = data[int(length) :]
    return found


def _number(field: bytes, at: int) -> int:
    """Octal digits, or a number of base 256 if the first bit is set (members of 8 GB and more)."""
    if field[:1] == b"\x80":
        return int.from_bytes(field[1:], "big")
    digits = field.strip(b"\0 ")
    try:
        return int(digits or b"0", 8)
    except ValueError:
        raise ShardReadError(f"bad size at {at}: {digits!r}") from None


def walk_members(read, total: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(name, offset of the payload, size) of each regular file. read(offset, length) returns bytes; a header of zeros ends the archive.

    Names are those of the ustar header, its prefix before its name, or of the long-name (GNU) or extended (pax) entry in front
    of it, which may also give the size. Directories, links and other kinds are passed over."""
    at, longer, told = 0, None, None
    while total is None or at < total:
        head = read(at, HEADER)
        if not head or head[:1] == b"\0":
            return
        if len(head) < HEADER:
            raise ShardReadError(f"short header at {at}")
        size, kind, start = _number(head[124:136], at), head[156:157], at + HEADER
        if kind == b"L":
            longer = _text(read(start, size))
        elif kind == b"x":
            more = _pax_records(read(start, size))
            longer = more[b"path"].decode("utf-8", "replace") if b"path" in more else longer
            told = int(more[b"size"]) if more.get(b"size", b"").isdigit() else told
        elif kind != b"g":
            size = size if told is None else told
            folder = _text(head[345:500]) if head[257:262] == b"ustar" and head[262:264] != b"  " else ""
            name = longer or "/".join(x for x in (folder, _text(head[:100])) if x)
            longer = told = None
            if kind in (b"0", b"\0", b"7") and name:
                yield name, start, size
        at = start + padded(size)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class FileShards:
    """Lister and resolver of a folder: shards are the paths of its .tar files."""

    def __init__(self, root: str, options: dict[str, str]) -> None:
        self.root = root

    def listed(self) -> tuple[list[str], str | None]:
        return list_shards(self.root), None

    def address(self, shard: str) -> str:
        return shard


def list_shards(root: str, prefix: str = "") -> list[str]:
    """Sorted .tar files below root whose path in it begins with prefix."""
    where, base = opened(root)
    found = sorted(i.path for i in where.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File and i.path.endswith(".tar"))
    return [p for p in found if p[len(base) :].lstrip("/").startswith(prefix)]


def _named(path: str):
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def lister_of(root: str, options: dict[str, str]):
    return (_named(options["lister"]) if "lister" in options else HttpIndex if _remote(root) else FileShards)(root, options)


def resolver_of(root: str, options: dict[str, str]):
    return (_named(options["resolver"]) if "resolver" in options else RedirectResolver if _remote(root) else FileShards)(root, options)


def _remote(address: str) -> bool:
    return address.startswith(("http://", "https://"))


def scan_shard(shard: str, resolver=None, wanted=None) -> Iterator[tuple]:
    """Rows of SCHEMA for one shard. resolver.address(shard) is a path, a URI of a file system or an http address; without one the shard is its own.

    wanted(name): members to tell of, and to fetch the content of; with it a shard that cannot be read is told of only if wanted(None)."""
    wanted = wanted or (lambda name: True)
    try:
        address = resolver.address(shard) if resolver else shard
        if _remote(address):
            # the first address is used at once; a refused one is resolved again
            first = [address]
            read, file, total = Blocks(SignedRanges(lambda: first.pop() if first else resolver.address(shard) if resolver else shard)), None, None
        else:
            where, path = opened(address)
            file = with_retries(lambda: where.open_input_file(path))
            ranges = FileRanges(file)
            read, total = Blocks(ranges), ranges.size
        try:
            for name, offset, size in walk_members(read, total):
                if wanted(name):
                    small = name.endswith(".json") and size <= SIDECAR_MAX
                    yield shard, name, offset, size, read(offset, size).decode("utf-8", "replace") if small else None, None
        finally:
            if file is not None:
                file.close()
    except (OSError, ValueError) as e:
        if wanted(None):
            yield shard, None, None, None, None, str(e)[:200]


class _Shards(InputPartition):
    """Shards for one task, with what gives their addresses; nothing is resolved before the task runs, so signatures are fresh."""

    def __init__(self, shards: list[str], resolver) -> None:
        self.shards, self.resolver = shards, resolver


#: Conditions that the source checks itself, by what they say of a value that is not null.
_CHECKS = {
    EqualTo: lambda f: lambda v: v == f.value,
    EqualNullSafe: lambda f: lambda v: v == f.value,
    In: lambda f: lambda v: v in f.value,
    StringStartsWith: lambda f: lambda v: v.startswith(f.value),
    StringEndsWith: lambda f: lambda v: v.endswith(f.value),
    StringContains: lambda f: lambda v: f.value in v,
    IsNotNull: lambda f: lambda v: True,
}


class Conditions:
    """Conditions on shard and name; a null name, that of a shard which cannot be read, meets none on name."""

    def __init__(self) -> None:
        self.filters: dict[str, list[Filter]] = {"shard": [], "name": []}

    def take(self, f: Filter) -> bool:
        """Whether the source checks f itself."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column not in self.filters or type(f) not in _CHECKS or getattr(f, "value", "") is None:
            return False
        self.filters[column].append(f)
        return True

    def on(self, column: str):
        checks = [_CHECKS[type(f)](f) for f in self.filters[column]]
        return lambda v: not checks or v is not None and all(c(v) for c in checks)


def dealt(shards: list[str], options: dict[str, str]) -> list[InputPartition]:
    k = max(1, int(options.get("shardsPerTask", 1)))
    resolver = resolver_of(options["path"], options)
    return [_Shards(shards[i : i + k], resolver) for i in range(0, len(shards), k)]


def selected_shards(options: dict[str, str]) -> list[str]:
    """The lister's shards below options["path"] whose path begins with the option prefix."""
    shards, prefix = lister_of(options["path"], options).listed()[0], options.get("prefix", "")
    root = options["path"] if _remote(options["path"]) else opened(options["path"])[1]
    return [s for s in shards if s.removeprefix(root).lstrip("/").startswith(prefix)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.conditions = options, Conditions()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from [f for f in filters if not self.conditions.take(f)]

    def partitions(self) -> list[InputPartition]:
        met = self.conditions.on("shard")
        return dealt([s for s in selected_shards(self.options) if met(s)], self.options)

    def read(self, partition: _Shards) -> Iterator[tuple]:
        wanted = self.conditions.on("name")
        for shard in partition.shards:
            yield from scan_shard(shard, partition.resolver, wanted)


class Ledger:
    """The order in which shards were first listed, in a shared folder that only the driver writes: files of new names, one after another."""

    def __init__(self, uri: str) -> None:
        self.where, self.folder = opened(uri)

    def read(self) -> list[str]:
        found = self.where.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        out: list[str] = []
        for i in sorted((i for i in found if i.path.endswith(".json")), key=lambda i: i.path):
            with self.where.open_input_file(i.path) as file:
                out += json.loads(file.read())
        return out

    def extended(self, shards: list[str]) -> list[str]:
        """All shards in order, new ones at the end; a file is written whole before it gets its name."""
        have = self.read()
        known = set(have)
        new = [s for s in shards if s not in known]
        if new:
            self.where.create_dir(self.folder, recursive=True)
            part = f"{self.folder}/_{uuid.uuid4().hex}"
            with self.where.open_output_stream(part) as out:
                out.write(json.dumps(new).encode())
            self.where.move(part, f"{self.folder}/{len(have):012d}.json")
        return have + new


class _Stream(DataSourceStreamReader):
    """An offset is how many shards of the ledger have been read, so a restart goes on after the last committed batch and reads no shard twice."""

    def __init__(self, options: dict[str, str]) -> None:
        if "ledger" not in options:
            raise ValueError("a stream of shards needs the option ledger, a folder that outlives it")
        self.options, self.ledger = options, Ledger(options["ledger"])

    def initialOffset(self) -> dict:
        return {"shards": 0}

    def latestOffset(self) -> dict:
        return {"shards": len(self.ledger.extended(selected_shards(self.options)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt(self.ledger.read()[start["shards"] : end["shards"]], self.options)

    def read(self, partition: _Shards) -> Iterator[tuple]:
        for shard in partition.shards:
            yield from scan_shard(shard, partition.resolver)


class TarShards(DataSource):
    """The data source tar_shards."""

    @classmethod
    def name(cls) -> str:
        return "tar_shards"

    def schema(self) -> str:
        return SCHEMA

    def _plain(self) -> dict[str, str]:
        """Options under the names they are read by; Spark's own map knows them in any case."""
        names = ("path", "prefix", "shardsPerTask", "lister", "resolver", "index", "token", "revision", "ledger")
        return {**dict(self.options), **{n: self.options[n] for n in names if n in self.options}}

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._plain())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self._plain())


def factory_ids(paths: DataFrame) -> DataFrame:
    """Distinct first segments of shard paths (column path, relative)."""
    return paths.select(F.substring_index("path", "/", 1).alias("factory_id")).distinct()


def read_members(spark: SparkSession, root: str, prefix: str = "", **options: str) -> DataFrame:
    """Members of all shards below root, with conditions pushed into the source."""
    spark.dataSource.register(TarShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tar_shards").options(prefix=prefix, **options).load(root)


def stream_members(spark: SparkSession, root: str, ledger: str, **options: str) -> DataFrame:
    """A stream of the members of shards that appear below root."""
    spark.dataSource.register(TarShards)
    return spark.readStream.format("tar_shards").options(ledger=ledger, **options).load(root)


def clip_records(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sidecars with their media, and per shard what was left out: orphan_media, orphan_sidecars, oversized, unreadable."""
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    rows = members.withColumn("stem", stem).withColumn("ext", F.regexp_extract("name", r"\.([^./]*)$", 1))
    side = rows.filter("ext = 'json'").select("shard", "stem", "content", F.col("size").alias("side_size"))
    media = rows.filter("ext = 'mp4'").select("shard", "stem", "offset", "size")
    both = side.join(media, ["shard", "stem"], "full_outer")
    big, lone_side, lone_media = F.col("side_size") > SIDECAR_MAX, F.col("offset").isNull(), F.col("side_size").isNull()
    good = both.filter(~lone_side & ~lone_media & ~big).withColumn("m", F.from_json("content", SIDECAR, {"mode": "FAILFAST"}))
    clips = good.select("m.factory_id", "m.worker_id", F.col("m.video_index").alias("clip_index"), "shard", F.col("offset").alias("byte_start"), (F.col("offset") + F.col("size")).alias("byte_end"), F.col("m.duration_sec").alias("duration_s"), "m.fps", "m.width", "m.height", "m.codec")
    left = both.groupBy("shard").agg(F.count_if(lone_media).alias("orphan_media"), F.count_if(lone_side).alias("orphan_sidecars"), F.count_if(big).alias("oversized"))
    errors = members.filter("error is not null").groupBy("shard").agg(F.first("error").alias("error"))
    return clips, left.join(errors, "shard", "full_outer")


def clip_refs(clips: DataFrame, corpus_rev: str) -> DataFrame:
    """Manifest rows with their id; a key that occurs twice is an error at run time."""
    from ..functions.columns import clip_id
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("factory_id", "worker_id", "clip_index"))
    name = clip_id(F.col("factory_id"), F.col("worker_id"), F.col("clip_index"))
    return clips.withColumn("n", n).withColumn("clip_id", F.when(F.col("n") == 1, name).otherwise(F.raise_error(F.concat(F.lit("duplicate clip "), name)).cast("string"))).withColumn("corpus_rev", F.lit(corpus_rev)).drop("n")
