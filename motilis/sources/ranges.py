"""Reading objects in ranges: one cached reader over two kinds of fetchers, files of pyarrow's filesystems and signed HTTP addresses."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import HTTPRedirectHandler, Request, build_opener, urlopen

import pyarrow as pa

BLOCK = 8192


class ShardReadError(ValueError):
    """A shard that cannot be read, or whose headers do not add up."""


class Blocks:
    """read(offset, length), in blocks that fetch(first, length) gives; the last `keep` of them stay, so that neighbouring headers cost one request.

    A block shorter than asked for is the object's last; reads past its end are short."""

    def __init__(self, fetch: Callable[[int, int], bytes], block: int = BLOCK, keep: int = 64) -> None:
        self.fetch, self.block, self.keep = fetch, block, keep
        self.held: dict[int, bytes] = {}
        self.requests = self.fetched = 0

    def _block(self, k: int) -> bytes:
        if k not in self.held:
            if len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            self.held[k] = data = self.fetch(k * self.block, self.block)
            self.requests, self.fetched = self.requests + 1, self.fetched + len(data)
        return self.held[k]

    def __call__(self, offset: int, length: int) -> bytes:
        first, last = offset // self.block, (offset + length - 1) // self.block
        parts = []
        for k in range(first, last + 1):
            parts.append(data := self._block(k))
            if len(data) < self.block:
                break
        skipped = offset - first * self.block
        return b"".join(parts)[skipped : skipped + length]


def with_retries(f: Callable[[], bytes], attempts: int = 4, base_s: float = 0.5, sleep: Callable[[float], None] = time.sleep):
    """f() again after a pause that doubles, if it raises OSError; permission errors are not tried again."""
    for k in range(attempts):
        try:
            return f()
        except PermissionError:
            raise
        except OSError:
            if k == attempts - 1:
                raise
            sleep(base_s * 2**k)


class FileRanges:
    """fetch(first, length) of an open file."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()

    def __call__(self, first: int, length: int) -> bytes:
        room = min(length, self.size - first)
        return with_retries(lambda: self.file.read_at(room, first)) if room > 0 else b""


class SignedRanges:
    """fetch(first, length) of an object behind a signed address, which resolve() gives.

    A refused address (401, 403) is resolved anew, since its signature may have run out; busy servers and broken connections are
    asked again after a pause that doubles; a range past the end of the object (416) is empty."""

    BUSY = frozenset({429, 500, 502, 503, 504})

    def __init__(self, resolve: Callable[[], str], attempts: int = 4, open_url=None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.resolve, self.attempts, self.sleep = resolve, attempts, sleep
        self.open_url = open_url or (lambda request: urlopen(request, timeout=60))
        self.url: str | None = None

    def __call__(self, first: int, length: int) -> bytes:
        for k in range(self.attempts):
            try:
                self.url = self.url or self.resolve()
                with self.open_url(Request(self.url, headers={"Range": f"bytes={first}-{first + length - 1}"})) as answer:
                    data = answer.read()
                    # a server without ranges answers 200 with the object from its start
                    return data if getattr(answer, "status", 206) == 206 else data[first : first + length]
            except HTTPError as e:
                if e.code == 416:
                    return b""
                if e.code in (401, 403):
                    self.url = None
                    if k == 0:  # run out; a second refusal in a row is something else, and waits
                        continue
                elif e.code not in self.BUSY:
                    raise
            except OSError:
                pass
            self.sleep(2.0**k)
        raise ShardReadError(f"bytes from {first} on could not be read in {self.attempts} attempts")


class _Stay(HTTPRedirectHandler):
    """Redirects are answers, not followed."""

    def redirect_request(self, *a, **b):
        return None


def _asked(url: str, token: str | None) -> Request:
    return Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})


class HttpIndex:
    """Lister of a repository that is not a file system: its index document names the shards and the revision they were listed at.

    Options: index (address relative to the root, default index.json), token. The document is JSON, {"revision": ..., "shards": [path or {"path": ...}, ...]}."""

    def __init__(self, root: str, options: dict[str, str]) -> None:
        self.url, self.token = f"{root.rstrip('/')}/{options.get('index', 'index.json')}", options.get("token")

    def listed(self) -> tuple[list[str], str | None]:
        def ask() -> dict:
            with urlopen(_asked(self.url, self.token), timeout=60) as answer:
                return json.load(answer)

        said = with_retries(ask)
        paths = (s if isinstance(s, str) else s["path"] for s in said["shards"])
        return sorted({p for p in paths if p.endswith(".tar")}), said.get("revision")


class RedirectResolver:
    """Signed address of a shard: where the repository's own address of it leads, without following; the address itself if it leads nowhere.

    Options: token, revision (put between root and path as `<revision>/`)."""

    def __init__(self, root: str, options: dict[str, str]) -> None:
        self.root, self.token = "/".join(x for x in (root.rstrip("/"), options.get("revision")) if x), options.get("token")

    def address(self, shard: str) -> str:
        url = f"{self.root}/{quote(shard)}"
        request = _asked(url, self.token)
        request.method = "HEAD"
        try:
            with build_opener(_Stay).open(request, timeout=60):
                return url
        except HTTPError as e:
            if e.code in (301, 302, 303, 307, 308):
                return e.headers["Location"]
            raise
