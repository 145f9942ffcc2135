"""Small files of the storage layer: create-only writes, listing, tags."""

from __future__ import annotations

import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from ..errors import InvalidInputError, NotFoundError, StorageError


class Store:
    """Files under a local folder, ``file://`` or ``memory://`` (a private temporary folder).

    Other schemes need a mounted path; Spark reads and writes the segments, so
    only manifests, leases and change sets pass through here.
    """

    def __init__(self, url: str, tags: dict[str, str] | None = None):
        scheme, _, rest = url.partition("://")
        if "://" not in url:
            self.root = Path(url).absolute()
        elif scheme == "file":
            self.root = Path(rest)
        elif scheme == "memory":
            self.root = Path(tempfile.gettempdir()) / f"typeahead-memory-{rest or uuid.uuid4().hex}"
        else:
            raise InvalidInputError(f"{scheme}:// needs a mounted path")
        self.tags = dict(tags or {})
        self.root.mkdir(parents=True, exist_ok=True)

    def path(self, key: str) -> Path:
        p = (self.root / key).resolve()
        if not p.is_relative_to(self.root.resolve()):
            raise InvalidInputError(f"{key!r} leaves the store")
        return p

    def uri(self, key: str) -> str:
        return f"file://{self.path(key)}"

    def get(self, key: str) -> bytes:
        try:
            return self.path(key).read_bytes()
        except FileNotFoundError:
            raise NotFoundError(f"{key!r} not found") from None

    def _temp(self, key: str, data: bytes) -> Path:
        p = self.path(key)
        p.parent.mkdir(parents=True, exist_ok=True)
        temp = p.parent / f".{uuid.uuid4().hex}.tmp"
        with temp.open("wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return temp

    def put(self, key: str, data: bytes) -> None:
        os.replace(self._temp(key, data), self.path(key))

    def put_if_absent(self, key: str, data: bytes) -> bool:
        """Create a whole file or nothing; False if the key is taken."""
        temp = self._temp(key, data)
        try:
            os.link(temp, self.path(key))
            return True
        except FileExistsError:
            return False
        except OSError as e:
            raise StorageError(str(e)) from e
        finally:
            temp.unlink()

    def delete(self, key: str) -> None:
        p = self.path(key)
        if p.is_dir():
            shutil.rmtree(p, ignore_errors=True)
        else:
            p.unlink(missing_ok=True)

    def delete_many(self, keys: list[str]) -> None:
        for k in keys:
            self.delete(k)

    def list(self, prefix: str = "", after: str = "") -> list[str]:
        """Keys of files under a folder, in order."""
        top = self.path(prefix)
        found = [str(p.relative_to(self.root.resolve())) for p in top.rglob("*") if p.is_file() and not p.name.startswith(".")] if top.is_dir() else []
        return sorted(k for k in found if k > after)

    def list_objects(self, prefix: str = "") -> list[tuple[str, int, float]]:
        """(key, bytes, modification time)."""
        return [(k, (s := self.path(k).stat()).st_size, s.st_mtime) for k in self.list(prefix)]

    @staticmethod
    def now_ms() -> int:
        return time.time_ns() // 1_000_000
