"""Folders with versions and leases on a file system that driver and executors share.

A version is one small JSON file, created exclusively, whose number is one above the last one's; what
it names was written before, so a reader sees the old version or the new one and nothing between.
A lease says who may write: its file is created exclusively as well, it runs out unless renewed, and
its number is a fence, by which a writer that slept too long learns that another one has taken over.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlparse

from pyspark.sql import SparkSession


class Held(RuntimeError):
    """Somebody else holds the lease."""


class Lost(RuntimeError):
    """The lease has run out or was taken over."""


@dataclass(frozen=True)
class Folder:
    """A folder, by the file systems that Spark knows."""

    spark: SparkSession
    path: str

    def _of(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, name: str = "") -> list[str]:
        """What lies in it, in order; nothing if it isn't there."""
        fs, path = self._of(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def create(self, name: str, value: dict) -> bool:
        """Write a file that isn't there yet; False if it is. Of several that try at once one succeeds."""
        fs, path = self._of(name)
        fs.mkdirs(path.getParent())
        told = json.dumps(value, sort_keys=True)
        where = urlparse(fs.makeQualified(path).toString())
        if where.scheme == "file":  # Hadoop's local file system looks and then writes, which isn't exclusive
            try:
                with os.fdopen(os.open(where.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(told)
            except FileExistsError:
                return False
            return True
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or fs.exists(path):
                return False
            raise
        out.write(bytearray(told.encode()))
        out.close()
        return True

    def read(self, name: str) -> dict | None:
        """A file's value; None if it isn't there, or isn't written to its end yet."""
        fs, path = self._of(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def delete(self, name: str = "") -> None:
        fs, path = self._of(name)
        fs.delete(path, True)

    def backup_once(self, name: str, backup: str) -> bool:
        """Copy a file or folder, unless there is such a backup already; whether it was copied. A copy that isn't whole isn't there: it is made under another name first."""
        fs, source = self._of(name)
        _, target = self._of(backup)
        if fs.exists(target) or not fs.exists(source):
            return False
        _, part = self._of(f"{backup}.part")
        fs.delete(part, True)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, part, False, self.spark._jsc.hadoopConfiguration())
        return bool(fs.rename(part, target))

    def set_aside(self, name: str) -> str | None:
        """Give what is there another name, with the first number that is free, so that a fresh run begins without it; the new name."""
        fs, source = self._of(name)
        if not fs.exists(source):
            return None
        taken = set(self.names(name.rsplit("/", 1)[0] if "/" in name else ""))
        k = next(k for k in range(1, len(taken) + 2) if f"{name.rsplit('/', 1)[-1]}.{k}" not in taken)
        _, target = self._of(f"{name}.{k}")
        return f"{name}.{k}" if fs.rename(source, target) else None

    # --- versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names("_versions") if n.endswith(".json")]

    def current(self) -> tuple[int, dict]:
        """The number and value of the last version; (0, {}) if there is none."""
        for number in reversed(self.versions()):
            if (value := self.read(f"_versions/{number:012d}.json")) is not None:
                return number, value
        return 0, {}

    def commit(self, number: int, value: dict) -> None:
        """Make ``value`` the version of that number; raises ``Lost`` if another writer has made it."""
        if not self.create(f"_versions/{number:012d}.json", value):
            raise Lost(f"version {number} of {self.path} is another writer's")


@dataclass
class Lease:
    """The right to write to a folder, for ``seconds`` at a time."""

    folder: Folder
    owner: str
    seconds: float = 600.0
    now: Callable[[], float] = time.time
    fence: int = field(default=0, init=False)
    until: float = field(default=0.0, init=False)

    def _last(self) -> tuple[int, dict]:
        """The last lease with its latest renewal."""
        found = [n.removesuffix(".json").split("-") for n in self.folder.names("_leases") if n.endswith(".json") and not n.startswith(".")]
        if not found:
            return 0, {}
        number, part = max((int(a), int(b)) for a, b in found)
        return number, self.folder.read(f"_leases/{number:012d}-{part:06d}.json") or {"owner": "?", "until": self.now() + self.seconds, "part": part}

    def take(self) -> Lease:
        """Take the lease if nobody holds it, or if it has run out; else raises ``Held``."""
        number, held = self._last()
        if held and held["until"] > self.now():
            raise Held(f"{self.folder.path} is held by {held['owner']} for another {held['until'] - self.now():.0f} s")
        self._write(number + 1, 0, self.now() + self.seconds, Held)
        return self

    def renew(self) -> None:
        """Hold it for another while; raises ``Lost`` if it isn't ours any more."""
        self.check()
        self._write(self.fence, self._last()[1]["part"] + 1, self.now() + self.seconds, Lost)

    def check(self) -> None:
        """Raises ``Lost`` if it has run out or another one has taken it over; to be called before what it guards is committed."""
        number, held = self._last()
        if not self.fence or number != self.fence or held["until"] <= self.now():
            raise Lost(f"{self.folder.path} isn't held by {self.owner} any more")

    def release(self) -> None:
        """Give it back, so that the next one needn't wait."""
        number, held = self._last()
        if self.fence and number == self.fence:
            self._write(self.fence, held["part"] + 1, 0.0, Lost)
        self.fence = 0

    def _write(self, number: int, part: int, until: float, failed: type[Exception]) -> None:
        if not self.folder.create(f"_leases/{number:012d}-{part:06d}.json", {"owner": self.owner, "until": until, "part": part}):
            raise failed(f"{self.folder.path} was taken by another one")
        self.fence, self.until = number, until

    def __enter__(self) -> Lease:
        return self if self.fence else self.take()

    def __exit__(self, *error) -> None:
        try:
            self.release()
        except Lost:
            pass
