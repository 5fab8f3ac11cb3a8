"""A folder on any file system that Spark writes to: small files on the driver, numbered commits, a lease with a fencing number."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

# Seconds after which a silent holder has lost its lease.
LEASE_SECONDS = 600


class Locked(RuntimeError):
    """Another run holds the index."""


class Lost(Locked):
    """A run that no longer holds the index wants to write."""


class Conflict(RuntimeError):
    """Another writer committed first."""


class Folder:
    """Files under ``root``: listed, read, and created whole or not at all.

    ``create`` is atomic on local disks (a hard link) and wherever renaming a file
    onto another fails, as on HDFS; stores without such a rename need a file system
    that has one in front.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, sorted; nothing if it isn't there."""
        files, at = self._at(name)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def exists(self, name: str) -> bool:
        files, at = self._at(name)
        return files.exists(at)

    def size(self, name: str) -> int:
        """Bytes of a file, or of all files of a folder."""
        files, at = self._at(name)
        return files.getContentSummary(at).getLength() if files.exists(at) else 0

    def text(self, name: str) -> str:
        files, at = self._at(name)
        stream = files.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Writes a file, over one of that name."""
        files, at = self._at(name)
        stream = files.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file with this text; False if there is one of that name, whoever wrote it."""
        files, final = self._at(name)
        if files.getUri().getScheme() == "file":
            path = final.toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            draft = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
            with open(draft, "w") as f:
                f.write(text)
            try:
                os.link(draft, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        draft = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self.put(draft, text)
        if files.rename(self._at(draft)[1], final):
            return True
        self.delete(draft)
        return False

    def delete(self, name: str = "") -> bool:
        files, at = self._at(name)
        return files.delete(at, True)


class Commits:
    """States of a table in numbered files: the last one counts, and of two writers on one state the second fails.

    ``guard`` is called before each commit; it raises for a writer that may not write any more.
    """

    def __init__(self, folder: Folder, guard: Callable[[], None] | None = None):
        self.folder, self.guard = folder, guard

    def last(self) -> tuple[int, dict]:
        """Number and state of the last commit; 0 and nothing before the first."""
        done = [x for x in self.folder.names("_commits") if not x.startswith(".")]
        return (int(done[-1]), json.loads(self.folder.text(f"_commits/{done[-1]}"))) if done else (0, {})

    def add(self, before: int, state: dict) -> int:
        if self.guard:
            self.guard()
        if not self.folder.create(f"_commits/{before + 1:012d}", json.dumps(state)):
            raise Conflict(f"{self.folder.root}: commit {before + 1} exists")
        return before + 1


class Lease:
    """Who may write: one run at a time, by numbered files of which only one writer can create the next.

    A holder that is silent for ``LEASE_SECONDS`` has lost its lease to whoever takes the
    next number, and ``check`` then fails for it, before each of its commits.
    """

    def __init__(self, folder: Folder, clock: Callable[[], float] = time.time):
        self.folder, self.clock, self.number = folder, clock, 0

    def _last(self) -> int:
        return max((int(x) for x in self.folder.names("_lease") if x.isdigit()), default=0)

    def holder(self) -> str | None:
        """The run that holds the lease now."""
        n = self._last()
        if not n or self.folder.exists(f"_lease/{n:012d}.done"):
            return None
        beat = f"_lease/{n:012d}.beat"
        taken = json.loads(self.folder.text(f"_lease/{n:012d}"))
        at = json.loads(self.folder.text(beat))["at"] if self.folder.exists(beat) else taken["at"]
        return taken["run"] if self.clock() - at < LEASE_SECONDS else None

    def take(self, run: str) -> None:
        """Takes the lease, or raises."""
        n, held = self._last(), self.holder()
        if held:
            raise Locked(f"run {held} is active")
        if not self.folder.create(f"_lease/{n + 1:012d}", json.dumps({"run": run, "at": self.clock()})):
            raise Locked("another run was faster")
        self.number = n + 1

    def check(self) -> None:
        if self._last() != self.number or self.folder.exists(f"_lease/{self.number:012d}.done"):
            raise Lost(f"lease {self.number} is no longer held")

    def beat(self) -> None:
        self.check()
        self.folder.put(f"_lease/{self.number:012d}.beat", json.dumps({"at": self.clock()}))

    def release(self) -> None:
        self.folder.put(f"_lease/{self.number:012d}.done", "")
