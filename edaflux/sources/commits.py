"""Committed output of named files: write aside, record a manifest, replace name by name.

1. Spark writes to a staging folder of the writer (``_staging-<id>``), whose name readers skip. A writer that dies here
   leaves nothing that is read.
2. The staged files and the names they are to take are recorded in a manifest inside the staging folder, which appears
   whole, by a rename. From here on anyone can carry the commit out.
3. The folder's lock file is created, holding the id; creating it fails while another writer holds it.
4. Each staged file replaces the file of its name by one renaming overwrite, then surplus files of the name go. Every
   step can be repeated: a staged file that is gone has been moved already.
5. The staging folder and the lock are removed.

The holder of a lock keeps it fresh. One older than ``LEASE`` seconds belongs to a writer that died or gave up; whoever
comes next carries that manifest out first, so no commit stays half done. Of two writers of one name the later commit
stays, whole. A reader between the steps sees whole files, each of one commit or of the other.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import SparkSession

LEASE = 600.0
FRESH = 30.0  # how often a holder renews its lock
WAIT = 0.2
_CREATING = threading.Lock()
LOCK, MANIFEST, STAGING = "_commit.lock", "_manifest.json", "_staging-"


class Folder:
    """A folder on any Hadoop file system; every operation raises if it does not do what it says."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.jvm, self.path = jvm, path.rstrip("/")
        self.fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self.overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self.overwrite[0] = rename.OVERWRITE

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name)))

    def replace(self, source: str, target: str) -> None:
        """One file takes the place of another, or of none."""
        self.context.rename(self.at(source), self.at(target), self.overwrite)

    def remove(self, name: str) -> None:
        if not self.fs.delete(self.at(name), True) and self.exists(name):
            raise OSError(f"could not delete {self.path}/{name}")

    def create(self, name: str, text: str) -> bool:
        """A new file with ``text``; False if there is one already. Exclusive where the file system's creation is; on a local
        disk, which looks before it creates, among the threads of this process."""
        with _CREATING:
            try:
                out = self.fs.create(self.at(name), False)
            except Exception as e:  # the class differs between file systems
                if "AlreadyExists" in str(e) or "AlreadyBeingCreated" in str(e) or self.exists(name):
                    return False
                raise OSError(f"could not create {self.path}/{name}") from e
            out.write(bytearray(text.encode()))
            out.close()
        return True

    def read(self, name: str) -> str | None:
        """The file's text, or None if there is no such file."""
        try:
            stream = self.fs.open(self.at(name))
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise
        return text

    def age(self, name: str) -> float:
        """Seconds since the file was written; 0 if it is gone."""
        try:
            return time.time() - self.fs.getFileStatus(self.at(name)).getModificationTime() / 1000
        except Exception as e:
            if "FileNotFound" in str(e):
                return 0.0
            raise


    def touch(self, name: str, at: float) -> None:
        self.fs.setTimes(self.at(name), int(at * 1000), -1)


class Staged:
    """One writer's output on its way into ``folder``."""

    def __init__(self, folder: Folder, name: str | None = None):
        self.folder = folder
        self.name = name or STAGING + uuid.uuid4().hex
        self.path = f"{folder.path}/{self.name}"
        self.renewed = 0.0

    def record(self) -> None:
        """The manifest of what Spark wrote partitioned by ``_name``: for each name its staged files, in order."""
        names = {}
        for part in self.folder.names(self.name):
            if part.startswith("_name="):
                files = [f"{self.name}/{part}/{f}" for f in self.folder.names(f"{self.name}/{part}") if f.startswith("part-")]
                names[unquote(part.removeprefix("_name="))] = files
        self.folder.create(f"{self.name}/{MANIFEST}.new", json.dumps(names))
        self.folder.replace(f"{self.name}/{MANIFEST}.new", f"{self.name}/{MANIFEST}")

    def lock(self, lease: float = LEASE) -> None:
        while not self.folder.create(LOCK, self.name):
            if not recover(self.folder, lease):
                time.sleep(WAIT)
        self.renewed = time.time()

    def apply(self) -> None:
        """Carry the manifest out, from wherever it stopped. The caller holds the lock."""
        text = self.folder.read(f"{self.name}/{MANIFEST}")
        if text is not None:
            names = json.loads(text)
            with ThreadPoolExecutor(8) as pool:  # renames are round trips to the name node
                list(pool.map(lambda m: self._move(*m), [(f, final_name(n, k)) for n, files in names.items() for k, f in enumerate(files)]))
            for name in self.folder.names():
                stem, number = _numbered(name)
                if stem in names and number >= max(len(names[stem]), 1):
                    self.folder.remove(name)
        if self.folder.exists(self.name):
            self.folder.remove(self.name)

    def _move(self, source: str, target: str) -> None:
        if time.time() - self.renewed > FRESH:
            self.renewed = time.time()
            self.folder.touch(LOCK, self.renewed)
        try:
            self.folder.replace(source, target)
        except Exception as e:
            if self.folder.exists(source) or not self.folder.exists(target):
                raise OSError(f"could not replace {self.folder.path}/{target}") from e

    def commit(self) -> None:
        self.record()
        self.lock()
        try:
            self.apply()
        except BaseException:
            self.folder.touch(LOCK, 1.0)  # given up: whoever comes next carries the manifest out
            raise
        self.folder.remove(LOCK)


def final_name(name: str, number: int) -> str:
    """The file of a name, or the further ones of a name that fills several."""
    return f"{name}.{number + 1}.csv" if number else f"{name}.csv"


def _numbered(file: str) -> tuple[str, int]:
    found = re.fullmatch(r"(.*)\.(\d+)\.csv", file)
    if found:
        return found[1], int(found[2]) - 1
    return (file.removesuffix(".csv"), 0) if file.endswith(".csv") else ("", -1)


def recover(folder: Folder, lease: float = LEASE) -> bool:
    """Carry out the commit of a lock whose holder is gone; False if its holder may be at work."""
    holder = folder.read(LOCK)
    if holder is None:
        return True
    if folder.age(LOCK) <= lease:
        return False
    # Take the lock away by a rename, which only one of several can do, and see that it is still the one that was read.
    mine = f"_stale-{uuid.uuid4().hex}"
    try:
        folder.replace(LOCK, mine)
    except Exception:
        return True
    if folder.read(mine) != holder:
        folder.replace(mine, LOCK)
        return False
    folder.create(LOCK, holder)
    if holder.startswith(STAGING):
        Staged(folder, holder).apply()
    folder.remove(LOCK)
    folder.remove(mine)
    return True


@contextmanager
def staged(spark: SparkSession, path: str) -> Iterator[Staged]:
    """A staging folder to write to, partitioned by ``_name``; committed at the end, removed if the body fails."""
    folder = Folder(spark, path)
    aside = Staged(folder)
    try:
        yield aside
    except BaseException:
        if folder.exists(aside.name):
            folder.remove(aside.name)
        raise
    aside.commit()
