"""Storage providers: one protocol, and a provider over any file system that Hadoop knows."""

from __future__ import annotations

import hashlib
import time
from typing import Protocol

from pyspark.sql import SparkSession


class Storage(Protocol):
    """What a place of files must offer."""

    def prepare(self, folder: str) -> None: ...
    def files(self, folder: str = "") -> list[str]: ...
    def read(self, path: str) -> bytes: ...
    def publish(self, path: str, data: bytes) -> str: ...


class HadoopStorage:
    """Files below a root, by the session's file systems: local, object stores, or others."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def _at(self, path: str):
        if ".." in path.split("/"):
            raise ValueError(f"path leaves its root: {path}")
        target = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}".rstrip("/"))
        return target.getFileSystem(self.conf), target

    def prepare(self, folder: str) -> None:
        fs, at = self._at(folder)
        fs.mkdirs(at)

    def files(self, folder: str = "") -> list[str]:
        """Files of a folder in order; a folder that isn't there has none."""
        fs, at = self._at(folder)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile())

    def read(self, path: str) -> bytes:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, path: str, data: bytes) -> str:
        """Write under a partial name, rename over what was there, and return the content's SHA-256: readers see
        the old content or the new, never a part and never nothing, where the file system renames in one step."""
        fs, at = self._at(path)
        _, partial = self._at(f"{path}.partial")
        fs.mkdirs(at.getParent())
        stream = fs.create(partial, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options
        over = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self.jvm.java.lang.reflect.Array.set(over, 0, getattr(options, "Rename").OVERWRITE)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), self.conf)
        context.rename(fs.makeQualified(partial), fs.makeQualified(at), over)
        return hashlib.sha256(data).hexdigest()

    def wait_for(self, path: str, size: int, digest: str, timeout: float = 120, pause: float = 1.0) -> None:
        """Until the file is there with this size and digest; an error after ``timeout`` seconds."""
        until = time.monotonic() + timeout
        while True:
            fs, at = self._at(path)
            if fs.exists(at) and fs.getFileStatus(at).getLen() == size and hashlib.sha256(self.read(path)).hexdigest() == digest:
                return
            if time.monotonic() >= until:
                raise TimeoutError(f"{path} did not appear as written")
            time.sleep(pause)

    def copied(self, source: str, target: str) -> str:
        """A verified copy within the storage."""
        data = self.read(source)
        digest = self.publish(target, data)
        self.wait_for(target, len(data), digest)
        return digest

    def cleanup(self, prefix: str, suffix: str, dry_run: bool = True) -> list[str]:
        """Files of a folder with a suffix; they are deleted only if asked for."""
        found = [f"{prefix}/{n}".lstrip("/") for n in self.files(prefix) if n.endswith(suffix)]
        for path in [] if dry_run else found:
            fs, at = self._at(path)
            fs.delete(at, False)
        return found
