"""Files and folders through Hadoop's file system API: what must appear whole or not at all."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """The file systems that a session knows."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, path: str):
        """The file system of a path; that of local files without checksums, which would turn against whoever edits a file by hand."""
        found = self._path(path).getFileSystem(self.conf)
        return found.getRawFileSystem() if found.getScheme() == "file" and hasattr(found, "getRawFileSystem") else found

    def exists(self, path: str) -> bool:
        return self._system(path).exists(self._path(path))

    def delete(self, path: str) -> None:
        self._system(path).delete(self._path(path), True)

    def write(self, path: str, text: str) -> None:
        """A file, in place of any of that name."""
        out = self._system(path).create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, path: str) -> str:
        system = self._system(path)
        size = system.getFileStatus(self._path(path)).getLen()
        source = system.open(self._path(path))
        try:
            return bytes(source.readNBytes(int(size))).decode()
        finally:
            source.close()

    def copy(self, source: str, target: str) -> None:
        util = self.jvm.org.apache.hadoop.fs.FileUtil
        util.copy(self._system(source), self._path(source), self._system(target), self._path(target), False, self.conf)

    def rename(self, source: str, target: str, replace: bool = False) -> None:
        """One step where the file system has one. Without ``replace`` a target that is there makes it fail."""
        kind = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("OVERWRITE" if replace else "NONE")
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._system(source).getUri(), self.conf).rename(self._path(source), self._path(target), how)

    def folders(self, path: str) -> list[tuple[int, str]]:
        """(time of change, name) of the folders in a folder, hidden ones left out."""
        if not self.exists(path):
            return []
        found = self._system(path).listStatus(self._path(path))
        return [(f.getModificationTime(), f.getPath().getName()) for f in found if f.isDirectory() and not f.getPath().getName().startswith((".", "_"))]
