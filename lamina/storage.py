"""Files of a stripe table through Hadoop's file systems, so that a table may be on any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .errors import UnsafeStore

#: Stores whose rename fails atomically if the target exists. Others need the word of the user that one writer is at work.
RENAMES_ATOMICALLY = {"hdfs", "webhdfs", "ofs", "o3fs", "abfs", "abfss", "maprfs"}


class Store:
    def __init__(self, spark: SparkSession, root: str, single_writer: bool = False):
        self.spark, self.root, self.single_writer = spark, root.rstrip("/"), single_writer
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path(self.root).getFileSystem(self.conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(self.path(name) if name else self.root))

    def names(self, folder: str) -> list[tuple[str, int]]:
        """(file name, size) in a folder; none if there is no folder."""
        p = self._path(self.path(folder))
        if not self.fs.exists(p):
            return []
        return [(s.getPath().getName(), s.getLen()) for s in self.fs.listStatus(p) if s.isFile()]

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(self.path(name)))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def tail(self, name: str, size: int, length: int) -> bytes:
        """The last length bytes of a file of size bytes."""
        stream = self.fs.open(self._path(self.path(name)))
        try:
            stream.seek(max(0, size - length))
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(self.path(name)), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, temp: str, name: str) -> bool:
        """Move a complete file to a name that must be free: False if a rival has taken it.

        Rename without overwriting is atomic on HDFS and its like. Local file systems overwrite, so there a hard link
        is made, which fails if the name is taken. Object stores do neither: UnsafeStore, but for a single writer.
        """
        a, b = (self.fs.resolvePath(self._path(self.path(temp)).getParent()).suffix("/" + x.rpartition("/")[2]) for x in (temp, name))
        fs = a.getFileSystem(self.conf)
        scheme = self.scheme_of(a)
        if scheme == "file":
            files = self.spark._jvm.java.nio.file
            local = lambda p: files.Paths.get(p.toUri().getPath(), self.spark._sc._gateway.new_array(self.spark._jvm.java.lang.String, 0))
            try:
                files.Files.createLink(local(b), local(a))
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            finally:
                fs.delete(a, False)
            return True
        if scheme not in RENAMES_ATOMICALLY and not self.single_writer:
            fs.delete(a, False)
            raise UnsafeStore(f"{scheme}: can't publish a version there so that a rival's isn't lost; name single_writer=True if there is no rival")
        if fs.exists(b) or not fs.rename(a, b):
            fs.delete(a, False)
            return False
        return True

    @staticmethod
    def scheme_of(path) -> str:
        return path.toUri().getScheme()

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self._path(self.path(name)))

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(self.path(name) if name else self.root), True)

    def size(self, name: str = "") -> int:
        p = self._path(self.path(name) if name else self.root)
        return self.fs.getContentSummary(p).getLength() if self.fs.exists(p) else 0
