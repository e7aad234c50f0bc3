"""File systems by Hadoop's API, so that any path Spark reads can also be listed, renamed and written as one file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


class Files:
    """The file system of each path given, local or not."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _of(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p)

    def is_folder(self, path: str) -> bool:
        fs, p = self._of(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def names(self, folder: str) -> list[str]:
        fs, p = self._of(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def rename(self, old: str, new: str) -> None:
        fs, p = self._of(old)
        if not fs.rename(p, self._of(new)[1]):
            raise OSError(f"can't rename {old} to {new}")

    def delete(self, path: str) -> None:
        fs, p = self._of(path)
        fs.delete(p, True)

    def write(self, path: str, pieces: Iterable[str | tuple[str, int]]) -> None:
        """One file from texts and from folders of part files, whose bytes are copied in order; the number is how many of a folder's first bytes go."""
        fs, p = self._of(path)
        out = fs.create(p, True)
        try:
            for piece in pieces:
                if isinstance(piece, str):
                    out.write(piece.encode())
                    continue
                folder, skip = piece
                for name in [n for n in self.names(folder) if n.startswith("part-")]:
                    part_fs, part = self._of(f"{folder}/{name}")
                    if part_fs.getFileStatus(part).getLen() <= skip:
                        continue
                    with_skip = part_fs.open(part)
                    try:
                        with_skip.seek(skip)
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(with_skip, out, 1 << 16, False)
                    finally:
                        with_skip.close()
                    skip = 0
        finally:
            out.close()
