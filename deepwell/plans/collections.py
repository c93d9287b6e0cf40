"""Named knowledge bases below one folder."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..errors import InvalidInputError
from .config import Config
from .knowledge_base import KnowledgeBase

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}")


class Collections:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def collection(self, name: str, config: Config | None = None) -> KnowledgeBase:
        if not _NAME.fullmatch(name):
            raise InvalidInputError(f"collection {name!r}: letters, digits, _ . - and at most 64 of them")
        return KnowledgeBase(self.spark, f"{self.root}/{name}", config)

    def names(self) -> list[str]:
        if not self._fs.exists(self._path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path) if s.isDirectory())
