"""Source builders and their union.

A source is registered as ``builder(spark, **raw) -> DataFrame`` returning the
canonical item columns. ``union_sources`` tags rows with the source name and its
position, skips a builder that fails while its plan is built (recorded in a status
list), and concatenates the rest with ``unionByName`` (no shuffle). With ``run``, each
source is also executed on its own, so one that fails while running is skipped too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANONICAL = ["source", "title", "link", "creation_date", "input"]
Builder = Callable[..., DataFrame]


class SourceRegistry:
    def __init__(self) -> None:
        self._builders: dict[str, Builder] = {}

    def register(self, name: str, builder: Builder) -> None:
        self._builders[name] = builder

    def names(self) -> list[str]:
        return list(self._builders)

    def union(self, spark: SparkSession, only: str | None = None,
              run: Callable[[DataFrame], DataFrame] | None = None, **raw) -> tuple[DataFrame, list[dict]]:
        """A3/A4: union of all (or one) registered sources, tagged with ``config_path``
        and ``source_ord``; unknown ``only`` gives an empty frame and a status row
        listing the known names. ``run`` (for example a checkpoint) executes each source's
        frame before the union."""
        status: list[dict] = []
        names = self.names()
        if only is not None:
            if only not in self._builders:
                status.append({"source": only, "status": "unknown", "known": names})
                names = []
            else:
                names = [only]
        parts = []
        for pos, name in enumerate(self.names()):
            if name not in names:
                continue
            try:
                df = self._builders[name](spark, **raw)
                df = df.select(*[c for c in df.columns if c not in ("config_path", "source_ord")])
                df = df.withColumn("config_path", F.lit(name)).withColumn("source_ord", F.lit(pos))
                parts.append(df if run is None else run(df))
                status.append({"source": name, "status": "ok"})
            except Exception as exc:  # noqa: BLE001 - one failing source must not stop the rest
                status.append({"source": name, "status": "failed", "error": str(exc)})
        if not parts:
            schema = ", ".join(f"{c} string" for c in CANONICAL) + ", config_path string, source_ord int"
            return spark.createDataFrame([], schema), status
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), status
