"""Named datasets: temporary views plus a small table of where they came from."""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.sizing import local_frame
from plumbline.operators.overview import dataset_summary, dataset_totals


class Registry:
    """Datasets by name.  The data stays in Spark; this holds only their descriptions."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._facts: dict[str, dict] = {}

    def register(self, name: str, df: DataFrame, source_type: str, file_name: str | None = None,
                 query: str | None = None, sheet: str | None = None) -> None:
        df.createOrReplaceTempView(name)
        self._facts[name] = {"source_type": source_type, "file_name": file_name, "query": query, "sheet": sheet,
                             "loaded_at": datetime.now(timezone.utc)}

    def replace(self, name: str, df: DataFrame) -> None:
        """New data under the same description."""
        if name not in self._facts:
            raise KeyError(name)
        df.createOrReplaceTempView(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._facts:
            raise KeyError(name)
        return self.spark.table(name)

    def source_type(self, name: str) -> str:
        return self._facts[name]["source_type"]

    def names(self) -> list[str]:
        return list(self._facts)

    def query(self, text: str, limit: int | None = None) -> DataFrame:
        """SQL over the registered datasets."""
        df = self.spark.sql(text)
        return df if limit is None else df.limit(limit)

    def describe(self) -> DataFrame:
        """One row per dataset: name, source_type, file_name, query, sheet, loaded_at."""
        rows = self._facts
        text = pa.string()
        return local_frame(self.spark, {
            "name": (text, list(rows)),
            **{k: (text, [r[k] for r in rows.values()]) for k in ("source_type", "file_name", "query", "sheet")},
            "loaded_at": (pa.timestamp("us", tz="UTC"), [r["loaded_at"] for r in rows.values()])})

    def summaries(self) -> DataFrame:
        """One summary row per dataset."""
        parts = [dataset_summary(self.get(n), n, self.source_type(n)) for n in self.names()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def totals(self) -> DataFrame:
        return dataset_totals(self.summaries())
