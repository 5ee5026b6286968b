"""Registered queries, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cilake.plans import adapters
from cilake.session import dealt, is_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# shapes whose rows are documents or lines to be parsed
PARSED = {"LOG", "PAYLOAD", "DOC", "ACTION", "EXPR", "CHUNK"}
# those that cost milliseconds a row
DEALT = {"PAYLOAD", "ACTION"}


class Source:
    """The driver tables of one folder, and the shapes derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, deal: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in TABLES:
            if name in words:
                deal(self.table(name)).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def ad(self, name: str) -> DataFrame:
        deal = dealt if name in DEALT else spread if name in PARSED else lambda df: df
        return self.sql(adapters.SPARK.get(name) or adapters.SHAPES[name], deal)

    def stream(self, name: str, files_per_trigger: int = 64) -> DataFrame:
        """A driver table as a file stream; a table is one file or a folder of files."""
        path = f"{self.dir}/{name}.parquet"
        reader = self.spark.readStream.schema(self.table(name).schema).option("maxFilesPerTrigger", files_per_trigger)
        if is_folder(self.spark, path):
            return reader.parquet(path)
        # a stream's path has to be a folder
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.dir)


def query(name: str, oracle: str | None = None):
    """Register `fn(source)`; `oracle` may refer to shapes as {LOG} and so on."""

    def add(fn: Callable[[Source], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = adapters.fill(oracle)
        return fn

    return add
