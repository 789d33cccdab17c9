"""The seen store as a growing table: a micro-batch adds its own rows and reads the folders that its hashes fall into.

Two layouts of the same rows, one looked up by URL and one by content, each by day and by the first characters of the hash.
Nothing is rewritten: what a batch writes follows its own size. Every row names the micro-batch that wrote it, and a batch reads
the rows of earlier ones only, so a replay finds what the first try found; rows it writes twice change no lookup. Retention reads
the days that count and drops the folders of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.scalars import ts_literal
from postlake.operators import dedup
from postlake.operators.store import PREFIX_CHARS, touched
from postlake.session import drop_path, materialize, path_exists

COLUMNS = ["url_hash", "content_hash", "desc_hash", "stored_at"]
SCHEMA = "url_hash string, content_hash string, desc_hash string, stored_at timestamp, epoch bigint, day date, prefix string"
SIDES = {"by-url": "url_hash", "by-content": "content_hash"}


class SeenStore:
    def __init__(self, spark: SparkSession, path: str, chars: int = PREFIX_CHARS, days: int = K.SEEN_RETENTION_DAYS):
        self.spark, self.path, self.chars, self.days = spark, path, chars, days

    def _side(self, side: str, epoch: int, as_of, held: list[str] | None = None) -> DataFrame:
        path = f"{self.path}/{side}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], SCHEMA).select(*COLUMNS)
        rows = self.spark.read.schema(SCHEMA).parquet(path).filter(F.col("epoch") < epoch)
        if as_of is not None:
            first = F.to_date(ts_literal(as_of) - F.expr(f"INTERVAL {self.days} DAYS"))
            rows = dedup.prune_seen(rows.filter(F.col("day") >= first), as_of, self.days)
        return (rows if held is None else touched(rows, "prefix", held)).select(*COLUMNS)

    def lookups(self, hashed: DataFrame, epoch: int, as_of) -> tuple[DataFrame, DataFrame]:
        """(by URL, by content): the rows of earlier batches in the folders that ``hashed`` touches and that still count."""
        held = hashed.select(*[F.collect_set(F.substring(c, 1, self.chars)).alias(side) for side, c in SIDES.items()]).first()
        by_url, by_content = (self._side(side, epoch, as_of, held[side]) for side in SIDES)
        return by_url, by_content

    def rows(self, as_of=None, epoch: int = 1 << 62) -> DataFrame:
        """The latest sighting of every URL, of those that still count where ``as_of`` is given."""
        latest = F.max_by(F.struct("content_hash", "desc_hash", "stored_at"), F.struct("stored_at", "content_hash", "desc_hash"))
        return self._side("by-url", epoch, as_of).groupBy("url_hash").agg(latest.alias("_r")).select("url_hash", "_r.*")

    def add(self, stored: DataFrame, epoch: int) -> None:
        """Append what a micro-batch stored to both layouts."""
        rows, path = materialize(stored.select(*COLUMNS), "seen-rows")
        for side, column in SIDES.items():
            rows.withColumns({"epoch": F.lit(epoch).cast("bigint"), "day": F.to_date("stored_at"), "prefix": F.substring(column, 1, self.chars)}) \
                .hint("rebalance", "day", "prefix").write.mode("append").partitionBy("day", "prefix").parquet(f"{self.path}/{side}")
        drop_path(self.spark, path)

    def expire(self, as_of) -> None:
        """Drop the folders of days that no longer count."""
        first = self.spark.range(1).select(
            F.date_format(ts_literal(as_of) - F.expr(f"INTERVAL {self.days} DAYS"), "yyyy-MM-dd")
        ).first()[0]
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for side in SIDES:
            root = hadoop_path(f"{self.path}/{side}")
            fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in fs.listStatus(root) if fs.exists(root) else []:
                name = status.getPath().getName()
                if name.startswith("day=") and name.removeprefix("day=") < first and name[4:5].isdigit():
                    fs.delete(status.getPath(), True)
