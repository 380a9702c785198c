"""Tables in layers: a change is written beside what is there, and readers merge the layers.

A layer is a folder of rows and, where it changes older rows, a folder with the
keys whose older rows it takes away (its deletion marks).  Rows are dealt to
buckets by the hash of a column, so whoever knows its values reads their
buckets only.  When the layers since some point weigh as much as the one before
them, they are merged into one, so there are about as many layers as the
logarithm of the changes, and a row is rewritten about as often.

A layer in a manifest is a dict: ``at`` (its folder), ``order`` (later layers
have greater ones), ``buckets``, ``gone`` (whether it has deletion marks) and
``bytes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.graph import checkpoint, holding
from quarrylight.sources.manifest import Manifests

BUCKET = "_bucket"
#: Rows of a bucket, and of a file, that are aimed at.
BUCKET_ROWS, FILE_ROWS, MOST_BUCKETS = 1_000_000, 4_000_000, 4096
#: Layers are merged when so many in a row weigh as much as the one before, up to this factor.
RUN, FACTOR = 4, 2.0


class Layers:
    """How one table is written and read; ``key`` tells the rows that change together, ``by`` is what buckets are made of."""

    def __init__(self, files: Manifests, root: str, columns: str, key: str, by: str | None = None, order: list[str] | None = None):
        self.files, self.spark, self.root, self.columns = files, files.spark, root, columns
        self.key, self.by, self.order = key, by or key, order or [key]
        fields = self.spark.createDataFrame([], columns).schema
        self.names, self.key_type, self.by_type = fields.names, fields[key].dataType, fields[self.by].dataType

    def write(self, rows: DataFrame, at: str, order: int, gone: DataFrame | None = None, n: int | None = None) -> dict:
        """A layer with these rows (``n`` of them, if known), which takes away older rows of the keys in ``gone``."""
        n = rows.count() if n is None else n
        buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
        salts = max(1, -(-n // (buckets * FILE_ROWS)))
        dealt = rows.select(*self.names).withColumn(BUCKET, _bucket(F.col(self.by), buckets))
        salt = F.pmod(F.xxhash64(*self.names), F.lit(salts))  # a hot value's rows go to several files
        spread = dealt.repartition(buckets * salts, BUCKET, salt).sortWithinPartitions(BUCKET, *self.order)
        spread.write.partitionBy(BUCKET).parquet(f"{self.root}/{at}/rows")
        if gone is not None:
            keys = gone.select(self.key).distinct()
            (keys.coalesce(1) if n < FILE_ROWS else keys).write.parquet(f"{self.root}/{at}/gone")
        return {"at": at, "order": order, "buckets": buckets, "rows": n, "gone": gone is not None, "bytes": self.files.size(f"{self.root}/{at}")}

    def read(self, layer: dict, values: list | None = None) -> DataFrame:
        """A layer's own rows; of the ``values`` of the bucket column alone, if given: only their buckets are read."""
        if not layer["rows"]:
            return self.spark.createDataFrame([], self.columns)
        df = self.spark.read.schema(f"{self.columns}, {BUCKET} int").parquet(f"{self.root}/{layer['at']}/rows")
        if values is not None:
            typed = [F.lit(v).cast(self.by_type) for v in values]  # a hash depends on the type
            df = df.filter(F.col(BUCKET).isin([_bucket(v, layer["buckets"]) for v in typed]) & F.col(self.by).isin(typed))
        return df.select(*self.names)

    def gone(self, layers: list[dict]) -> DataFrame | None:
        """(key, _order): up to which layer each key's rows are taken away."""
        marks = [self.spark.read.schema(f"{self.key} {self.key_type.simpleString()}").parquet(f"{self.root}/{x['at']}/gone").withColumn("_order", F.lit(x["order"])) for x in layers if x["gone"]]
        if not marks:
            return None
        every = marks[0]
        for part in marks[1:]:
            every = every.unionByName(part)
        return every.groupBy(F.col(self.key).alias("_key")).agg(F.max("_order").alias("_until"))

    def visible(self, layers: list[dict], values: list | None = None, narrowed=None) -> DataFrame:
        """The rows that count; ``narrowed`` may filter a layer's rows as they are read."""
        out = self.spark.createDataFrame([], self.columns).withColumn("_order", F.lit(0))
        for layer in layers:
            rows = self.read(layer, values)
            out = out.unionByName((narrowed(rows, layer) if narrowed else rows).withColumn("_order", F.lit(layer["order"])))
        marks = self.gone(layers)
        if marks is not None:
            out = out.join(marks, F.col(self.key).eqNullSafe(F.col("_key")) & (F.col("_order") < F.col("_until")), "left_anti")
        return out.drop("_order")

    def changed(self, layers: list[dict], rows: DataFrame) -> DataFrame:
        """(key, _n): the keys whose rows differ from the visible ones, and how many rows they have now, by one aggregation of either and a full join."""
        cells = [c for name in self.names for c in (F.col(name), F.col(name).isNull())]  # nulls leave a hash as it is
        summed = lambda df: df.groupBy(self.key).agg(F.count("*").alias("_n"), F.sum(F.xxhash64(*cells).cast("decimal(20,0)")).alias("_h"))
        new = summed(rows)
        if not layers:
            return new.select(self.key, "_n")
        old = summed(self.visible(layers)).toDF("_key", "_old_n", "_old_h")
        both = new.join(old, F.col(self.key).eqNullSafe(F.col("_key")), "full_outer")
        differs = ~(F.col("_n").eqNullSafe(F.col("_old_n")) & F.col("_h").eqNullSafe(F.col("_old_h")))
        return both.filter(differs).select(F.when(F.col("_n").isNotNull(), F.col(self.key)).otherwise(F.col("_key")).alias(self.key), F.coalesce("_n", F.lit(0).cast("long")).alias("_n"))

    def replace(self, layers: list[dict], rows: DataFrame, at: str, order: int) -> list[dict]:
        """Layers that show ``rows`` and nothing else; only keys whose rows differ are written."""
        return replaced({"": (self, layers, rows, at)}, order)[""]

    def merged(self, layers: list[dict], at: str) -> list[dict]:
        """The same rows in fewer layers, where the last ones have grown as heavy as the one before them."""
        first, total = len(layers) - 1, layers[-1]["bytes"]
        while first and layers[first - 1]["bytes"] < FACTOR * total:
            first -= 1
            total += layers[first]["bytes"]
        run = layers[first:]
        if len(run) < RUN:
            return layers
        # what the run takes away from layers before it stays taken away
        marks = self.gone(run).select(F.col("_key").alias(self.key)) if first and any(x["gone"] for x in run) else None
        return [*layers[:first], self.write(self.visible(run), at, run[-1]["order"], marks)]


def replaced(tables: dict[str, tuple[Layers, list[dict], DataFrame, str]], order: int) -> dict[str, list[dict]]:
    """:meth:`Layers.replace` for several tables (their writer, layers, rows and folder), whose changes are found by one query; keys are bigints."""
    with holding() as keep:
        rows, changes = {}, None
        for name, (table, layers, df, _) in tables.items():
            rows[name] = keep(df.select(*table.names))
            part = table.changed(layers, rows[name]).select(F.lit(name).alias("_table"), F.col(table.key).cast("bigint").alias("_key"), "_n")
            changes = part if changes is None else changes.unionByName(part)
        changes = checkpoint(changes)
        sizes = {r["_table"]: (r["keys"], r["n"]) for r in changes.groupBy("_table").agg(F.count("*").alias("keys"), F.sum("_n").alias("n")).collect()}
        out = {}
        for name, (table, layers, _, at) in tables.items():
            keys, n = sizes.get(name, (0, 0))
            if not layers:
                out[name] = [table.write(rows[name], at, order, n=n)]
            elif not keys:
                out[name] = layers
            else:
                own = changes.filter(F.col("_table") == name).select("_key")
                fresh = rows[name].join(own, F.col(table.key).eqNullSafe(F.col("_key")), "left_semi")
                out[name] = table.merged([*layers, table.write(fresh, at, order, own.withColumnRenamed("_key", table.key), n)], f"{at}-merged")
        return out


def _bucket(value, buckets: int):
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")
