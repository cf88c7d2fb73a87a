"""Stand-in tables of the catalogue queries, derived from the given tables.

The given tables hold no images or boxes; these views turn orders into
images, line items into boxes and events into a training log. The same text
runs in Spark SQL and in an ANSI SQL engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Later views may use earlier ones.
VIEWS = {
    "fx_images": """
SELECT o_orderkey AS image_id, concat('src', o_custkey % 4, '/images/', o_orderkey, '.jpg') AS file_name,
       concat('src', o_custkey % 4) AS source,
       CAST(320 + o_orderkey % 320 AS INT) AS width, CAST(240 + (o_orderkey * 7) % 240 AS INT) AS height
FROM {orders}""",
    "fx_boxes": """
SELECT md5(concat(l_orderkey,'|',l_partkey,'|',l_suppkey,'|',l_linenumber,'|',CAST(l_quantity AS INT))) AS ann_key,
       l_orderkey AS image_id, CASE l_returnflag WHEN 'A' THEN 18 WHEN 'N' THEN 1 ELSE 2 END AS category_id,
       CAST(l_partkey % 400 - 20 AS DOUBLE) AS x, CAST((l_suppkey * 13) % 300 - 20 AS DOUBLE) AS y,
       l_quantity * 8 - 16 AS w, l_quantity * 5 AS h, 0 AS iscrowd,
       round(l_discount * 10, 1) AS confidence,
       CASE l_returnflag WHEN 'A' THEN 'dog' WHEN 'N' THEN 'cat' END AS class
FROM {lineitem}""",
    "fx_sized": """
SELECT b.*, i.file_name, i.source, i.width, i.height
FROM {fx_boxes} b JOIN {fx_images} i ON b.image_id = i.image_id""",
    "fx_detections": """
SELECT ann_key, image_id, CAST(x AS INT) AS x1, CAST(y AS INT) AS y1, CAST(x + w AS INT) AS x2,
       CAST(y + h AS INT) AS y2, confidence, class, width, height
FROM {fx_sized}""",
    "fx_identities": """
SELECT o_orderkey AS image_id, concat('id_', lpad(CAST(o_custkey AS VARCHAR(10)), 6, '0')) AS identity,
       concat('data/id_', o_custkey, '/', o_orderkey, '.jpg') AS file_path,
       o_custkey % 10 = 0 AS is_priority
FROM {orders}""",
    "fx_probes": """
SELECT vec_id AS id, CASE WHEN vec_id % 10 = 9 THEN NULL ELSE label END AS identity_gt,
       vec_id % 7 <> 3 AS has_pred, embedding
FROM {embeddings}""",
    "fx_history": """
SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS epoch,
       CASE WHEN event_id % 2 = 0 THEN 'warmup' ELSE 'full_training' END AS phase, value AS map_score
FROM {events}""",
    "fx_runs": """
SELECT concat(event_type, '_run', event_id) AS name, ts AS modified FROM {events}""",
}

TABLES = ("orders", "lineitem", "embeddings", "events")


class Tables:
    """The given tables and the views over them, for one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._views: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            text = VIEWS[name]
            needed = {k: self.view(k) for k in VIEWS if "{" + k + "}" in text}
            needed |= {k: self.read(k) for k in TABLES if "{" + k + "}" in text}
            self._views[name] = self.spark.sql(text, **needed)
        return self._views[name]

    @cached_property
    def items(self) -> DataFrame:
        """Embeddings as ``id, label, embedding``."""
        return self.read("embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" in VIEWS:
            return self.view(f"fx_{name}")
        raise AttributeError(name)


def with_views(body: str, *extra: str) -> str:
    """``body`` as one SQL statement, headed by the views it names and ``extra`` CTEs."""
    used: list[str] = []

    def use(text: str) -> None:
        for name in VIEWS:
            if name in text and name not in used:
                use(VIEWS[name])
                used.append(name)

    use(body + " ".join(extra))
    plain = {k: k for k in (*VIEWS, *TABLES)}
    heads = [f"{name} AS ({VIEWS[name].format(**plain)})" for name in used]
    heads += list(extra)
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
