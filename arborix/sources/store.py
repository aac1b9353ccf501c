"""Documents, section nodes, workflows and vectors kept as Parquet tables that are only added to.

Each call adds one load. Readers take the newest load of a key, so a document, or a vector, is replaced by writing it
again, and nothing is rewritten. Nodes are written before the document rows that name their load: a load that fails on
the way is never seen.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "documents": "doc_pk long, doc_name string, company string, year_period string, checksum string, created_at timestamp, load long",
    "nodes": "doc_pk long, node_id string, parent_id string, structure string, title string, start_index long, end_index long, summary string, node_text string",
    "workflows": "workflow_id long, company string, data_source string, year_periods array<string>, metric_count long, event_count long, statement string, created_at timestamp",
    "vectors": "id string, title string, content string, source_path string, chunk_index long, embedding array<float>, load long",
}


def init(spark: SparkSession, root: str) -> None:
    """Makes the tables that are not there yet. Columns that a table lacks are read as nulls, so new ones need no rewrite."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def _add(df: DataFrame, root: str, name: str) -> None:
    columns = [f.split(" ")[0] for f in TABLES[name].split(", ")]
    df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in columns]).to(df.sparkSession.createDataFrame([], TABLES[name]).schema).write.mode("append").parquet(f"{root}/{name}")


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The rows of each key's last load; only keys and load numbers are summed."""
    last = rows.groupBy(key).agg(F.max("load").alias("load"))
    return rows.join(last, [key, "load"], "left_semi")


def register(docs: DataFrame, nodes: DataFrame, root: str) -> None:
    """Adds documents (doc_name, company, year_period, raw_json) and their nodes (doc_name and the columns of ``nodes``).

    A document replaces the one of its name, whatever company and year that had. Names that are null or occur twice are refused.
    """
    if docs.where("doc_name is null").limit(1).count() or docs.groupBy("doc_name").count().where("count > 1").limit(1).count():
        raise ValueError("a load needs one row for each doc_name")
    load = time.time_ns()
    key = F.xxhash64("doc_name", F.lit(load)).alias("doc_pk")
    _add(nodes.withColumn("doc_pk", key), root, "nodes")
    _add(docs.withColumns({"doc_pk": key, "checksum": F.sha2(F.coalesce("raw_json", F.lit("")), 256), "created_at": F.current_timestamp(), "load": F.lit(load)}), root, "documents")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """The documents that count: the newest load of each name."""
    return _newest(_table(spark, root, "documents"), "doc_name")


def nodes(spark: SparkSession, root: str) -> DataFrame:
    """The nodes of the documents that count."""
    return _table(spark, root, "nodes").join(documents(spark, root).select("doc_pk"), "doc_pk", "left_semi")


def document(spark: SparkSession, root: str, identifier: int | str) -> DataFrame:
    """The document with that key (a number) or name (text); none is an error."""
    found = documents(spark, root).where(F.col("doc_pk" if isinstance(identifier, int) else "doc_name") == identifier)
    if not found.limit(1).count():
        raise LookupError(f"no document {identifier!r}")
    return found


def latest(spark: SparkSession, root: str) -> DataFrame:
    """The last document of each company and year; of equal times the one with the larger key."""
    found = documents(spark, root)
    return found.groupBy("company", "year_period").agg(F.max_by(F.struct("doc_pk", "doc_name", "created_at"), F.struct("created_at", "doc_pk")).alias("d")).select("company", "year_period", "d.*")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their numbers of nodes, zero included."""
    counted = _table(spark, root, "nodes").groupBy("doc_pk").agg(F.count(F.lit(1)).alias("node_count"))
    return documents(spark, root).join(counted, "doc_pk", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def companies(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).where("company <> ''").select("company").distinct()


def save_workflows(statements: DataFrame, root: str, *, data_source: str) -> None:
    """One workflow for each company of a statement table: its years, its distinct metrics, and the rows themselves as JSON.

    A company's statement has a few hundred rows, which meet in one value.
    """
    row = F.struct("year_period", "section_rank", "row_rank", "section", "canonical_name", "value", "status", "resolution_method")
    made = statements.groupBy("company").agg(
        F.array_sort(F.collect_set("year_period")).alias("year_periods"),
        F.count_distinct("canonical_name").alias("metric_count"),
        F.count(F.lit(1)).alias("event_count"),
        F.to_json(F.array_sort(F.collect_list(row)), {"ignoreNullFields": "false"}).alias("statement"),
    )
    _add(made.withColumns({"workflow_id": F.xxhash64("company", F.lit(time.time_ns())), "data_source": F.lit(data_source), "created_at": F.current_timestamp()}), root, "workflows")


def history(spark: SparkSession, root: str, company: str | None = None) -> DataFrame:
    """Workflows without their statements, the newest first."""
    found = _table(spark, root, "workflows").drop("statement")
    return (found.where(F.col("company") == company) if company else found).orderBy(F.desc("created_at"), "workflow_id")


def workflow(spark: SparkSession, root: str, workflow_id: int) -> DataFrame:
    """One workflow with its statement; none is an error."""
    found = _table(spark, root, "workflows").where(F.col("workflow_id") == workflow_id)
    if not found.limit(1).count():
        raise LookupError(f"no workflow {workflow_id}")
    return found


def add_vectors(rows: DataFrame, root: str, *, dimension: int) -> None:
    """Adds or replaces vectors by id. A vector of another length fails the load before anything of it counts."""
    fits = F.size("embedding") == dimension
    checked = rows.where(fits | F.raise_error(F.concat(F.lit(f"not {dimension} numbers: "), F.col("id"))).isNotNull())
    _add(checked.withColumn("load", F.lit(time.time_ns())), root, "vectors")


def vectors(spark: SparkSession, root: str) -> DataFrame:
    return _newest(_table(spark, root, "vectors"), "id").drop("load")
