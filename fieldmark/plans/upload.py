"""Uploads: landed CSV or JSON, judged row by row, to a stored table, its column rows and a closing version.

A file is read with the schema its owner declared. What does not parse is kept as text, so that no row
is lost silently: it becomes a row of the reject table with its reasons. The upload is ``ready`` if at
most a stated share of its rows is bad, and ``error`` otherwise; then nothing is replaced.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.operators.registry import profile_upload
from fieldmark.operators.versions import commit, heads
from fieldmark.schemas import DATASET_COLUMNS, DATASETS
from fieldmark.session import discard, materialise
from fieldmark.sources.coerce import project_to
from fieldmark.sources.sinks import replace_partitions, replace_table

KEY = "dataset_id"
#: share of bad rows up to which an upload is accepted
MOST_BAD = 0.05
DATASET_LOG = T.StructType(
    DATASETS.fields
    + [T.StructField("seq", T.LongType(), False), T.StructField("based_on", T.LongType()), T.StructField("writer", T.StringType(), False)]
)
REJECTS = "dataset_id string, line string, reasons array<string>"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def read_judged(spark: SparkSession, path: str, kind: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, str, str]:
    """The landed rows, stored, and the names of their two extra columns: the text of a row that does not parse, and reasons.

    A row is bad if it has other columns than declared, a value that is not of the declared type, broken
    syntax, or a null in a required column (``nullable=False``). ``kind`` is csv or json; JSON has an
    object or an array of objects a line.
    """
    line, reasons = "_line", "_reasons"
    while line in schema.fieldNames() or reasons in schema.fieldNames():
        line, reasons = line + "_", reasons + "_"
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields] + [T.StructField(line, T.StringType())])
    reader = spark.read.schema(loose).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", line)
    if kind == "csv":
        rows = reader.option("header", str(header).lower()).csv(path)
    elif kind == "json":
        rows = reader.json(path)
    else:
        raise ValueError(f"unsupported kind of file {kind!r}; known: csv, json")
    missing = [F.when(F.col(f.name).isNull() & F.col(line).isNull(), F.lit(f"missing {f.name}")) for f in schema.fields if not f.nullable]
    found: list[Column] = [F.when(F.col(line).isNotNull(), F.lit("malformed")), *missing]
    return materialise(rows.withColumn(reasons, F.array_compact(F.array(*found))), "landed"), line, reasons


def add_upload(spark: SparkSession, log_path: str, dataset_id: str, name: str, file_path: str, **more) -> None:
    """First version of a dataset, ``uploading``."""
    values = {KEY: dataset_id, "name": name, "file_path": file_path, "status": "uploading", **more}
    at = _now()
    values |= {"upload_date": at, "created_at": at, "updated_at": at, "seq": 1}
    _commit(spark, log_path, values, uuid.uuid4().hex)


def _commit(spark: SparkSession, log_path: str, values: dict, writer: str) -> None:
    types = {f.name: f.dataType for f in DATASET_LOG.fields}
    row = spark.range(1).select(*[F.lit(values.get(c)).cast(t).alias(c) for c, t in types.items() if c != "writer"])
    commit(spark, log_path, row, KEY, writer)


def dataset_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DATASET_LOG).parquet(path)


def process_upload(
    spark: SparkSession,
    dataset_id: str,
    schema: T.StructType,
    log_path: str,
    tables: str,
    columns_path: str,
    rejects_path: str,
    kind: str = "csv",
    header: bool = True,
    most_bad: float = MOST_BAD,
) -> str:
    """Bring one uploading dataset to ``ready`` or ``error``; the status.

    Accepted rows replace the table ``tables``/dataset_id, its column rows and its rejects replace those of the
    upload before. A refused upload leaves table and columns as they were, and its rejects to look at.
    Whatever fails on the way is the message of an ``error`` version, and is raised.
    """
    row = heads(dataset_log(spark, log_path).where(F.col(KEY) == dataset_id), KEY).first()
    if row is None:
        raise LookupError(f"no dataset {dataset_id!r}")
    if row["status"] != "uploading":
        raise ValueError(f"{dataset_id} is {row['status']!r}, not 'uploading'")
    closing = {**row.asDict(), "status": "error", "based_on": row["seq"], "seq": row["seq"] + 1}
    try:
        judged, line, reasons = read_judged(spark, row["file_path"], kind, schema, header)
        bad = F.size(reasons) > 0
        n, n_bad = judged.agg(F.count("*"), F.count_if(bad)).first()
        names = schema.fieldNames()
        text = F.coalesce(line, F.to_json(F.struct(*names)))
        lost = judged.where(bad).select(F.lit(dataset_id).alias(KEY), text.alias("line"), F.col(reasons).alias("reasons"))
        replace_partitions(lost, rejects_path, ["line"], KEY)
        if n == 0 or n_bad > most_bad * n:
            closing["error_message"] = f"{n_bad} of {n} rows are bad, more than {most_bad:g} of them"
        else:
            good = judged.where(~bad).select(*names)
            replace_table(good, f"{tables.rstrip('/')}/{dataset_id}")
            at = F.lit(_now())
            profile = profile_upload(good, dataset_id).withColumns({"is_join_key": F.lit(False), "created_at": at, "updated_at": at})
            replace_partitions(project_to(profile, DATASET_COLUMNS), columns_path, ["column_name"], KEY)
            closing |= {"status": "ready", "row_count": n - n_bad, "column_count": len(names), "error_message": None}
        discard(judged)
    except Exception as error:
        closing["error_message"] = str(error)
        raise
    finally:
        closing["updated_at"] = _now()
        _commit(spark, log_path, closing, uuid.uuid4().hex)
    return closing["status"]
