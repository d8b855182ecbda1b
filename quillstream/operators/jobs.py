"""Job catalog as an append-only event log with a latest-state view, artifacts and expiry.

A job's event sets the fields that are not null, and those named in ``cleared`` to null. Events carry ``at``, the time,
and ``seq``, their number in the log, which orders them. All functions return DataFrames; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ARTIFACTS, UPLOAD_TYPES, Settings

FIELDS = {
    "status": "string", "stage": "string", "progress": "int", "original_filename": "string", "content_type": "string", "file_size_bytes": "long", "storage_path": "string",
    "error_code": "string", "error_message": "string", "created_at": "timestamp", "started_at": "timestamp", "finished_at": "timestamp", "expires_at": "timestamp", "summary": "string",
}
EVENT = "id string, seq long, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", cleared array<string>"
ARTIFACT = "job_id string, name string, path string, size_bytes long, sha256 string, created_at timestamp"
#: Which status may follow which.
FOLLOWS = {None: ("queued",), "queued": ("running", "failed", "expired"), "running": ("running", "done", "failed", "expired"), "done": ("running", "expired"), "failed": ("running", "expired"), "expired": ()}
MOST_MESSAGE = 3900


class JobError(Exception):
    """A request that cannot be served, with its HTTP status."""

    def __init__(self, status: int, detail):
        super().__init__(detail)
        self.status, self.detail = status, detail


def latest_state(events: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The state of each job: for every field the last event that sets it.

    A null sets nothing unless a column ``<field>_set`` is true or the field is among ``cleared``. Events with equal
    order are taken in any order.
    """
    at = F.struct(*order)
    aggs = []
    for f in fields:
        given = F.col(f).isNotNull()
        if f"{f}_set" in events.columns:
            given = given | F.coalesce(F.col(f"{f}_set"), F.lit(False))
        if "cleared" in events.columns:
            given = given | F.coalesce(F.array_contains("cleared", f), F.lit(False))
        aggs.append(F.max_by(F.col(f), F.when(given, at)).alias(f))
    return events.groupBy(key).agg(*aggs)


def jobs(events: DataFrame) -> DataFrame:
    """The job table: one row per id with every field."""
    return latest_state(events, "id", ["seq"], list(FIELDS))


def event(ids: DataFrame, seq: Column, cleared: tuple = (), **fields) -> DataFrame:
    """An EVENT row for each id of ids with the given fields (values or columns of ids)."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    cols = [value(fields.get(k)).cast(t).alias(k) for k, t in FIELDS.items()]
    return ids.select("id", seq.cast("long").alias("seq"), *cols, F.array(*(F.lit(c) for c in cleared)).cast("array<string>").alias("cleared"))


def created(uploads: DataFrame, seq: Column, now: Column, settings: Settings = Settings()) -> DataFrame:
    """First events of uploads (id, original_filename, content_type, file_size_bytes); they expire after the settings' days."""
    path = F.concat(F.lit(f"{settings.data_dir.rstrip('/')}/"), F.col("id"))
    name, kind = F.coalesce("original_filename", F.lit("upload.pdf")), F.coalesce("content_type", F.lit("application/pdf"))
    given = {"original_filename": name, "content_type": kind, "file_size_bytes": F.col("file_size_bytes"), "storage_path": path}
    return event(uploads, seq, status="queued", stage="queued", progress=0, created_at=now, expires_at=now + F.make_dt_interval(F.lit(settings.job_ttl_days)), **given)


def running(ids: DataFrame, seq: Column, now: Column) -> DataFrame:
    return event(ids, seq, ("error_code", "error_message"), status="running", stage="extracting", progress=5, started_at=now)


def classifying(ids: DataFrame, seq: Column) -> DataFrame:
    return event(ids, seq, stage="classifying", progress=70)


def finalizing(ids: DataFrame, seq: Column) -> DataFrame:
    return event(ids, seq, stage="finalizing", progress=90)


def done(ids: DataFrame, seq: Column, now: Column, summary) -> DataFrame:
    return event(ids, seq, status="done", stage="finalizing", progress=100, finished_at=now, summary=summary)


def failed(ids: DataFrame, seq: Column, now: Column, code, message) -> DataFrame:
    """The message is cut to 3900 characters."""
    message = message if isinstance(message, Column) else F.lit(message)
    return event(ids, seq, status="failed", stage="finalizing", progress=100, finished_at=now, error_code=code, error_message=F.substring(message, 1, MOST_MESSAGE))


def illegal_transitions(events: DataFrame) -> DataFrame:
    """id, seq, before, status of the events whose status may not follow the one before (null: none)."""
    from pyspark.sql import Window as W

    rows = events.where("status is not null").withColumn("before", F.lag("status").over(W.partitionBy("id").orderBy("seq")))
    legal = F.lit(False)
    for before, after in FOLLOWS.items():
        legal = legal | (F.col("before").eqNullSafe(F.lit(before)) & F.col("status").isin(*after) if after else F.lit(False))
    return rows.where(~legal).select("id", "seq", "before", "status")


def expired(table: DataFrame, now: Column) -> DataFrame:
    """Jobs whose time is over and that are not marked so; a null expires_at never expires."""
    return table.where((F.col("expires_at") <= now) & (F.col("status") != "expired"))


def clean_up(events: DataFrame, artifacts: DataFrame, seq: Column, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events that expire the jobs whose time is over (their errors stay), the artifacts left, and the folders to remove."""
    gone = expired(jobs(events), now)
    left = artifacts.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti")
    return event(gone, seq, status="expired", stage="finalizing", progress=100), left, gone.select("id", "storage_path")


def deleted(events: DataFrame, artifacts: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log and artifacts without the jobs of ids."""
    return events.join(ids.select("id"), "id", "left_anti"), artifacts.join(ids.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def file_artifacts(files: DataFrame) -> DataFrame:
    """Artifact rows (name, path, size_bytes, sha256) of a binaryFile DataFrame; only allowed names."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256")).where(F.col("name").isin(*ARTIFACTS))


def registered(artifacts: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """artifacts with those of files' jobs replaced. files: job_id, name, path, size_bytes, sha256; the name must be allowed."""
    kept = artifacts.join(files.select("job_id").distinct(), "job_id", "left_anti").select("job_id", "name", "path", "size_bytes", "sha256", "created_at")
    fresh = files.where(F.col("name").isin(*ARTIFACTS)).select("job_id", "name", "path", F.col("size_bytes").cast("long").alias("size_bytes"), "sha256", now.cast("timestamp").alias("created_at"))
    return kept.unionByName(fresh)


def links(artifacts: DataFrame, base: str) -> DataFrame:
    """job_id, artifacts: a map of each job's artifact names to their addresses."""
    url = F.concat(F.lit(f"{base.rstrip('/')}/v1/jobs/"), F.col("job_id"), F.lit("/artifacts/"), F.col("name"))
    pairs = artifacts.select("job_id", F.struct("name", url.alias("url")).alias("__p")).distinct()
    return pairs.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list("__p"))).alias("artifacts"))


def check_upload(content_type: str | None, size: int, settings: Settings = Settings()) -> None:
    """Raises 400 for a content type that is no PDF's and 413 for too many bytes."""
    if (content_type or "").lower().strip() not in UPLOAD_TYPES:
        raise JobError(400, "Only PDF uploads are allowed.")
    if size > settings.max_pdf_bytes:
        raise JobError(413, f"PDF exceeds maximum size of {settings.max_pdf_bytes} bytes.")


def check_key(key: str | None, settings: Settings = Settings()) -> str:
    """Raises 401 unless the key is among the settings' keys."""
    if not key or key not in settings.api_key_set:
        raise JobError(401, "Invalid or missing API key.")
    return key


def get_job(table: DataFrame, job_id: str):
    """The job's row; raises 404."""
    row = table.where(F.col("id") == job_id).first()
    if row is None:
        raise JobError(404, "Job not found.")
    return row


def get_result(table: DataFrame, artifacts: DataFrame, job_id: str, base: str) -> dict:
    """job_id, status, artifacts (name to address) and summary of a finished job; raises 404, 410 (expired) or 409."""
    import json

    job = get_job(table, job_id)
    if job.status == "expired":
        raise JobError(410, "Job expired.")
    if job.status == "failed":
        raise JobError(409, {"error_code": job.error_code, "error_message": job.error_message})
    if job.status != "done":
        raise JobError(409, f"Job status is {job.status}.")
    found = links(artifacts.where(F.col("job_id") == job_id), base).first()
    return {"job_id": job_id, "status": job.status, "artifacts": found.artifacts if found else {}, "summary": job.summary and json.loads(job.summary)}


def get_artifact(table: DataFrame, artifacts: DataFrame, job_id: str, name: str):
    """The artifact's row and its bytes; raises 404 for a name that is not allowed, an unknown job, row or file.

    The job's status does not matter, so artifacts are served until they are cleaned up.
    """
    if name not in ARTIFACTS:
        raise JobError(404, "Artifact not found.")
    get_job(table, job_id)
    row = artifacts.where((F.col("job_id") == job_id) & (F.col("name") == name)).first()
    if row is None:
        raise JobError(404, f"Artifact '{name}' not found.")
    try:
        content = table.sparkSession.read.format("binaryFile").load(row.path).first().content
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "FILE_NOT_EXIST" in str(e):
            raise JobError(404, f"Artifact file '{name}' missing.") from e
        raise
    return row, bytes(content)


def health(spark: SparkSession) -> dict:
    """status ok if a query runs, else error."""
    try:
        spark.sql("SELECT 1").collect()
    except Exception:  # any failure means not ready
        return {"status": "error", "engine": "error"}
    return {"status": "ok", "engine": "ok"}


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The event log and the artifact table in the catalog, as Parquet."""
    for name, schema in (("job_events", EVENT), ("job_artifacts", ARTIFACT)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING PARQUET")


def drop_tables(spark: SparkSession, database: str = "default") -> None:
    for name in ("job_artifacts", "job_events"):
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Deletes a folder in whatever store it lies; False if there was none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def png_zip(files: dict[str, bytes]) -> bytes | None:
    """A zip archive of the PNG files among files, None if there is none."""
    import io
    import zipfile

    images = {k: v for k, v in sorted(files.items()) if k.lower().endswith(".png")}
    if not images:
        return None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in images.items():
            z.writestr(name, data)
    return out.getvalue()
