"""The job catalog: states, artifacts, requests, cleaning up."""

import json
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from quillstream.config import Settings
from quillstream.operators import jobs

def now():
    return F.lit("2024-05-01 10:00:00").cast("timestamp")


@pytest.fixture(scope="module")
def log(spark):
    ids = [f"j{k}" for k in range(6)]
    up = spark.createDataFrame([(i, None if i == "j0" else f"{i}.pdf", "application/pdf", 10) for i in ids], "id string, original_filename string, content_type string, file_size_bytes long")
    pick = lambda *k: up.where(F.col("id").isin(*k))
    parts = [
        jobs.created(up, F.lit(0), now()), jobs.running(pick("j1", "j2", "j3", "j4"), F.lit(1), now()), jobs.failed(pick("j1", "j4"), F.lit(2), now(), "INVALID_PDF", "x" * 5000),
        jobs.running(pick("j4"), F.lit(3), now()), jobs.classifying(pick("j2"), F.lit(2)), jobs.finalizing(pick("j2"), F.lit(3)), jobs.done(pick("j2"), F.lit(4), now(), json.dumps({"preguntas": 1})),
        jobs.event(pick("j5"), F.lit(1), status="expired"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.fixture(scope="module")
def artifacts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for name in ("preguntas_clasificadas.json", "preguntas.txt", "other.bin"):
        (folder / name).write_text('{"ok": true}')
    files = jobs.file_artifacts(spark.read.format("binaryFile").load(str(folder))).withColumn("job_id", F.lit("j2"))
    return jobs.registered(spark.createDataFrame([("j2", "old.json", "p", 1, None, None), ("j9", "preguntas.json", "/nowhere/preguntas.json", 1, None, None)], jobs.ARTIFACT), files, now())


def test_states(log):
    table = {r.id: r for r in jobs.jobs(log).collect()}
    assert [(table[f"j{k}"].status, table[f"j{k}"].stage, table[f"j{k}"].progress) for k in range(6)] == [
        ("queued", "queued", 0), ("failed", "finalizing", 100), ("done", "finalizing", 100), ("running", "extracting", 5), ("running", "extracting", 5), ("expired", "queued", 0),
    ]
    assert table["j0"].original_filename == "upload.pdf" and table["j0"].storage_path == "data/jobs/j0" and (table["j0"].expires_at - table["j0"].created_at).days == 7
    assert len(table["j1"].error_message) == 3900 and table["j4"].error_message is None is table["j4"].error_code and json.loads(table["j2"].summary) == {"preguntas": 1}
    assert jobs.illegal_transitions(log).count() == 0
    bad = log.unionByName(jobs.running(log.where("id = 'j5'").select("id").distinct(), F.lit(9), now()))
    assert [tuple(r) for r in jobs.illegal_transitions(bad).collect()] == [("j5", 9, "expired", "running")]
    assert jobs.jobs(log.limit(0)).count() == 0


def status_of(f, *args):
    with pytest.raises(jobs.JobError) as e:
        f(*args)
    return e.value.status, e.value.detail


def test_results(log, artifacts):
    table = jobs.jobs(log)
    got = jobs.get_result(table, artifacts, "j2", "http://h/")
    assert got["summary"] == {"preguntas": 1} and got["artifacts"] == {n: f"http://h/v1/jobs/j2/artifacts/{n}" for n in ("preguntas_clasificadas.json", "preguntas.txt")}
    ask = lambda i: status_of(jobs.get_result, table, artifacts, i, "http://h")
    assert ask("no") == (404, "Job not found.") and ask("j5") == (410, "Job expired.") and ask("j0") == (409, "Job status is queued.")
    assert ask("j1") == (409, {"error_code": "INVALID_PDF", "error_message": "x" * 3900})


def test_artifacts(log, artifacts, spark):
    table = jobs.jobs(log)
    row, content = jobs.get_artifact(table, artifacts, "j2", "preguntas_clasificadas.json")
    assert json.loads(content) == {"ok": True} and row.size_bytes == 12 and len(row.sha256) == 64
    ask = lambda i, n: status_of(jobs.get_artifact, table, artifacts, i, n)[0]
    assert ask("j2", "other.bin") == ask("no", "preguntas.json") == ask("j2", "preguntas.json") == 404
    more = table.unionByName(table.where("id = 'j2'").withColumn("id", F.lit("j9")))
    assert status_of(jobs.get_artifact, more, artifacts, "j9", "preguntas.json") == (404, "Artifact file 'preguntas.json' missing.")


def test_cleaning_up_and_deleting(log, artifacts):
    later = F.lit("2024-05-08 10:00:00").cast("timestamp")
    events, left, folders = jobs.clean_up(log, artifacts, F.lit(100), later)
    after = {r.id: r for r in jobs.jobs(log.unionByName(events)).collect()}
    assert {r.status for r in after.values()} == {"expired"} and after["j1"].error_code == "INVALID_PDF" and after["j0"].progress == 100
    assert [r.job_id for r in left.collect()] == ["j9"] and folders.count() == 5
    assert jobs.clean_up(log, artifacts, F.lit(100), F.lit("2024-05-08 09:59:59").cast("timestamp"))[0].count() == 0
    log2, art2 = jobs.deleted(log, artifacts, log.where("id = 'j2'").select("id").distinct())
    assert jobs.jobs(log2).count() == 5 and art2.count() == 1


def test_uploads_and_keys():
    assert status_of(jobs.check_upload, "text/plain", 5)[0] == status_of(jobs.check_upload, None, 5)[0] == 400
    assert status_of(jobs.check_upload, " Application/PDF ", (50 << 20) + 1)[0] == 413
    jobs.check_upload(" Application/PDF ", 50 << 20)
    own = Settings.from_env({"QUILLSTREAM_API_KEYS": " a, ,b ", "QUILLSTREAM_MAX_PDF_MB": "2", "QUILLSTREAM_CORS_ALLOW_ALL": "true", "QUILLSTREAM_CORS_ORIGINS": "x, y,"})
    assert jobs.check_key("b", own) == "b" and status_of(jobs.check_key, "c", own)[0] == status_of(jobs.check_key, None)[0] == 401
    assert own.max_pdf_bytes == 2 << 20 and own.cors_allow_all and own.cors_origin_list == ["x", "y"] and Settings().job_ttl_days == 7


def test_archive_health_and_tables(spark, tmp_path):
    assert jobs.png_zip({"a.txt": b""}) is None
    with zipfile.ZipFile(BytesIO(jobs.png_zip({"b.PNG": b"2", "a.png": b"1", "c.txt": b""}))) as z:
        assert z.namelist() == ["a.png", "b.PNG"]
    assert jobs.health(spark)["status"] == "ok"
    (tmp_path / "x").mkdir()
    assert jobs.remove_folder(spark, str(tmp_path / "x")) and not jobs.remove_folder(spark, str(tmp_path / "x"))
