import json

from pyspark.sql import functions as F

from emberfold.functions.labels import status_severity
from emberfold.operators import logs


def test_json_and_readable_lines(spark):
    df = spark.sql("""SELECT timestamp_micros(1700000000123456) AS at, 'api.request\n' AS event, 503 AS status,
        'token=abc' AS note, CAST(NULL AS STRING) AS missing, 1.5D AS duration_ms""")
    level = status_severity(F.col("status"))
    fields = ["status", "note", "missing", "duration_ms"]
    row = df.select(logs.json_line(df, "at", level, "event", fields, ["abc"]).alias("j"),
                    logs.readable_line(df, "at", level, "event", fields, ["abc"]).alias("r")).first()
    assert json.loads(row.j) == {
        "timestamp": "2023-11-14T22:13:20.123Z", "severity": "ERROR", "message": "api.request ",
        "event": "api.request ", "status": 503, "note": "token=[REDACTED]", "missing": None, "duration_ms": 1.5}
    assert row.r == ('2023-11-14T22:13:20.123Z | ERROR | api.request  | '
                     'status=503 note="token=[REDACTED]" missing=null duration_ms=1.5')


def test_clean_events(spark):
    df = spark.createDataFrame(
        [("a secret\x00 b", "6fa459ea-ee8a-4ca4-894e-db77e160355e", 404), ("fine", "nope", 200)],
        "text string, client_id string, status int")
    rows = logs.clean_events(df, ["secret"], "key").collect()
    assert [(r.text, r.client_kind, r.severity) for r in rows] == [
        ("a [REDACTED]  b", "v4", "WARNING"), ("fine", "invalid", "INFO")]
    assert len(rows[0].client_key) == 64 and rows[1].client_key is None and "client_id" not in rows[0]
