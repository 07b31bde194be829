"""Keyed state of conversations and the line sink: order, waits, late turns, replays; endpoints that fail."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldquarry.sources import endpoints
from fieldquarry.streaming import lines, turns

SCHEMA = "conv_id long, turn long, role string, text string"


def fed(spark, tmp_path, batches, **how):
    """Output rows of a stream that gets one batch after another."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
        for f in glob.glob(f"{tmp_path}/in/b={i}/*"):
            os.utime(f, (i + 1, i + 1))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    turns.write_available(turns.conversation_context(stream, k=2, **how), f"{tmp_path}/out", f"{tmp_path}/cp", partitions=2)
    return {(r.conv_id, r.turn): (r.history, r.ctx_network, r.ctx_order) for r in spark.read.schema(turns.ROWS).parquet(f"{tmp_path}/out").collect()}


def test_turns_are_put_in_order(spark, tmp_path):
    got = fed(spark, tmp_path, [
        [(1, 2, "user", "c 000123/WO-LA/1999"), (2, 0, "user", None), (None, 0, "user", "no id"), (1, None, "user", "no turn")],
        [(1, 1, "assistant", "b 0000000002"), (2, 1, None, "0000000009 000777/WO-LA/2001")],
        [(1, 0, "user", "a 0000000001"), (1, 3, "user", "d 0000000001"), (1, 0, "user", "a again, same turn")],
    ], patience_ms=3_600_000)
    first = got.pop((1, 0))
    assert first[0].startswith("user: a") and got.pop((1, 1))[1:] == ("0000000002", None)
    assert got == {
        (1, 2): ("assistant: b 0000000002\nuser: c 000123/WO-LA/1999", "0000000002", "000123/WO-LA/1999"), (1, 3): ("user: c 000123/WO-LA/1999\nuser: d 0000000001", "0000000001", None),
        (2, 0): ("user: ", None, None), (2, 1): ("user: ", "0000000009", "000777/WO-LA/2001"), (None, 0): ("user: no id", None, None),
    }


def test_missing_turns_are_given_up_and_late_ones_dropped(spark, tmp_path):
    got = fed(spark, tmp_path, [[(1, 0, "user", "a"), (1, 2, "user", "c")], [(2, 0, "user", "x")], [(1, 1, "user", "late")], [(1, 3, "user", "d")]], patience_ms=1)
    assert {k: v[0] for k, v in got.items() if k[0] == 1} == {(1, 0): "user: a", (1, 2): "user: a\nuser: c", (1, 3): "user: c\nuser: d"}


def test_idle_conversations_are_forgotten(spark, tmp_path):
    got = fed(spark, tmp_path, [[(1, 0, "user", "a 0000000001")], [(2, 0, "user", "x")], [(3, 0, "user", "y")], [(1, 0, "user", "anew")]], patience_ms=1, idle_ms=1)
    assert got[1, 0][0] in ("user: a 0000000001", "user: anew") and len(got) == 3


def test_replayed_epochs_write_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"data: {i}-{j}\n\n",) for j in range(5)], "line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = lines.write_lines(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert q.exception() is None
        return sorted(r.value for r in lines.read_lines(spark, str(tmp_path / "out")).collect())

    want = sorted(f"data: {i}-{j}" for i in range(3) for j in range(5))
    assert run() == want
    last = max(int(f) for f in os.listdir(tmp_path / "cp/commits") if f.isdigit())
    for f in glob.glob(f"{tmp_path}/cp/commits/*{last}*") + glob.glob(f"{tmp_path}/cp/commits/.{last}.crc"):
        os.remove(f)  # the sink has the epoch, the query does not know: it runs again
    assert run() == want
    parts = glob.glob(f"{tmp_path}/out/parts/*")
    assert len(parts) > len(lines.committed_files(str(tmp_path / "out")))
    assert lines.read_lines(spark, str(tmp_path / "none")).count() == 0


# ---- endpoints ---------------------------------------------------------------------------------
def test_only_rows_that_fail_have_errors(spark):
    def call(values):
        if "bad" in values:
            raise OSError("no")
        return [v.upper() for v in values]

    df = spark.createDataFrame([(v,) for v in ["a", "bad", "b", "c"]], "t string").coalesce(1)
    got = {r.t: (r.answer, r.error) for r in endpoints.answer(df, "t", call, wait=0.0).collect()}
    assert got == {"a": ("A", None), "b": ("B", None), "c": ("C", None), "bad": (None, "OSError: no")}


def test_an_endpoint_that_is_down_ends_the_job(spark):
    def down(values):
        raise OSError("down")

    df = spark.range(300).select(F.col("id").cast("string").alias("t")).coalesce(1)
    with pytest.raises(Exception, match="300 of 300 rows failed"):
        endpoints.answer(df, "t", down, wait=0.0, retries=0).collect()


def test_answers_of_another_length_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    got = endpoints.embed(df, "t", lambda v: [[1.0]] if len(v) == 1 else [], wait=0.0).collect()
    assert [r.embedding for r in got] == [[1.0], [1.0]]


def test_gaussian_threshold_against_a_plain_loop():
    rng = np.random.default_rng(1)
    gray = rng.integers(0, 256, (17, 23)).astype(np.uint8)
    w = endpoints._weights(5)
    padded = np.pad(gray.astype(float), 2, mode="edge")
    for i in range(17):
        for j in range(23):
            mean = float(w @ padded[i : i + 5, j : j + 5] @ w)
            if abs(gray[i, j] - (mean - 2)) > 1e-6:
                assert (endpoints.enhance(gray, window=5)[i, j] == 255) == (gray[i, j] > mean - 2)
        break
    noisy = np.full((9, 9), 90, np.uint8)
    noisy[4, 4] = 255
    assert (endpoints.denoise(noisy) == 90).all()
