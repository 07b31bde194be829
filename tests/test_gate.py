import pytest
from pyspark.sql import functions as F

from fieldquarry.operators import nlq, sqlgate
from fieldquarry.queries import STATEMENTS

GOOD = [
    "SELECT COUNT(*) as total FROM spk WHERE is_deleted = 0",
    "SELECT s.no_spk FROM spk s JOIN jaringan j ON s.no_jaringan = j.no_jaringan WHERE s.is_deleted = false AND j.is_deleted = false",
    "WITH x AS (SELECT id_spk FROM spk WHERE is_deleted = false) SELECT * FROM x",
    "SELECT id_spk AS created_at FROM spk WHERE is_deleted = false",
]
BAD = [
    "DROP TABLE spk", "UPDATE spk SET is_deleted = 1", "SELECT * FROM users", "SELECT 1 FROM users, spk WHERE is_deleted = 0", "SELECT * FROM spk",
    "SELECT id_spk FROM spk WHERE is_deleted = false UNION ALL SELECT id FROM users", "SELECT 1", "SELECT (SELECT max(id) FROM users) FROM spk WHERE is_deleted = false",
    "SELECT reflect('java.lang.System', 'exit', 1) FROM spk WHERE is_deleted = false", "SELECT * FROM spk WHERE", "INSERT INTO spk VALUES (1)", "CREATE TABLE x AS SELECT * FROM spk",
]


@pytest.mark.parametrize("sql", GOOD)
def test_plan_gate_passes(spark, sql):
    sqlgate.check_plan(spark, sql)


@pytest.mark.parametrize("sql", BAD)
def test_plan_gate_refuses(spark, sql):
    with pytest.raises(sqlgate.Refused):
        sqlgate.check_plan(spark, sql)


def test_templates_pass_the_gate(spark):
    for sql in nlq.TEMPLATES.values():
        sqlgate.check_plan(spark, sql)


def test_network_ids_are_checked(spark):
    with pytest.raises(ValueError):
        nlq.run_template(spark, "count_spk", "1' OR '1'='1")


LIVE = "(SELECT * FROM spk WHERE is_deleted = false)"
REWRITTEN = {
    "SELECT a FROM spk s WHERE s.is_deleted = 0 AND nama_pelanggan LIKE 'x';": "SELECT a FROM spk s WHERE s.is_deleted = false AND nama_pelanggan ILIKE 'x'",
    "SELECT no_spk, is_deleted FROM spk": f"SELECT no_spk, is_deleted FROM {LIVE} AS spk",
    "SELECT no_spk FROM spk s WHERE is_deleted = true OR is_deleted = false": f"SELECT no_spk FROM {LIVE} s WHERE is_deleted = true OR is_deleted = false",
    "SELECT 'is_deleted = 0' AS t FROM spk WHERE NOT is_deleted -- is_deleted = 0": "SELECT 'is_deleted = 0' AS t FROM spk WHERE NOT is_deleted -- is_deleted = 0",
    "WITH c AS (SELECT * FROM spk WHERE is_deleted = 0) SELECT * FROM c spk JOIN spk z ON c.id_spk = z.id_spk": f"WITH c AS (SELECT * FROM spk WHERE is_deleted = false) SELECT * FROM c spk JOIN {LIVE} z ON c.id_spk = z.id_spk",
    "SELECT (SELECT max(no_spk) FROM spk) FROM jaringan j WHERE j.is_deleted = false": f"SELECT (SELECT max(no_spk) FROM {LIVE} AS spk) FROM jaringan j WHERE j.is_deleted = false",
    "SELECT 1 FROM spk a JOIN spk b ON a.id_spk = b.id_spk AND b.is_deleted = 0 WHERE a.is_deleted = false": "SELECT 1 FROM spk a JOIN spk b ON a.id_spk = b.id_spk AND b.is_deleted = false WHERE a.is_deleted = false",
    "SELECT 1 FROM spk a LEFT JOIN spk b ON a.id_spk = b.id_spk AND a.is_deleted = false": f"SELECT 1 FROM {LIVE} a LEFT JOIN {LIVE} b ON a.id_spk = b.id_spk AND a.is_deleted = false",
    "SELECT * FROM (SELECT * FROM spk) t WHERE t.is_deleted IN (0)": f"SELECT * FROM (SELECT * FROM {LIVE} AS spk) t WHERE t.is_deleted IN (false)",
}


@pytest.mark.parametrize("sql", REWRITTEN)
def test_rewrite(spark, sql):
    assert sqlgate.rewrite(spark, sql) == REWRITTEN[sql]
    sqlgate.check_plan(spark, sql)


def test_a_comment_is_no_filter(spark):
    with pytest.raises(sqlgate.Refused):
        sqlgate.check_plan(spark, "SELECT no_spk FROM spk /* is_deleted */")


def test_deleted_rows_stay_hidden(spark):
    spark.createDataFrame([(1, "a", False), (2, "b", True)], "id_spk int, no_spk string, is_deleted boolean").createOrReplaceTempView("spk")
    for sql in ("SELECT id_spk, is_deleted FROM spk", "SELECT id_spk FROM spk WHERE is_deleted = true OR is_deleted = 0", "SELECT a.id_spk FROM spk a WHERE EXISTS (SELECT 1 FROM spk b WHERE b.is_deleted = 1 OR true)", "WITH x AS (SELECT * FROM spk) SELECT id_spk FROM x WHERE is_deleted IN (0, 1)"):
        assert [r.id_spk for r in sqlgate.run_checked(spark, sql).collect()] == [1]
    spark.catalog.dropTempView("spk")


def test_string_gates(spark):
    df = spark.createDataFrame([(i, s) for i, (s, *_) in enumerate(STATEMENTS)], "i int, sql string")
    for r in df.select("i", sqlgate.gate(F.col("sql")).alias("g"), F.size(sqlgate.strict_errors(F.col("sql"))).alias("e")).collect():
        assert (r.g, r.e) == STATEMENTS[r.i][1:3]


CASES = [
    ("sebutkan", True, "LIST_SPK", 0.98), ("berapa", True, "COUNT_SPK", 0.98), ("berapa spk?", True, "SPECIFIC_QUERY", 0.98), ("detail spk 000123/WO-LA/1997", False, "GET_SPK_DETAIL", 0.98),
    ("ada berapa spk untuk 2000000002", True, "COUNT_SPK", 0.95), ("pop nya apa?", True, "SPECIFIC_QUERY", 0.90), ("jelaskan prosedur pemasangan", False, "GENERAL_INFO", 0.90), ("halo", False, "GENERAL_INFO", 0.70),
]


def test_intents(spark):
    df = spark.createDataFrame([(q, "2000000001" if c else None) for q, c, *_ in CASES], "q string, n string")
    got = df.select("q", nlq.intent(F.col("q"), F.col("n"), F.lit(None).cast("string"), F.lit(False)).alias("i")).collect()
    assert [(r.q, r.i.type, r.i.confidence) for r in got] == [(q, t, c) for q, _, t, c in CASES]
