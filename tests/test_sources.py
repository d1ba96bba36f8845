import pytest
from pyspark.sql import functions as F

from mnemora import sources
from mnemora.operators import views


def test_versions_replace_each_other_whole(spark, tmp_path):
    table = str(tmp_path / "t")
    first = sources.write_version(spark.range(5), table)
    second = sources.write_version(spark.range(7), table)
    assert first != second and sources.read_version(spark, table).count() == 7

    def fail(_):
        raise ValueError

    broken = spark.range(9).select(F.udf(fail, "long")("id").alias("id"))
    with pytest.raises(Exception):  # noqa: B017, PT011
        sources.write_version(broken, table)
    assert sources.read_version(spark, table).count() == 7
    sources.write_version(sources.read_version(spark, table).limit(0), table)
    assert sources.read_version(spark, table).count() == 0


def test_log_is_appended_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 10:00:00", "store"), ("2026-01-02 10:00:00", "recall")], "ts string, op string").withColumn("ts", F.to_timestamp_ntz("ts"))
    for _ in range(2):
        sources.append_log(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("day").count().orderBy("day").collect()[0]["count"] == 2


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Conf:
        @staticmethod
        def get(_name, default):
            return default

    class Session:
        sparkContext, conf = Context, Conf

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        sources.shared_folder(Session)


def test_as_of_join_equals_brute_force(spark):
    import datetime as dt
    import random

    r = random.Random(4)
    at = lambda d: dt.datetime(2020, 1, 1) + dt.timedelta(hours=d)
    facts = []
    for i in range(150):
        a = r.choice([-500_000, *(r.randrange(0, 20_000) for _ in range(9))])
        facts.append((i, r.randrange(2), "active", at(a), r.choice([None, at(a), at(a + r.randrange(1, 9000)), at(a + 1), at(1_500_000)])))
    facts += [(900, 1, "deleted", at(0), None), (901, None, "active", at(0), None), (902, 1, "active", None, None)]
    probes = [(i, r.randrange(2), at(r.choice([-600_000, 1_400_000, *(r.randrange(-100, 25_000) for _ in range(9))]))) for i in range(120)]
    f = spark.createDataFrame(facts, "fact long, k long, status string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    p = spark.createDataFrame(probes, "probe long, k long, moment timestamp_ntz")
    for many in (64, 0, 10_000):
        got = sorted((x.probe, x.fact) for x in views.as_of_join(p, f, ["k"], many=many).collect())
        assert got == sorted((i, j) for i, k, m in probes for j, kk, s, a, b in facts if k == kk and s == "active" and a is not None and a <= m and (b is None or b > m))


def test_calls_are_logged_with_their_errors(spark, tmp_path):
    folder = str(tmp_path / "log")
    with sources.logged(spark, folder, "search_memory", "a") as detail:
        detail["n_results"] = 3
    with pytest.raises(KeyError), sources.logged(spark, folder, "search_memory"):
        raise KeyError("x")
    rows = spark.read.parquet(folder).orderBy("ts").collect()
    assert [(r.op, r.tool, r.agent) for r in rows] == [("tool_call", "search_memory", "a"), ("tool_call", "search_memory", None)]
    assert rows[0].detail == '{"n_results": 3}' and "KeyError" in rows[1].detail and all(r.latency_ms >= 0 for r in rows)


def test_a_profile_is_made_once_for_a_version(spark):
    from mnemora.operators.profile import Profiles
    from tests.conftest import SF

    memories, entities = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("memories", "entities"))
    p = Profiles()
    first = p.text(7, memories, entities, "2025-05-02")
    assert first.startswith("# Core memory (as of 2025-05-02)") and len(first) < 3400
    assert p.text(7, memories, entities, "2025-06-01") == first and p.made == 1
    assert p.text(8, memories, entities, "2025-06-01") != first and p.made == 2
