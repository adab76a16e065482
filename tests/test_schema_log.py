"""The schema log: versions, concurrent widening, reads without footers."""

import glob
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from featurestats.operators import schema_log
from featurestats.operators.layout import read_events, write_events
from featurestats.operators.schema_log import current_schema, fit, publish, schema_history
from featurestats.operators.store import read_table
from featurestats.session import work_path
from featurestats.sources.fixtures import event_table
from paths import SF_SMALL


def test_two_writers_that_widen_at_once_both_keep_their_columns(spark):
    fact, path = event_table(spark, SF_SMALL).drop("score"), work_path(spark, "t_widen")
    write_events(fact, path)
    columns = [f"new_{k}" for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda c: write_events(fact.withColumn(c, F.lit(1.5)), path, mode="append"), columns))
    t = read_events(spark, path)
    counts = t.agg(*[F.count(c).alias(c) for c in columns]).first()
    assert [counts[c] for c in columns] == [fact.count()] * 4
    assert current_schema(spark, path)[0] == 5 and t.count() == 5 * fact.count()
    assert [r.version for r in schema_history(spark, path).where(F.col("column").startswith("new_")).orderBy("version").collect()] == [2, 3, 4, 5]


def test_the_second_of_two_types_goes_to_a_side_column(spark, monkeypatch):
    """Both writers read version 1; the one that publishes first decides the type."""
    fact, path = event_table(spark, SF_SMALL).drop("score").limit(10), work_path(spark, "t_race")
    write_events(fact, path)
    plain, raced = schema_log.publish, []

    def overtaken(spark_, table, version, schema):
        if not raced:
            raced.append(version)
            write_events(fact.withColumn("risk", F.lit(0.5)), path, mode="append")
        return plain(spark_, table, version, schema)

    monkeypatch.setattr(schema_log, "publish", overtaken)
    write_events(fact.withColumn("risk", F.lit("high")), path, mode="append")
    assert {"risk", "risk__string"} <= set(read_events(spark, path).columns)
    held = read_table(spark, path).groupBy("risk").count().collect()
    assert {r["risk"]: r["count"] for r in held} == {None: 10, "0.5": 10, "high": 10}


def test_a_version_is_published_once(spark):
    path, one = work_path(spark, "t_once"), T.StructType([T.StructField("a", T.LongType())])
    assert current_schema(spark, path) == (0, None)
    assert publish(spark, path, 1, one) and not publish(spark, path, 1, T.StructType([T.StructField("b", T.LongType())]))
    assert current_schema(spark, path) == (1, one)
    assert not [f for f in glob.glob(schema_log.log_path(path).removeprefix("file:") + "/*") if "draft" in f]


def test_reads_open_no_footers_for_the_schema(spark):
    """A file that is no Parquet stands in the table: planning a read does not notice it, merging schemas would."""
    fact, path = event_table(spark, SF_SMALL), work_path(spark, "t_footers")
    write_events(fact, path)
    day = next(iter(glob.glob(path.removeprefix("file:") + "/processing_day=2024-01-09/*/")))
    with open(day + "part-broken.parquet", "w") as f:
        f.write("no parquet")
    t = read_events(spark, path)
    assert t.columns and t.where("processing_day = DATE '2024-01-10'").count() > 0


def test_fit_casts_and_parts(spark):
    have = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])
    out = fit(spark.createDataFrame([(1, "a", "5")], "x int, y string, originId string"), have)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [
        ("x", "bigint"), ("y", "bigint"), ("y__string", "string"), ("originId", "int")]
