"""Appends that happen once, lookups that read one bucket, and files told apart by their whole path."""

import re

import pytest
from pyspark.sql import functions as F

from tallycast.history import journal, tables
from tallycast.sources import files, sinks

SCHEMA = "id long, owner string, n int"


def rows_of(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def read(spark, folder):
    return sorted(map(str, journal.committed(spark, folder, SCHEMA).select("id", "owner", "n").collect()))


def test_an_append_happens_once(spark, tmp_path):
    folder = str(tmp_path / "table")
    assert read(spark, folder) == []
    first = rows_of(spark, (1, "a", 1), (2, "b", 2), (None, "c", 3), (2, "b", 2))
    for _ in range(3):
        journal.append(first, folder, "one", ["id"], "owner")
    assert len(read(spark, folder)) == 3
    # Keys that are there stay as they are; a batch that adds nothing is committed too.
    journal.append(rows_of(spark, (1, "z", 9), (3, "d", 4), (None, "z", 9)), folder, "two", ["id"], "owner")
    journal.append(rows_of(spark, (1, "z", 9)), folder, "three", ["id"], "owner")
    got = journal.committed(spark, folder, SCHEMA)
    assert sorted((str(r["id"]), r["owner"]) for r in got.collect()) == [("1", "a"), ("2", "b"), ("3", "d"), ("None", "c")]
    assert {r["batch"] for r in journal.commits(spark, folder).collect()} == {"one", "two", "three"}


def test_rows_without_a_commit_are_not_seen(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "table")
    journal.append(rows_of(spark, (1, "a", 1)), folder, "one", ["id"], "owner")
    # A run that dies between its rows and its commit.
    stop = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with monkeypatch.context() as m:
        m.setattr(journal.F, "current_timestamp", stop)
        with pytest.raises(RuntimeError):
            journal.append(rows_of(spark, (2, "b", 2)), folder, "two", ["id"], "owner")
    assert len(read(spark, folder)) == 1
    journal.append(rows_of(spark, (2, "b", 2)), folder, "two", ["id"], "owner")
    assert len(read(spark, folder)) == 2


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_lookup_reads_one_bucket(spark, tmp_path):
    users = spark.createDataFrame([(i, f"key{i}", "org", None, None, None, True) for i in range(200)], tables.SCHEMAS["users"])
    tables.append_users(users, str(tmp_path), "all")
    made = spark.range(2000).select(*[
        (F.col("id") if f.name == "pred_id" else F.col("id") % 200 if f.name == "user_id" else F.lit("run") if f.name == "run_id" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in spark.createDataFrame([], tables.SCHEMAS["predictions"]).schema
    ])
    journal.append(made, f"{tmp_path}/predictions", "run", *tables.KEYS["predictions"])
    found = tables.committed_tables(spark, str(tmp_path))
    account = journal.looked_up(found["users"], "api_key", "key7")
    assert [r["user_id"] for r in account.collect()] == [7]
    # The hash of the key is worked out while planning, so the scan lists one bucket's folder.
    assert re.search(r"PartitionFilters: \[.*\(bucket#\d+ = \d+\)", plan_of(account))
    own = tables.prediction_by_key(found, "key7")
    assert own.count() == 10 and {r["user_id"] for r in own.collect()} == {7}
    assert "dynamicpruning" in plan_of(own).lower()
    assert [r["pred_id"] for r in tables.prediction_by_key(found, "key7", 207).collect()] == [207]
    assert tables.prediction_by_key(found, "no such key").count() == 0


def test_an_empty_file_beside_a_namesake(spark, tmp_path):
    for year, text in (("2023", "date;montant\n2023-01-05;10\n2023-02-05;11\n"), ("2024", ""), ("2025", "\n")):
        (tmp_path / year).mkdir()
        (tmp_path / year / "a b.csv").write_text(text)
    facts = {r["file_path"].split("/")[-2]: r for r in files.inspect_files(spark, f"{tmp_path}/*/*.csv").collect()}
    assert {k: r["reason"] for k, r in facts.items()} == {"2023": None, "2024": "empty file", "2025": "empty header"}
    assert facts["2023"]["stem"] == "a b" and facts["2024"]["file_size"] == 0 and facts["2023"]["delimiter"] == ";"
    tagged, refused = files.read_ledger(spark, f"{tmp_path}/*/*.csv")
    assert tagged.count() == 2 and sorted(r["reason"] for r in refused.collect()) == ["empty file", "empty header"]


def test_one_entity_by_the_index_alone(spark, tmp_path):
    """One entity has a third of all rows and lies in several files; names hold signs that folders escape."""
    names = [f"e/{i} %" for i in range(300)] + ["hot"]
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e/"), (F.col("id") % 300).cast("string"), F.lit(" %"))).alias("entity"), F.col("id").alias("h"))
    folder = str(tmp_path / "indexed")
    sinks.write_indexed(rows, folder, buckets=4)
    for name in ("hot", names[7], names[299]):
        want = sorted(r["h"] for r in rows.where(F.col("entity") == name).collect())
        assert sorted(r["h"] for r in sinks.read_indexed(spark, folder, name, 4).collect()) == want
    assert sinks.read_indexed(spark, folder, "nobody", 4).columns == ["entity", "h"]
    assert sinks.read_indexed(spark, folder, "nobody", 4).count() == 0
    whole = spark.read.parquet(f"{folder}/index")
    assert whole.agg(F.sum("n_rows")).first()[0] == 3000 and whole.select("file").distinct().count() <= 8
