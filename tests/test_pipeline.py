import os
import json

import numpy as np
from conftest import ledger_of, month_rows
from pyspark.sql import functions as F

from tallycast.history import queries as history
from tallycast.history import tables
from tallycast.operators import clean
from tallycast.plans import pipeline
from tallycast.session import cut_lineage
from tallycast.sources import files, sinks


def mixed_ledger(spark):
    rng = np.random.default_rng(0)
    season = 50 * np.sin(np.arange(60) * 2 * np.pi / 12)
    rows = month_rows("seasonal", 500 + season + rng.normal(size=60), day=28)
    rows += month_rows("zigzag", [1000 + 50 * i + (100 if i % 2 == 0 else -50) for i in range(24)], day=28)
    rows += month_rows("linear", range(100, 136), day=28)
    rows += month_rows("noise", 100 + rng.normal(size=50), day=28)
    rows += month_rows("flat", [7] * 30, day=28)
    rows += month_rows("tiny", [3, 4], day=28)
    return ledger_of(spark, rows)


def test_every_entity_gets_a_forecast(spark):
    got = {r.entity: r for r in pipeline.forecast_ledger(mixed_ledger(spark)).collect()}
    assert len(got) == 6 and all(r.status == "ok" for r in got.values())
    for name in ("flat", "tiny"):
        assert got[name].method == "naive" and got[name].model == "NAIVE_CONSTANT" and got[name].anomalies == []
        assert got[name].months == 6 and len(got[name].path) == 6
        assert {(p.value, p.lower, p.upper) for p in got[name].path} == {(got[name].last_y,) * 3}
    assert got["linear"].model != "SARIMA"
    assert np.allclose([p.value for p in got["linear"].path][:3], [135, 136, 137], atol=0.5)
    assert got["seasonal"].seasonal
    for name in ("seasonal", "zigzag", "linear", "noise"):
        r = got[name]
        assert r.model in ("AR", "MA", "ARMA", "ARIMA", "SARIMA") and len(r.path) == r.months
        assert all(p.lower <= p.value <= p.upper for p in r.path)
        assert any("Chosen model" in line for line in r.explanations)
        assert any(line.startswith("Horizon") for line in r.explanations)


def test_other_entities_do_not_change_a_result(spark):
    ledger = mixed_ledger(spark)
    both = {r.entity: [p.value for p in r.path] for r in pipeline.forecast_ledger(ledger).collect()}
    alone = pipeline.forecast_ledger(clean.one_code(ledger, "noise").repartition(5)).first()
    assert np.allclose(both["noise"], [p.value for p in alone.path])


def test_classic_rule(spark):
    got = {r.entity: r for r in pipeline.forecast_ledger(mixed_ledger(spark), months=12, rule="classic").collect()}
    assert got["seasonal"].model == "SARIMA" and got["seasonal"].seasonal_order == "(1, 1, 1, 12)"
    assert len(got["seasonal"].path) == 12


def test_requests_skip_and_set(spark):
    wishes = spark.createDataFrame([("noise", "2"), ("linear", "s")], "entity string, months string")
    got = {r.entity: r for r in pipeline.forecast_ledger(mixed_ledger(spark), requests=wishes).collect()}
    assert len(got["noise"].path) == 2
    assert got["linear"].status == "skipped" and got["linear"].path is None


def test_by_code_reports_missing(spark):
    rows = pipeline.by_code(mixed_ledger(spark), clean.code_list(spark, "noise, nobody, tiny"), months=3).collect()
    got = {r.entity: r for r in rows}
    assert got["nobody"].status == "missing" and got["noise"].status == "ok" and len(got["tiny"].path) == 3


def test_document_shape(spark):
    rows = pipeline.result_json(pipeline.forecast_ledger(mixed_ledger(spark)))
    docs = {r.entity: json.loads(r.document) for r in rows.collect()}
    for doc in docs.values():
        assert doc["status"] == "success"
        n = doc["duration_info"]["validated_months"]
        assert all(len(doc["forecast"][k]) == n for k in ("dates", "values", "confidence_upper", "confidence_lower"))
        assert len(doc["history"]["dates"]) == len(doc["history"]["values"])
        assert isinstance(doc["anomalies"], list)


def test_whole_ledger_is_one_series(spark):
    rows = pipeline.whole_ledger(mixed_ledger(spark)).collect()
    assert [r.entity for r in rows] == ["ALL"]


def test_files_round_trip(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "A1.csv").write_text("Date;Montant\n2024-01-05;1 000,50\n2024-02-29;2\n", encoding="utf-8")
    (folder / "B2.csv").write_text("date,montant\n25/01/2024,7.5\n03/02/2024,1\nbad,2\n", encoding="utf-8")
    (folder / "C3.csv").write_text("date?valeur\n2024-XX-01?1000\n", encoding="utf-8")
    (folder / "F6.csv").write_text("amount\n5\n6\n", encoding="utf-8")
    (folder / "D4.csv").write_text("", encoding="utf-8")
    (folder / "E5.csv").write_text("date;montant\n" + "2024-01-01;1\n" * 50, encoding="utf-8")
    tagged, refused = files.read_ledger(spark, str(folder), max_bytes=500)
    good = sorted((r.entity, r.date.isoformat(), float(r.amount)) for r in clean.good_rows(tagged).collect())
    assert good == [
        ("A1", "2024-01-05", 1000.5),
        ("A1", "2024-02-29", 2.0),
        ("B2", "2024-01-25", 7.5),
        ("B2", "2024-02-03", 1.0),
    ]
    rejected = sorted((r.entity, r.reason) for r in clean.rejected_rows(tagged).collect())
    assert rejected == [("B2", "bad date"), ("C3", "bad date")]
    reasons = {r.stem: r.reason for r in refused.collect()}
    assert reasons["E5"] == "file too large" and "no column" in reasons["F6"]
    assert reasons["D4"] == "empty file" and set(reasons) == {"D4", "E5", "F6"}
    assert {r.entity for r in clean.good_rows(files.read_ledger(spark, str(folder))[0]).collect()} == {"A1", "B2", "E5"}
    hashes = files.file_hashes(spark, str(folder)).collect()
    assert len(hashes) == 5 and all(len(r.file_hash) == 64 for r in hashes)
    limited, _ = files.read_ledger(spark, str(folder), max_bytes=500, limit=1)
    assert {r.entity for r in limited.collect()} == {"A1"}


def test_surplus_cells_are_rejected(spark, tmp_path):
    (tmp_path / "a b[1].csv").write_text("date,montant\n2024-01-01,1000,50\n2024-01-02,7,\n2024-01-03\n2024-01-04,1.00005\n", encoding="utf-8")
    tagged, refused = files.read_ledger(spark, str(tmp_path))
    assert [(r.entity, r.amount) for r in clean.good_rows(tagged).collect()] == [("a b[1]", 7)]
    rejected = {(r.raw_date, r.raw_amount, r.reason) for r in clean.rejected_rows(tagged).collect()}
    assert rejected == {("2024-01-01", "2024-01-01,1000,50", "surplus cells"), ("2024-01-03", None, "bad amount"), ("2024-01-04", "1.00005", "bad amount")}
    assert refused.count() == 0


def test_no_exchange_before_the_sum(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,montant\n2024-01-01,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("jour;valeur\n25/01/2024;1\n", encoding="utf-8")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tagged, _ = files.read_ledger(spark, str(tmp_path))
        plan = clean.good_rows(tagged)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plan and "Exchange" not in plan


def test_typed_rows_keep_their_reason(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 2e15), ("a", "2024-01-01", float("nan")), (None, "2024-01-01", 1.0), ("a", None, 1.0), ("a", "2024-01-01", 1e18)], "e string, d string, x double")
    tagged = clean.tag_typed(rows, F.col("e"), F.col("d").try_cast("date"), F.col("x"))
    assert [float(r.amount) for r in clean.good_rows(tagged).collect()] == [2e15]
    assert sorted(r.reason for r in clean.rejected_rows(tagged).collect()) == ["bad amount", "bad amount", "bad date", "no entity"]


def test_split_and_batch_sinks(spark, tmp_path):
    ledger = mixed_ledger(spark).unionByName(ledger_of(spark, [("a/b", "2024-01-01", 1), ("a/b", "2024-01-01", 2), ("a_b", "2024-01-01", 5)]))
    sinks.split_by_entity(ledger, str(tmp_path / "split"))
    back = spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "split"))
    row = back.filter("entity = 'a/b'").collect()
    assert len(row) == 1 and row[0].date == "2024-01-01" and float(row[0].montant) == 3.0
    sinks.run_batch(ledger, str(tmp_path / "run"), months=3)
    out = spark.read.option("header", True).csv(str(tmp_path / "run" / "forecasts"))
    assert set(out.columns) == {"date", "prévision", "min_confiance", "max_confiance", "entity_key", "entity"}
    assert {r.entity for r in out.filter("entity_key = 'a_b'").select("entity").distinct().collect()} == {"a/b", "a_b"}
    assert out.filter("entity_key = 'noise'").count() == 3
    summary = spark.read.option("header", True).csv(str(tmp_path / "run" / "summary"))
    assert summary.count() == 8 and set(summary.columns) == {"ordonateur", "status", "out_path"}
    places = {r.ordonateur: r.out_path for r in summary.filter("ordonateur in ('a/b', 'a_b')").collect()}
    assert places["a/b"].endswith("entity_key=a_b/entity=a%2Fb") and all(os.path.isdir(p) for p in places.values())


def test_history_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "history")
    results = cut_lineage(pipeline.forecast_ledger(mixed_ledger(spark)))
    for _ in range(2):  # a repeated run changes nothing
        tables.save_run(results, folder, "run-1", 7)
    tables.save_run(results, folder, "run-2", 7)
    opened = tables.open_tables(spark, folder)
    assert opened["users"].count() == 0
    assert opened["predictions"].count() == 12 and opened["uploaded_files"].count() == 12
    users = spark.createDataFrame(
        [(7, "key", "org", None, None, None, True), (8, "other", "none", None, None, None, True)],
        tables.SCHEMAS["users"],
    )
    tables.register_users(users, folder)
    opened = tables.open_tables(spark, folder)
    facts = [opened[n] for n in ("uploaded_files", "predictions", "anomalies")]
    info = {r.user_id: r for r in history.account_info(opened["users"], *facts).collect()}
    assert (info[7].files_uploaded, info[7].predictions_made) == (12, 12)
    assert info[7].anomalies_detected == opened["anomalies"].count()
    assert (info[8].files_uploaded, info[8].anomalies_detected) == (0, 0)
    assert history.account(opened["users"], "key").first().user_id == 7
    detail = history.prediction_detail(opened["predictions"], opened["anomalies"], F.col("model_name") == "NAIVE_CONSTANT")
    row = detail.first()
    assert row.anomalies_count == 0 and len(row.forecast.values) == row.forecast_months
    assert history.duplicate_files(opened["uploaded_files"]).count() == 6
    overview = {r.user_id: r for r in history.usage_overview(opened["users"], *facts).collect()}
    assert sum(m.uses for m in overview[7].models_used) <= 12 and overview[8].models_used is None


def test_create_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS ledger_test LOCATION '{tmp_path}'")
    tables.create_tables(spark, "ledger_test")
    tables.create_tables(spark, "ledger_test")
    names = {r.tableName for r in spark.sql("SHOW TABLES IN ledger_test").collect()}
    assert names == set(tables.SCHEMAS)
    spark.sql("DROP DATABASE ledger_test CASCADE")
