import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallycast.functions import roles, text
from tallycast.operators import clean


def test_amount_parsing(spark):
    cells = ["1 000,50", "1 000,5", "1.234,5", "abc", "inf", "nan", None, "-12", "7.25"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(text.parse_amount(F.col("c")).cast("double")).collect()]
    assert got == [1000.5, 1000.5, None, None, None, None, None, -12.0, 7.25]


@pytest.mark.parametrize(
    "cell, day_first, month_first",
    [
        ("2024-02-01", "2024-02-01", "2024-02-01"),
        ("2024/02/01", "2024-02-01", "2024-02-01"),
        ("2024-02-01 10:30:00", "2024-02-01", "2024-02-01"),
        ("2024-02-01T10:30:00", "2024-02-01", "2024-02-01"),
        ("20240201", "2024-02-01", "2024-02-01"),
        ("2024-02", "2024-02-01", "2024-02-01"),
        ("03/04/2024", "2024-04-03", "2024-03-04"),
        ("31/01/2024", "2024-01-31", "2024-01-31"),
        ("01/31/2024", "2024-01-31", "2024-01-31"),
        ("3.4.2024", "2024-04-03", "2024-03-04"),
        ("2024-XX-01", None, None),
        ("31/02/2024", None, None),
        ("150000", None, None),
        ("", None, None),
    ],
)
def test_date_parsing(spark, cell, day_first, month_first):
    row = spark.createDataFrame([(cell,)], "c string").select(
        text.parse_date(F.col("c"), True), text.parse_date(F.col("c"), False)
    ).first()
    assert [None if d is None else d.isoformat() for d in row] == [day_first, month_first]


def test_one_bad_cell_does_not_move_the_others(spark):
    cells = ["2020-01-02", "2020-01-13", "oops"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(text.parse_date(F.col("c"))).collect()] == [
        dt.date(2020, 1, 2),
        dt.date(2020, 1, 13),
        None,
    ]


def test_order_is_decided_per_source(spark):
    rows = [("a", "03/04/2024", "1"), ("a", "25/04/2024", "1"), ("b", "03/04/2024", "1")]
    raw = spark.createDataFrame(rows, "file string, date string, montant string")
    role = roles.Roles("date", "montant")
    tagged = clean.tag_rows(raw, role, "auto_month_first", F.col("file"), source="file")
    got = {(r.entity, r.raw_date): r.date.isoformat() for r in tagged.collect()}
    assert got[("a", "03/04/2024")] == "2024-04-03"
    assert got[("b", "03/04/2024")] == "2024-03-04"


def test_rejects_keep_their_reason(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-01", "5"), ("1", "x", "5"), ("1", "2024-01-01", "y"), (None, "2024-01-01", "5")],
        "code string, date string, montant string",
    )
    tagged = clean.tag_rows(raw, roles.detect_roles(raw.columns, "split"))
    assert clean.good_rows(tagged).count() == 1
    assert sorted(r.reason for r in clean.rejected_rows(tagged).collect()) == ["bad amount", "bad date", "no entity"]


def test_roles():
    assert roles.detect_roles(["mois", "montant"], "service") == roles.Roles("mois", "montant")
    with pytest.raises(roles.MissingColumn):
        roles.detect_roles(["mois", "montant"], "classic")
    with pytest.raises(roles.MissingColumn):
        roles.detect_roles(["amount"], "service")
    with pytest.raises(roles.MissingColumn):
        roles.detect_roles(["mois", "montant"], "by_code")
    assert roles.detect_roles(["code", "code_etabl", "jour", "value"], "by_code").entity == "code_etabl"
    assert roles.detect_roles(["ordonateur", "date", "value"], "by_code").entity == "ordonateur"
    assert roles.detect_roles(["when", "code", "x"], "by_code", "ends") == roles.Roles("when", "x", "code")
    assert roles.detect_roles(["date_reglement", "b", "c"], "classic", "third").amount == "c"


def test_code_list(spark):
    codes = clean.code_list(spark, " 5, 17,,5 ").collect()
    assert sorted((c.entity, c.place) for c in codes) == [("17", 1), ("5", 0)]
