"""Reading and cleaning of a table with every oddity of the source."""

import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import presets as P
from tallyframe.operators import clean, derive
from tallyframe.operators.box import box_stats
from tallyframe.operators.explore import corr_matrix
from tallyframe.operators.profile import null_report
from tallyframe.plans.explore import correlation
from tallyframe.plans.prepare import prepare_exploration, prepare_model, read_table
from tallyframe.sources.csv import drop_unnamed, scan_csv
from tallyframe.sources.tables import cached, ingest

HEADER = (
    ",Accident_Severity,Date,Time,Day_of_Week,Urban_or_Rural_Area,Longitude,Latitude,Speed_limit,Road_Type,"
    "Junction_Control,Same"
)
ROWS = [
    '0,1,04/01/2005,17:42,1,1,-0.5,51.5,30,"Give ""way""",2,5',
    '1,2, 05/01/2005 ,09:05,2,2,-1.0,51.6,60,"Auto, signal",-1,5',
    "2,3,2005-01-04,,3,3,0.25,51.7,0,None,None,5",
    "3,9,31/02/2005,7:30,7,-1,0.5,52.0,-1,Single,4,5",
    "4,,4/1/2005,25:00,,,,,,,,5",
]
TYPES = T.StructType([*P.SOURCE_TYPES.fields, T.StructField("Same", T.IntegerType())])


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    file = tmp_path_factory.mktemp("golden") / "table.csv"
    file.write_text("\n".join([HEADER, *ROWS]) + "\n")
    return str(file)


@pytest.fixture(scope="module")
def raw(spark, path):
    return scan_csv(spark, path, TYPES)


def column(df, name):
    return [r[0] for r in df.orderBy("_c0").select(F.col(f"`{name}`")).collect()]


def test_types_go_by_name(raw):
    types = dict(raw.dtypes)
    assert (types["_c0"], types["Accident_Severity"], types["Longitude"], types["Time"], types["Same"]) == (
        "int", "int", "double", "string", "int",
    )


def test_quotes_and_commas(raw):
    assert column(raw, "Road_Type")[:2] == ['Give "way"', "Auto, signal"]


def test_unnamed_column_is_dropped(raw):
    assert "_c0" not in drop_unnamed(raw).columns
    assert drop_unnamed(drop_unnamed(raw)).columns == raw.columns[1:]


def test_column_order_does_not_matter(spark, tmp_path):
    file = tmp_path / "turned.csv"
    file.write_text("Latitude,Extra,Accident_Severity\n51.5,x,2\n")
    assert scan_csv(spark, str(file), TYPES).first().asDict() == {"Latitude": 51.5, "Extra": "x", "Accident_Severity": 2}


def test_other_header_in_a_folder_raises(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Latitude,Accident_Severity\n51.5,2\n")
    (tmp_path / "b.csv").write_text("Accident_Severity,Latitude\n1,52.5\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        scan_csv(spark, str(tmp_path), TYPES, same_header=True).collect()


def test_bad_fields_are_null_and_kept(spark, tmp_path):
    file = tmp_path / "bad.csv"
    file.write_text("Accident_Severity,Latitude\n1,51.5\nmany,52.0\n")
    rows = scan_csv(spark, str(file), TYPES, corrupt="bad").collect()
    assert [r["Accident_Severity"] for r in rows] == [1, None]
    assert [r["bad"] for r in rows] == [None, "many,52.0"]


def test_inferred_types(spark, path):
    types = dict(scan_csv(spark, path, infer=True).dtypes)
    assert (types["Accident_Severity"], types["Longitude"], types["Road_Type"]) == ("int", "double", "string")


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        scan_csv(spark, str(tmp_path / "none.csv"), TYPES)


def test_dates(raw):
    parsed = derive.parse_date(raw, "Date", out="day")
    assert column(parsed, "day") == [datetime.date(2005, 1, 4), datetime.date(2005, 1, 5), None, None, None]


def test_times(raw):
    assert column(derive.hour_of(raw, "Time", "h"), "h") == [17, 9, None, 7, None]
    assert column(derive.hour_from_text(raw, "Time", "h"), "h") == [17.0, 9.0, None, 7.0, 25.0]
    assert column(derive.hour_from_text(raw, "Time", "h", "00:00"), "h")[2] == 0.0


def test_inferred_time(spark, tmp_path):
    # Type inference takes "17:42" for a timestamp of today.
    file = tmp_path / "times.csv"
    file.write_text("id,Time\n1,17:42\n2,\n")
    df = scan_csv(spark, str(file), infer=True)
    assert dict(df.dtypes)["Time"] == "timestamp"
    rows = derive.hour_from_text(df, "Time", "h", "00:00").orderBy("id").collect()
    assert [r["h"] for r in rows] == [17.0, 0.0]
    assert [r["h"] for r in derive.hour_of(df, "Time", "h").orderBy("id").collect()] == [17, None]


def test_time_features_of_real_timestamps(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-31 02:30:00' AS ts, '02:30' AS t")
    row = derive.time_features(df, "ts", "ts").first()
    assert (row["Accident_Date"], row["Hour"], row["Month"]) == (datetime.date(2024, 3, 31), 2, 3)
    assert derive.hour_of(df, "t", "h").first()["h"] == 2


def test_missing_codes(raw):
    out = clean.sentinel_to_null(raw, ["Junction_Control", "Urban_or_Rural_Area", "not there"], -1)
    assert column(out, "Junction_Control") == ["2", None, "None", "4", None]
    assert column(out, "Urban_or_Rural_Area") == [1, 2, 3, None, None]
    assert column(out, "Longitude")[1] == -1.0


def test_true_coordinate_is_lost_with_the_preset(raw):
    assert column(prepare_model(raw), "Longitude")[1] is None


def test_labels(raw):
    out = derive.weekday_label(derive.area_label(derive.severity_label(raw)))
    assert column(out, "Severity_Label") == ["Fatal", "Serious", "Slight", "Slight", "Slight"]
    assert column(out, "Area_Label") == ["Urban", "Rural", "Other", "Other", "Other"]
    assert column(out, "Day_Name") == ["Sunday", "Monday", "Tuesday", "Saturday", "Saturday"]


def test_labels_without_default(raw):
    out = derive.recode(raw, "Accident_Severity", P.SEVERITY, out="label")
    assert column(out, "label") == ["Fatal", "Serious", None, None, None]


def test_labels_of_text_codes(spark):
    df = spark.createDataFrame([("1",), ("2.0",), ("None",), (None,)], "code string")
    assert [r[0] for r in derive.recode(df, "code", P.SEVERITY, "Slight").collect()] == [
        "Fatal", "Serious", "Slight", "Slight",
    ]


def test_present_columns(raw):
    assert clean.present_columns(raw, ["Same", "gone", "Date"]) == (["Same", "Date"], ["gone"])


def test_names_with_parentheses_and_hyphens(spark):
    df = spark.sql("SELECT '-1' AS `Local_Authority_(District)`, 2 AS `a.b`, -1 AS `Pedestrian_Crossing-Human_Control`")
    out = clean.sentinel_to_null(df, df.columns, -1)
    assert [r["nulls"] for r in null_report(out).collect()] == [1, 0, 1]


def test_nan_counts_as_missing(spark):
    df = spark.sql("SELECT * FROM VALUES (double('NaN'), 'x'), (1.0D, NULL), (NULL, 'NaN') t(a, b)")
    assert [(r["column"], r["nulls"]) for r in null_report(df).collect()] == [("a", 2), ("b", 1)]
    assert clean.drop_incomplete(df).count() == 0
    assert clean.drop_incomplete(df, ["b"]).count() == 2


def test_speed_without_value_is_no_box(raw):
    driven = clean.filter_positive(derive.severity_label(raw), "Speed_limit")
    boxes = box_stats(driven, "Severity_Label", "Speed_limit", P.SEVERITY_ORDER)
    assert [(r["group"], r["n"], r["median"]) for r in boxes.collect()] == [
        ("Slight", None, None), ("Serious", 1, 60.0), ("Fatal", 1, 30.0),
    ]


def test_constant_has_no_correlation(raw):
    rows = {(r["a"], r["b"]): r["r"] for r in corr_matrix(raw, ["Latitude", "Same", "Longitude"]).collect()}
    assert rows["Same", "Latitude"] is None and rows["Same", "Same"] is None
    assert rows["Latitude", "Latitude"] == pytest.approx(1.0)


def test_correlation_leaves_words_out(raw):
    words = drop_unnamed(raw).withColumn("Road_Type", F.lit("Single"))
    names = {r["a"] for r in correlation(prepare_exploration(words)).collect()}
    assert "Road_Type" not in names and "Latitude" in names


def test_text_has_no_correlation(raw):
    with pytest.raises(TypeError, match="Road_Type"):
        corr_matrix(raw, ["Latitude", "Road_Type"])


def test_ingest_prunes_partitions(spark, raw, tmp_path):
    dated = derive.parse_date(raw, "Date", out="day").withColumn("year", F.year("day"))
    for i, rebalance in enumerate((False, True)):
        stored = ingest(dated, str(tmp_path / f"t{i}"), ["year"], rebalance=rebalance)
        one = stored.filter("year = 2005")
        assert (stored.count(), one.count()) == (5, 2)
        assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()


def test_read_table(spark, path, raw, tmp_path):
    ingest(drop_unnamed(raw), str(tmp_path / "t"))
    for df in (read_table(spark, path), read_table(spark, path, often=True), read_table(spark, str(tmp_path / "t"))):
        assert "_c0" not in df.columns and df.count() == 5


def test_cached(spark, raw):
    with cached(raw) as df:
        assert df.is_cached
    assert not raw.is_cached
