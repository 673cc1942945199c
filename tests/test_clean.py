import pytest
from pyspark.sql import functions as F

from shelfmark.operators import clean
from shelfmark.schema import CLEAN_COLUMNS, RAW_COLUMNS


def raw(spark, rows):
    full = [{c: None for c in RAW_COLUMNS} | r for r in rows]
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    return spark.createDataFrame([tuple(r[c] for c in RAW_COLUMNS) for r in full], schema)


def test_currency_and_brand(spark):
    df = raw(
        spark,
        [
            {"Pid": "1", "PriceCurrency": "USD", "Brand": "BrandA", "Manufacturer": "branda"},
            {"Pid": "2", "PriceCurrency": "EUR", "Brand": "BrandB", "Manufacturer": "BrandC"},
            {"Pid": "3", "PriceCurrency": "CAD"},
        ],
    )
    out = {r["Pid"]: r["MergedBrand"] for r in clean.clean_products(df).collect()}
    assert out == {"1": "BrandA", "3": None}
    assert clean.clean_products(df).columns == CLEAN_COLUMNS


def test_blank_manufacturer_keeps_missing_brand(spark):
    df = raw(spark, [{"Pid": "1", "Manufacturer": "  "}, {"Pid": "2", "Manufacturer": "Maker"}])
    assert {r["Pid"]: r["MergedBrand"] for r in clean.merge_brand(df).collect()} == {"1": None, "2": "Maker"}


def test_dirty_rows(spark):
    rows = [
        ("A001", "19.99", "15.99", "4.0", "yes", "1"),
        ("A002", "invalid", "18.0", None, "no", "0"),
        (None, "25.0", "bad", "5.0", "invalid", "maybe"),
        ("", "10.0", None, "2.0", None, "true"),
        ("A005", "", "20.0", "oops", "True", "f"),
    ]
    names = ["Pid", "Price", "FinalPrice", "Discount", "isOnSale", "IsInStock"]
    df = raw(spark, [dict(zip(names, r)) for r in rows])
    kept = clean.validate_boolean(clean.validate_numeric(clean.drop_missing_key(df))).select(*names).orderBy("Pid").collect()
    assert [tuple(r) for r in kept] == [
        ("A001", 19.99, 15.99, 4.0, True, True),
        ("A002", None, 18.0, None, False, False),
        ("A005", None, 20.0, None, True, False),
    ]
    assert tuple(clean.drop_report(df).first()) == (5, 3, 2, 40.0)
    bad = {r["field"]: r["invalid"] for r in clean.invalid_value_report(df).collect()}
    assert bad == {"Price": 1, "FinalPrice": 1, "Discount": 1, "isOnSale": 1, "IsInStock": 1}


@pytest.mark.parametrize(
    "text,number",
    [("42", 42.0), ("3.14", 3.14), (" 2.718 ", 2.718), ("1e3", 1000.0), ("", None), (None, None), ("19.99d", None), ("nan", None), ("not a number", None)],
)
def test_numbers(spark, text, number):
    df = spark.createDataFrame([(text,)], "Price string")
    assert clean.validate_numeric(df).first()[0] == number


def test_text_and_typed_booleans(spark):
    df = spark.createDataFrame([(" hello ", 123, [1]), ("", None, None)], "a string, b int, c array<int>")
    assert [tuple(r) for r in clean.validate_text(df, ["a", "b", "c"]).collect()] == [("hello", "123", None), (None, None, None)]
    nums = spark.createDataFrame([(0,), (2,), (None,)], "isOnSale int")
    assert [r[0] for r in clean.validate_boolean(nums).collect()] == [False, True, None]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="Category"):
        clean.required_columns(spark.createDataFrame([("1",)], "Pid string"))


def test_document_and_filters(spark):
    df = raw(spark, [{"Pid": "1", "Name": "Red Chair", "Color": "RED", "Brand": "X", "Gender": None}])
    assert clean.build_document(clean.merge_brand(df)).first()["document"] == "red chair x red"
    names = spark.createDataFrame([("Red chair",), (None,), ("desk",)], "Name string")
    assert clean.filter_text_contains(names, "Name", "CHAIR").count() == 1
    assert clean.filter_text_contains(names, "Name", "chair", negate=True).count() == 2
    assert clean.filter_nonblank_text(names.unionByName(names.select(F.lit(" ").alias("Name"))), "Name").count() == 2
