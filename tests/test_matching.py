from pyspark.sql import functions as F

from fieldtrust.functions.matching import field_match


def _match(spark, rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "i int, f string, p string, g string, pn double, gn double"
    )
    m = field_match(F.col("f"), F.col("p"), F.col("g"), F.col("pn"), F.col("gn"))
    return [r["m"] for r in df.select("i", m.alias("m")).orderBy("i").collect()]


def test_cases(spark):
    rows = [
        ("vendor_name", None, "Acme", None, None),
        ("vendor_name", "ACME  corp", "acme Corp", None, None),
        ("invoice_date", "15/03/2024", "2024-03-15", None, None),
        ("subtotal", "1,500.00", None, None, 1500.0),
        ("subtotal", None, None, 1500.004, 1500.0),
        ("subtotal", None, None, 1500.02, 1500.0),
        ("subtotal", "1400", "1500", None, None),
        ("subtotal", "N/A", "N/A", None, None),
        ("tax.total_tax", "18", None, None, 18.01),
        ("vendor_address", "1 Main\nMumbai", "1 Main, Mumbai", None, None),
        ("vendor_address", "Delhi", "Mumbai", None, None),
        ("buyer_name", "x", None, None, None),
        ("buyer_name", None, None, None, None),
    ]
    assert _match(spark, rows) == [
        False, True, True, True, True, False, False, False, True, True, False, None, None,
    ]
