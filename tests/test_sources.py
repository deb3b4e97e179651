import zipfile

from pyspark.sql import functions as F

from shelfmatch.sources.store import VectorTable
from shelfmatch.sources.xlsx import read_table, workbook, write_results

_SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>ProductDescription</t></is></c></row>
<row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>"""


def _workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>ProductCode</t></si><si><t>Beef</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", _SHEET)


def test_xlsx(spark, tmp_path):
    _workbook(tmp_path / "t.xlsx")
    got = read_table(spark, str(tmp_path / "t.xlsx"), "Sheet1")
    assert [tuple(r) for r in got.orderBy("ProductCode").collect()] == [(None, "Beef"), ("7", "Beef")]
    to = write_results(got, str(tmp_path / "out"), 0.7)
    assert to.endswith("_threshold_0.70") and spark.read.option("header", True).csv(to).count() == 2


def test_workbooks_of_a_folder(spark, tmp_path):
    odd = [("1", "a <b> & \"c\"\n d "), (None, "é\r\nß"), ("3", None), ("4", "x\x00y")]
    for i in range(3):
        (tmp_path / f"b{i}.xlsx").write_bytes(workbook(["Product Code", "N`x"], odd[i:], "Data"))
    got = read_table(spark, f"{tmp_path}/*.xlsx", "Data")
    assert got.columns == ["Product Code", "N`x"]
    want = [r for i in range(3) for r in odd[i:]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((a, b and b.replace("\0", "\ufffd"))) for a, b in want)
    (tmp_path / "r.csv").write_text("id,n\n7,1.5\n")
    assert read_table(spark, str(tmp_path / "r.csv"), schema="id string, n double").first()["n"] == 1.5


def test_vector_table(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v"))
    row = lambda i, v: (f"item_{i}", v, (f"d{i}", str(i), "c" if i else "NOT_FOUND"))
    schema = "id string, vector array<double>, metadata struct<product_description:string,product_code:string,usda_code:string>"
    table.add(spark.createDataFrame([row(0, [1.0, 0.0]), row(1, [0.8, 0.6])], schema))
    table.add(spark.createDataFrame([row(1, [0.0, 1.0]), row(2, [0.0, 1.0])], schema))
    assert table.count() == 3 and table.get(["item_1"]).first()["vector"] == [0.8, 0.6]
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<double>")
    assert [r["id"] for r in table.search(q, 5, 0.5).orderBy("rk").collect()] == ["item_0", "item_1"]
    assert [r["id"] for r in table.search(q, 5, None, {"usda_code": {"$ne": "NOT_FOUND"}}).orderBy("rk").collect()] == ["item_1", "item_2"]
    none = table.search(q, 5, 2.0)
    assert none.count() == 0 and "distance" in none.columns
    table.add(spark.createDataFrame([row(9, [1.0, 1.0])], schema), recreate=True)
    assert table.count() == 1


def test_stream_adds_what_is_absent(spark, tmp_path):
    from shelfmatch.streaming.ingest import ingest

    schema = "id string, vector array<double>, metadata struct<product_description:string,product_code:string,usda_code:string>"
    rows = spark.range(4).select(F.concat(F.lit("i"), F.col("id") % 3).alias("id"), F.array(F.lit(1.0)).alias("vector"), F.lit(None).cast(schema.split("metadata ")[1]).alias("metadata"))
    rows.write.parquet(str(tmp_path / "in"))
    table = VectorTable(spark, str(tmp_path / "v"))
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), table, str(tmp_path / "c")).awaitTermination()
    assert table.count() == 3
