import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerlens.functions import figures, scoring, sql


def test_functions_in_sql(spark):
    assert sql.register(spark) == ["parse_figure", "values_agree", "document_key", "explode_cells", "page_cells"]
    tokens = ["1,234", "(565)", "(5", "-5", "(-5)", "$1,234.5", "", "-", "abc", None, " 42 "]
    spark.createDataFrame([(x,) for x in tokens], "token string").createOrReplaceTempView("tokens")
    both = spark.table("tokens").select(F.expr("parse_figure(token)").alias("a"), figures.parse_figure(F.col("token")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both] and both[1].a == -565.0
    pairs = spark.createDataFrame([(1.0, 1.004), (1.0, 1.01), (0.0, 0.0), (0.004, 0.0), (None, 1.0)], "p double, e double")
    both = pairs.select(F.expr("values_agree(p, e)").alias("a"), scoring.values_agree(F.col("p"), F.col("e"), F.lit("USD")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    assert spark.sql("select document_key(7, 'a-1')").first()[0] == "0000000007_a-1"
    spark.createDataFrame([(1, [["a", "b"], [], ["c"]])], "id int, cells array<array<string>>").createOrReplaceTempView("printed")
    got = spark.sql("select id, x.* from printed, lateral explode_cells(cells) as x").collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 2, 0, "c")]


def test_cells_of_pages_in_sql(spark):
    sql.register(spark)
    page = "<p>x</p><table><tr><td>a</td><td>1</td></tr><tr><td></td><td>2</td></tr></table><table><tr><th>b</th></tr></table>"
    df = spark.createDataFrame([(7, page, "k", 1), (8, None, "k", 2), (9, "", "m", 3), (10, page, "m", 4)], "page_id long, Html string, kind string, n int")
    df.createOrReplaceTempView("landed")
    want = [(0, 0, 0, "a"), (0, 0, 1, "1"), (0, 1, 0, ""), (0, 1, 1, "2"), (1, 0, 0, "b")]
    for clause in ("", " partition by (kind) order by (n)"):
        got = spark.sql(f"select * from page_cells(table(landed){clause}, 'page_id', 'html') order by page_id, table_index, row_index, cell_index")
        assert got.dtypes == [("page_id", "bigint"), ("table_index", "int"), ("row_index", "int"), ("cell_index", "int"), ("cell", "string")]
        assert [tuple(r) for r in got.collect()] == [(k, *x) for k in (7, 10) for x in want]
    assert spark.sql("select * from page_cells(table(landed), 'kind', 'html')").dtypes[0] == ("kind", "string")
    for call in ("table(landed), 'page_id', 'no'", "table(landed), 'page_id', 'n'", "1, 'page_id', 'html'"):
        with pytest.raises(AnalysisException, match="page_cells"):
            spark.sql(f"select * from page_cells({call})")
