from pyspark.sql.classic.dataframe import DataFrame

from lexmill.llm import urls


def test_filter_runs_no_python(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(DataFrame, name, refused)
    link = '<link rel="canonical" href="{}">'
    names = [f"http://h{i}.com/p" for i in range(5)] + ["http://a.net/x"]
    rows = [(i, names[i], link.format(names[i + 1])) for i in range(5)] + [(5, names[5], None), (6, "http://other.com/", None)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {i: "allow" if i == 6 else "block" for i in range(7)}
