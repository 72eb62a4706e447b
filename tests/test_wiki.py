"""Pages that agree with their facts have no errors; each kind of damage is named; exports come back whole."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import wiki as W
from heddle.sources.files import markdown_cards


@pytest.fixture(scope="module")
def made(spark):
    modules = spark.createDataFrame([("a/x.c", "a"), ("a/y.c", "a"), ("b/z.c", "b")], "path string, module string")
    nodes = spark.createDataFrame([(1, "a/x.c", "f"), (2, "a/y.c", "g"), (3, "b/z.c", "h")], "id int, path string, name string")
    defined = nodes.withColumn("anchor", F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 16))
    calls = spark.createDataFrame([(1, 2, "a/x.c", "a/y.c"), (1, 3, "a/x.c", "b/z.c"), (2, 3, "a/y.c", "b/z.c"), (3, 3, "b/z.c", "b/z.c")], "src int, dst int, src_path string, dst_path string")
    pages = W.file_pages(modules, defined).unionByName(W.module_pages(modules, calls))
    return modules, nodes, defined, calls, pages


def errors(made, pages):
    modules, nodes, defined, calls, _ = made
    return sorted(tuple(r) for r in W.integrity(pages, modules, nodes.select("id"), defined.select("id", "anchor"), calls).na.fill("-").collect())


def test_sound_pages(made):
    assert errors(made, made[-1]) == []


def test_damage_is_named(made):
    pages = made[-1]
    assert errors(made, pages.where("id <> 'files/a__y.c'")) == [("mechanism_missing", "-", "2"), ("missing_page", "files/a__y.c", "a/y.c"), ("missing_source", "modules/a", "wiki:files/a__y.c")]
    wrong = pages.withColumn("md", F.when(F.col("id") == "modules/a", F.regexp_replace("md", "（1 条", "（7 条")).otherwise(F.col("md")))
    assert {r for r, _, _ in errors(made, wrong)} == {"module_calls"} and len(errors(made, wrong)) == 6
    assert {r for r, _, _ in errors(made, pages.where("id <> 'modules/b'"))} == {"missing_page", "broken_link"}
    twice = pages.withColumn("md", F.when(F.col("id") == "files/b__z.c", F.concat("md", "md")).otherwise(F.col("md")))
    assert errors(made, twice) == [("mechanism_repeated", "-", "3")]


def test_export_comes_back(spark, made, tmp_path):
    pages = made[-1].withColumn("title", F.upper("id"))
    W.export(pages, str(tmp_path), meta=["level", "title"])
    back = markdown_cards(spark, f"{tmp_path}/pages/*/*.txt")
    got = {r["meta"]["id"]: (r["meta"]["title"], r["body"].rstrip("\n"), r["intact"] or True) for r in back.collect()}
    assert got == {r["id"]: (r["title"], r["md"].rstrip("\n"), True) for r in pages.collect()}
    index = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/index").collect())
    assert index == sorted(f"- [{i}]({i}.md)" for i in got)
