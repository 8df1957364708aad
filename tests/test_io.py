import io
import tarfile

import pytest

from quillmark.sources import readers, search, sinks
from quillmark.streaming import resume


def test_jsonl_and_missing_paths(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n  \n{"k": 2}\n', encoding="utf-8")
    assert sorted(r.k for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    assert readers.read_jsonl_if_exists(spark, str(tmp_path / "none"), "k int").count() == 0
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "none"), "k int").count()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p", ["a", "b"], [("x", 1)], 'say "hi",\nbye'), ("q", None, None, None)], "pmcid string, article_types array<string>, audit array<struct<i:string,n:int>>, t string")
    sinks.write_csv(df, str(tmp_path / "c"), ["pmcid", "article_types", "audit", "t", "absent"])
    got = {r.pmcid: r for r in readers.read_csv_rows(spark, str(tmp_path / "c")).collect()}
    assert got["p"].article_types == ["a", "b"] and got["p"].t == 'say "hi",\nbye' and got["p"].audit == '[{"i":"x","n":1}]' and got["q"].article_types == []
    (tmp_path / "b.csv").write_text("﻿pmcid,full_text\n1,x\n", encoding="utf-8")
    assert readers.read_csv_rows(spark, str(tmp_path / "b.csv")).columns == ["pmcid", "full_text"]


def test_union_header_is_sorted(spark, tmp_path):
    sinks.write_csv_union([spark.createDataFrame([(1,)], "b int"), spark.createDataFrame([(2, 3)], "c int, a int")], str(tmp_path / "u"))
    assert readers.read_csv_rows(spark, str(tmp_path / "u")).columns == ["a", "b", "c"]


def test_manifest_fallback(spark, tmp_path):
    (tmp_path / "m.json").write_text('﻿{"packages": [{"id": "p1"}, {"id": "p2"}]}', encoding="utf-8")
    assert sorted(r.id for r in readers.read_manifest(spark, str(tmp_path / "m.csv"), str(tmp_path / "m.json")).collect()) == ["p1", "p2"]


def test_archives(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tgz", "w:gz") as t:
        for name, data in (("d/A.jpg", b"1"), ("../evil", b"2"), ("d/a.nxml", b"<article><article-meta/></article>")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "y.tgz").write_bytes(b"not an archive")
    m = readers.archive_members(spark, str(tmp_path / "*.tgz"))
    assert sorted((r.member or "", r.safe) for r in m.collect()) == [("", False), ("../evil", False), ("d/A.jpg", True), ("d/a.nxml", True)]
    assert [r.member for r in readers.article_member(m).collect()] == ["d/a.nxml"]


def test_sealed_and_category_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "answer")], "k int, c string, target string")
    sinks.write_sealed(df, ["target"], ["k"], str(tmp_path / "open"), str(tmp_path / "seal"))
    assert spark.read.parquet(str(tmp_path / "open")).columns == ["k", "c"] and spark.read.parquet(str(tmp_path / "seal")).first().target == "answer"
    with pytest.raises(ValueError):
        sinks.write_sealed(df, ["target"], ["k"], str(tmp_path / "o"), str(tmp_path / "o/s"))
    sinks.write_by_category(df, spark.createDataFrame([("a",), ("b",)], "c string"), "c", str(tmp_path / "cat"))
    assert {p.name for p in (tmp_path / "cat").iterdir() if p.is_dir()} == {"c=a", "c=b"}
    for v in ("one", "two"):
        sinks.replace_table(spark.createDataFrame([(v,)], "v string"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().v == "two" and not (tmp_path / "t.aside").exists()
    (tmp_path / "t").rename(tmp_path / "t.aside")  # as a replacement that broke off leaves it
    assert sinks.restore_table(spark, str(tmp_path / "t")) and not sinks.restore_table(spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first().v == "two"
    sinks.write_csv_union([], str(tmp_path / "none"))
    assert readers.read_csv_rows(spark, str(tmp_path / "none")).columns == ["pmcid"]


def test_search(spark):
    assert search.query_text(["Actins"], ["cell", "myo*"]) == '("Actins"[mh] OR "cell"[tiab] OR myo*[tiab])'
    df = spark.createDataFrame([(1, "Actin bundling", 2015), (2, None, 2015), (3, "spindles", 1999)], "k int, t string, y int")
    from pyspark.sql import functions as F

    assert [r.k for r in search.search(df, ["actin", "spindle*"], ["t"], F.col("y"), 2000, 2020, ["k"], 5).collect()] == [1]


def test_stream_upsert_and_resume(spark, tmp_path):
    src = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "k string, seq long, v string").coalesce(1).write.mode("append").parquet(src)
    write([("a", 1, "x"), ("b", 1, "y")])
    for more in ([("a", 2, "z")], None):
        s = spark.readStream.schema("k string, seq long, v string").parquet(src)
        q = resume.upsert_stream(s, str(tmp_path / "state"), str(tmp_path / "ck"), ["k"], ["seq"])
        q.awaitTermination(120)
        if more:
            write(more)
    state = resume.state_of(spark, str(tmp_path / "state"), "k string, seq long, v string")
    assert {r.k: r.v for r in state.collect()} == {"a": "z", "b": "y"}
    req = spark.createDataFrame([("a",), ("c",)], "k string")
    assert [r.k for r in resume.pending(req, state, ["k"]).collect()] == ["c"]


def test_search_source(spark, data):
    from quillmark.session import ship_package
    from quillmark.sources.datasource import LandedSearch

    ship_package(spark)
    spark.dataSource.register(LandedSearch)
    df = spark.read.format("landed_search").options(path=f"{data}/paper.parquet", terms="kinase|spindle", start="2014", end="2024").load()
    want = spark.read.parquet(f"{data}/paper.parquet").filter("year between 2014 and 2024 and lower(concat(coalesce(title, ''), ' ', coalesce(abstract, ''))) rlike 'kinase|spindle'")
    assert sorted(r.row_id for r in df.collect()) == sorted(r.row_id for r in want.collect())
    assert {r.year for r in df.filter("year = 2020").collect()} <= {2020}
    assert df.filter("year = 2020").count() == want.filter("year = 2020").count()


def test_packages_snapshot_articles_release(spark, tmp_path):
    from quillmark.session import materialize, release

    t = spark.createDataFrame([("m1_1", "x")], "package_id string, v string")
    sinks.write_packages({"facts": t, "figures": t}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/figures")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_packages({"facts": t.drop("package_id")}, str(tmp_path / "q"))
    sinks.snapshot(str(tmp_path / "p/facts"), str(tmp_path / "copy"), spark)
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 1
    with pytest.raises(FileExistsError):
        sinks.snapshot(str(tmp_path / "p/facts"), str(tmp_path / "copy"), spark)
    (tmp_path / "a.xml").write_text("<article><front><article-meta><title-group><article-title>T</article-title></title-group></article-meta></front></article>")
    (tmp_path / "b.xml").write_text("<other/>")
    assert [r.title for r in readers.read_articles(spark, str(tmp_path / "*.xml")).collect()] == ["T"]
    m = materialize(t)
    assert m.count() == 1 and release(spark) >= 1
