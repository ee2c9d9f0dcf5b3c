"""Both jobs: against SQL, two runs over growing input, reruns, single blocks, awkward pages, and the command line."""

import json
import os
import subprocess
import sys

import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from jobs import label_release, page_intake
from jobs import queries as J
from labelforge import fixtures as X

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(J.QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), J.QUERIES[name], J.SQL[name], sf_dir) == ""


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.fixture
def folders(tmp_path):
    return {k: str(tmp_path / k) for k in ("pages", "out", "state")}


def test_intake_takes_only_what_is_new(spark, sf_dir, folders):
    every = spark.read.parquet(f"{sf_dir}/pages.parquet")
    first, second = every.filter("page_id % 3 < 2"), every.filter("page_id % 3 = 2")
    first.repartition(3).write.parquet(folders["pages"])
    told = page_intake.run(spark, **folders)
    assert told == {"read": first.count(), "written": first.count(), "held": first.count()}
    # a rerun without new files changes nothing
    before = rows_of(page_intake.current(spark, folders["out"]))
    assert page_intake.run(spark, **folders) == {"read": 0, "written": 0, "held": first.count()}
    assert rows_of(page_intake.current(spark, folders["out"])) == before
    # growth: new pages, and one of the old ones delivered again with another title
    again = first.filter("page_id = 0").withColumn("html", F.lit('<html lang="de"><title>New &amp; better</title><a href=\'/x\'>Magic</a><a class="t" href=/y>MAGIC</a><a href="/k">Kindle</a>'))
    second.unionByName(again).coalesce(1).write.mode("append").parquet(folders["pages"])
    told = page_intake.run(spark, **folders, config={"files_per_batch": 1})
    assert told["read"] == told["written"] == second.count() + 1
    found = {r.page_id: r for r in page_intake.current(spark, folders["out"]).collect()}
    assert len(found) == every.count() and (found[0].title, found[0].tags, found[0].n_links, found[0].lang) == ("New & better", "Magic", 3, "de")
    # the same as one run over everything
    other = {k: f"{v}-whole" for k, v in folders.items()} | {"pages": folders["pages"]}
    page_intake.run(spark, **other)
    assert rows_of(page_intake.current(spark, other["out"])) == rows_of(page_intake.current(spark, folders["out"]))
    coverage = spark.read.parquet(f"{folders['out']}/coverage")
    assert coverage.agg(F.sum("pages")).first()[0] == every.count()
    assert "usable" in {r.status for r in coverage.collect()}


def test_awkward_pages(spark, folders):
    rows = [
        (1, None, None), (2, "not a url", "   "), (3, "HTTPS://Shop.Example.com:8080/x?y", "<p>Enter the characters you see below</p>"), (4, "http://a.b", "<p>no title</p>"),
        (None, "http://a.b/c", "<title>T</title>"), (6, "http://a.b", "<HTML LANG=fr-CA><title> A \n &lt;B&gt; </title>" + "<a href='/z'>x</a>" * 2000), (6, "http://a.b", "<HTML LANG=fr-CA><title> A \n &lt;B&gt; </title>" + "<a href='/z'>x</a>" * 2000),
    ]
    spark.createDataFrame(rows, page_intake.PAGES).coalesce(1).write.parquet(folders["pages"])
    page_intake.run(spark, **folders)
    found = {r.page_id: r for r in page_intake.current(spark, folders["out"]).collect()}
    assert {k: r.status for k, r in found.items()} == {1: "empty", 2: "empty", 3: "blocked", 4: "untitled", None: "usable", 6: "usable"}
    assert (found[6].title, found[6].lang, found[6].n_links, found[6].tags) == ("A <B>", "fr", 2000, "x")
    assert (found[1].host, found[2].host, found[3].host, found[3].lang) == ("", "", "shop.example.com", "und")


def test_intake_of_no_pages(spark, folders):
    spark.createDataFrame([], page_intake.PAGES).coalesce(1).write.parquet(folders["pages"])
    assert page_intake.run(spark, **folders) == {"read": 0, "written": 0, "held": 0}


def test_release_for_some_blocks_leaves_the_others(spark, sf_dir, tmp_path):
    out, config = str(tmp_path / "labels"), {"books_per_block": 100}
    whole = label_release.run(spark, sf_dir, out, config)
    before = rows_of(label_release.released(spark, out))
    assert sum(whole.values()) == X.labels(spark, sf_dir).select("isbn13", "field", "path").distinct().count()
    assert label_release.run(spark, sf_dir, out, config) == whole and rows_of(label_release.released(spark, out)) == before
    # other rules for one block change that block alone
    some = label_release.run(spark, sf_dir, out, config | {"review_reasons": []}, blocks=[2])
    assert "review" not in some
    now = label_release.released(spark, out)
    assert rows_of(now.filter("block <> 2")) == [r for r in before if "block=2)" not in r]
    assert now.filter("block = 2 and outcome = 'review'").isEmpty() and sum(some.values()) == now.filter("block = 2").count()


def test_settings_stay_as_they_are(spark, sf_dir):
    names = ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    for f in J.QUERIES.values():
        f(spark, sf_dir).count()
    assert [spark.conf.get(n) for n in names] == before
    assert not [q for q in spark.streams.active]


@pytest.mark.parametrize("job, options", [("page_intake", lambda d, t: ["--pages", f"{d}/page[s].parquet", "--out", f"{t}/out", "--state", f"{t}/state"]), ("label_release", lambda d, t: ["--data", d, "--out", f"{t}/out", "--blocks", "0,1"])])
def test_command_line(sf_dir, tmp_path, job, options):
    config = json.loads(open(f"{ROOT}/jobs/{job}.json").read())
    assert config
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    ran = subprocess.run([sys.executable, "-m", f"jobs.{job}", *options(sf_dir, tmp_path), "--config", f"{ROOT}/jobs/{job}.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "wrote" in ran.stderr and os.path.isdir(tmp_path / "out")
