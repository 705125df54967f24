from seriesloom import cli


def test_all_verbs(spark, tmp_path, capsys):
    root = f"file://{tmp_path}"
    conf = tmp_path / "small.conf"
    conf.write_text(f"log={tmp_path}/log\ncount=200\nlength=32\nsegments=4\ncardinality=16\nmax_records=50\nleaf_threshold=10\nsampling=no\nk=5\nradius=6.0\nknn_type=2\n")
    at = ["--config", str(conf)]
    cli.main(["generate", *at, "--root", root])
    series = f"{root}/walks-200-32-1"
    cli.main(["build", *at, "--series", series, "--index", f"{root}/index"])
    cli.main(["label", *at, "--series", series, "--labels", f"{root}/all", "--kind", "exact", "knn", "range"])
    for kind in ("exact", "knn", "range"):
        cli.main(["label", *at, "--series", series, "--labels", f"{root}/{kind}", "--kind", kind])
        assert spark_rows(f"{root}/all/{kind}") == spark_rows(f"{root}/{kind}") > 0
        cli.main(["query", *at, "--index", f"{root}/index", "--labels", f"{root}/{kind}", "--kind", kind])
    cli.main(["evaluate", *at, "--series", series])
    assert "level" in capsys.readouterr().out
    log = (tmp_path / "log").read_text()
    assert "written to" in log and "partitions;" in log and "low=" in log


def spark_rows(path):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().read.parquet(path).count()
