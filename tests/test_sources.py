import os
import shutil

from auditlens.sources.csv import read_csv
from auditlens.sources.sinks import next_version, write_metrics, write_reports
from auditlens.streaming import incremental as ING


def test_csv_encodings_na_and_order(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Call ID,Name,Note\n007,café,NA\n008,\"multi\nline\",ok\n".encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("Call ID,Name,Note\n009,caf\xe9,n/a\n".encode("latin-1"))
    df = read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    rows = sorted(df.collect(), key=lambda r: (r._seq.file, r._seq.block, r._seq.pos))
    assert [r["Call ID"] for r in rows] == ["007", "008", "009"]
    assert [r.Name for r in rows] == ["café", "multi\nline", "café"]
    assert [r.Note for r in rows] == [None, "ok", None]


def test_versioned_reports(spark, tmp_path):
    base = str(tmp_path / "reports")
    df = spark.createDataFrame([("a", 1)], "metric string, value long")
    first = write_reports(spark, {"m": df}, base)
    assert first.endswith("v=1") and next_version(spark, base).endswith("v=2")
    write_metrics(df, str(tmp_path / "metrics"))
    text = "".join(open(os.path.join(tmp_path / "metrics", f)).read()
                   for f in os.listdir(tmp_path / "metrics") if f.startswith("part-"))
    assert text.strip() == "a : 1"


def test_incremental_ingest_skips_known_content(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.png").write_bytes(b"\x89PNG one")
    (src / "two.PNG").write_bytes(b"\x89PNG two")
    (src / "skip.txt").write_bytes(b"text")
    out, ckpt = str(tmp_path / "results"), str(tmp_path / "ckpt")
    ING.start(spark, str(src), out, ckpt).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    shutil.copy(src / "one.png", src / "copy.png")      # same bytes under a new name
    (src / "three.jpg").write_bytes(b"jpg three")
    ING.start(spark, str(src), out, ckpt).awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    assert ING.results(spark, out).count() == 3


def test_duplicate_headers_keep_pandas_names(spark, tmp_path):
    from auditlens.sources.columns import resolve_column
    (tmp_path / "d.csv").write_bytes(b"Call ID,call id,Call ID,Name\n1,2,3,x\n")
    df = read_csv(spark, str(tmp_path / "d.csv"))
    assert [c for c in df.columns if c != "_seq"] == ["Call ID", "call id.1", "Call ID.2", "Name"]
    assert resolve_column(df.columns, ["Call ID"]) == "Call ID"
    assert [r["Call ID.2"] for r in df.collect()] == ["3"]


def test_list_images_and_overall_line(spark, tmp_path):
    from auditlens.operators.summary import overall_label
    from auditlens.sources.files import list_images
    d1, d2 = tmp_path / "in", tmp_path / "in2"
    d1.mkdir()
    d2.mkdir()
    (d1 / "a.png").write_bytes(b"a")
    (d1 / "b.JPG").write_bytes(b"b")
    (d1 / "c.txt").write_bytes(b"c")
    (d2 / "d.jpeg").write_bytes(b"a")
    rows = list_images(spark, [str(d1), str(d2)]).collect()
    assert sorted(os.path.basename(r.path) for r in rows) == ["a.png", "b.JPG", "d.jpeg"]
    assert len({r.content_hash for r in rows}) == 2
    ov = spark.createDataFrame([(3, 4, 0.75)], "total_correct long, total_calls_fields long, overall_accuracy double")
    assert overall_label(ov).first()[0] == "Total correct = 3 Total calls fields = 4 , overall accuracy = 3/4"


def test_next_version_ignores_other_folders_and_writes_csv(spark, tmp_path):
    base = tmp_path / "r"
    (base / "v=3").mkdir(parents=True)
    (base / "notes").mkdir()
    (base / "v=x").mkdir()
    df = spark.createDataFrame([("a,b", 'say "hi"')], "k string, v string")
    out = write_reports(spark, {"t": df}, str(base), fmt="csv")
    assert out.endswith("v=4")
    back = spark.read.option("header", True).option("escape", '"').csv(f"{out}/t").collect()
    assert [(r.k, r.v) for r in back] == [("a,b", 'say "hi"')]


def test_incremental_force_refresh_reprocesses(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.png").write_bytes(b"A")
    out = str(tmp_path / "res")
    ING.start(spark, str(src), out, str(tmp_path / "c1")).awaitTermination(120)
    # a new stream (own checkpoint) over the same folder: known content is skipped ...
    ING.start(spark, str(src), out, str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 1
    # ... unless refreshing, and the latest batch then supersedes the older row
    ING.start(spark, str(src), out, str(tmp_path / "c3"), force_refresh=True).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    assert ING.results(spark, out).count() == 1
