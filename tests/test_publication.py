"""Hash store, fault-isolated ingest and published versions."""
import glob
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from auditlens.operators import hash_store
from auditlens.operators.hash_store import HashStore
from auditlens.plans import jobs
from auditlens.sources import sinks
from auditlens.streaming import incremental as ING


def hashes(spark, ids):
    return spark.createDataFrame([(i, None if i is None else f"k{i}") for i in ids], "id int, k string").withColumn("content_hash", F.sha2("k", 256)).drop("k")


@pytest.mark.parametrize("listed", [1000, 5])
def test_only_new_hashes_come_back(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(hash_store, "LISTED", listed)
    store = HashStore(spark, str(tmp_path / "s"))
    asked = hashes(spark, [*range(50, 150), None, 60, 149])
    assert store.rows() is None and store.new_only(asked).count() == 103
    store.append(hashes(spark, range(100)))
    store.append(hashes(spark, range(100, 120)))
    store.append(hashes(spark, []))
    got = [r.id for r in store.new_only(asked).collect()]
    assert sorted(got, key=str) == sorted([*range(120, 150), None, 149], key=str)
    assert store.hits(asked).count() == 70


def test_untouched_prefixes_are_not_read(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "s"))
    store.append(hashes(spark, range(400)))
    asked = hashes(spark, [7, 1007])
    wanted = {f"h{r.content_hash[:2]}" for r in asked.collect()}
    others = [f for f in glob.glob(f"{tmp_path}/s/{hash_store.PREFIX_COLUMN}=*/*.parquet") if f.split("/")[-2].split("=")[1] not in wanted]
    assert len(others) > 100
    for f in others:  # reading any of them would fail
        with open(f, "wb") as out:
            out.write(b"broken")
        crc = f"{os.path.dirname(f)}/.{os.path.basename(f)}.crc"
        os.path.exists(crc) and os.remove(crc)
    store = HashStore(spark, str(tmp_path / "s"))
    store.rows = lambda: spark.read.schema("id int, content_hash string, hash_prefix string").parquet(store.path)  # no footer to infer from
    assert [r.id for r in store.new_only(asked).collect()] == [1007]
    plan = store.hits(asked)._jdf.queryExecution().executedPlan().toString()
    assert "hash_prefix" in plan.split("PartitionFilters")[1].split("]")[0] and "content_hash" in plan.split("PushedFilters")[1].split("ReadSchema")[0]


def extractors():
    """(one that refuses some files, one that takes all), to be sent to the workers by value."""
    def read_header(path, content):
        if content.startswith(b"BAD"):
            raise ValueError("not an image")
        return {"size": len(content), "head": content[:3].decode()}

    return read_header, lambda path, content: {"size": -1, "head": None}


SCHEMA = "size long, head string"


def test_one_broken_file_is_a_dead_letter_and_is_retried(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(9):
        (src / f"{k}.png").write_bytes(b"PNG" + bytes([k]) * k)
    (src / "bad.png").write_bytes(b"BAD")
    out, ckpt = str(tmp_path / "results"), str(tmp_path / "ckpt")

    read_header, read_anything = extractors()

    def run(extract=read_header):
        ING.start(spark, str(src), out, ckpt, process=ING.per_file(extract, SCHEMA)).awaitTermination(120)
        return {os.path.basename(r.path): (r.attempts, r.error) for r in ING.listing(spark, out).collect()}

    got = run()
    assert sum(e is None for _, e in got.values()) == 9 and got["bad.png"] == (1, "ValueError: not an image")
    (src / "more.png").write_bytes(b"PNG more")
    (src / "copy.png").write_bytes(b"BAD")  # the same bytes again: no new file
    got = run()
    assert len(got) == 11 and got["bad.png"][0] == 2
    (src / "last.png").write_bytes(b"PNG last")
    got = run(read_anything)
    assert len(got) == 12 and all(e is None for _, e in got.values())
    assert ING.dead_letters(spark, out).count() == 0
    assert {r.size for r in ING.results(spark, out).collect() if r.path.endswith("bad.png")} == {-1}


def test_attempts_end_and_a_replayed_batch_adds_nothing(spark, tmp_path):
    store = HashStore(spark, str(tmp_path / "r"))
    files = spark.createDataFrame([(f"/f{k}", 3, bytearray(b"BAD" if k == 2 else b"ok" + bytes([k]))) for k in range(4)], "path string, length long, content binary")
    none = files.limit(0)
    process = ING.per_file(extractors()[0], SCHEMA)

    def state():
        letters = spark.read.parquet(ING.dead_letter_path(store.path))
        return store.rows().count(), sorted(r.attempts for r in letters.collect())

    for _ in range(2):
        ING.work_batch(files, store, "c#0", 0, process)
        assert state() == (3, [1])
    for n in (1, 2, 3, 4):
        ING.work_batch(none, store, f"c#{n}", n, process)
    assert state() == (3, [1, 2, 3])


def test_concurrent_jobs_get_different_versions(spark, tmp_path):
    base = str(tmp_path / "reports")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: sinks.next_version(spark, base), range(16)))
    assert len(set(got)) == 16 and sinks.versions(spark, base) == [] and len(sinks.versions(spark, base, published=False)) == 16


def test_unfinished_versions_are_never_latest(spark, tmp_path):
    base = str(tmp_path / "reports")
    df = spark.createDataFrame([("a", 1)], "metric string, value long")
    assert sinks.latest_version(spark, base) is None
    first = sinks.write_reports(spark, {"m": df}, base)
    with pytest.raises(RuntimeError):
        with sinks.new_version(spark, base) as out:
            sinks.write_table(df, f"{out}/m")
            raise RuntimeError("killed")
    assert sinks.latest_version(spark, base) == first and sinks.read_latest(spark, base, "m").count() == 1
    assert sinks.write_reports(spark, {"m": df}, base).endswith("v=3") and sinks.latest_version(spark, base).endswith("v=3")
    assert '"tables": ["m"]' in open(f"{base}/v=3/{sinks.MANIFEST}").read()


def test_a_job_that_fails_publishes_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Call ID,Seller GLID\n1,2\n")
    with pytest.raises(Exception):
        jobs.run_restore(spark, str(tmp_path / "a.csv"), str(tmp_path / "none.csv"), str(tmp_path / "out"))
    assert sinks.latest_version(spark, str(tmp_path / "out")) is None
