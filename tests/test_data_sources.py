"""Archives read by ranges, and exports that are seen whole or not at all."""

import base64
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from lexspan.sinks.whole import WholeExport, swept
from lexspan.sources import ingest
from lexspan.sources.archives import Archives


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(Archives)
    spark.dataSource.register(WholeExport)
    return spark


@pytest.mark.parametrize("split", [1, 7, 50, 333, 1 << 20])
def test_mail_folder(sources, tmp_path, split):
    rng = random.Random(split)
    bodies = [f"Subject: S{i}\n\nline\n>From the court\n" + "x" * rng.randint(0, 60) for i in range(12 if split < 7 else 40)]
    raw = "".join(f"From someone Mon\n{x.replace(chr(10) + 'From ', chr(10) + '>From ')}\n" for x in bodies)
    (tmp_path / "a.mbox").write_text(raw)
    read = sources.read.format("archives").option("splitBytes", split).load(str(tmp_path / "a.mbox"))
    want = [x.replace("\n>From ", "\nFrom ").rstrip("\n") + "\n" for x in bodies]
    rows = sorted(read.collect(), key=lambda r: int(r["entry"]))
    assert [r["content"] for r in rows] == want
    files = read.select(F.col("entry").cast("long").alias("doc_id"), "filename", "content")
    assert {r["format"] for r in ingest.ingest(files).collect()} == {"email"}


def test_zip_archives(sources, tmp_path):
    for name, n in (("a", 5), ("b", 0), ("c", 3)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for i in range(n):
                z.writestr(f"in/{name}{i}.txt", f"text {name}{i} ü")
            if n:
                z.writestr("d/w.docx", b"PK\x03\x04\xff")
    read = sources.read.format("archives").option("splitBytes", 20).load(str(tmp_path))
    assert read.rdd.getNumPartitions() > 3
    got = {(r["entry"], r["content"]) for r in read.filter("filename LIKE '%.txt'").collect()}
    assert got == {(f"in/{x}{i}.txt", f"text {x}{i} ü") for x, n in (("a", 5), ("c", 3)) for i in range(n)}
    assert {r["content"] for r in read.filter("filename = 'w.docx'").collect()} == {base64.b64encode(b"PK\x03\x04\xff").decode()}
    (tmp_path / "none").mkdir()
    assert sources.read.format("archives").load(str(tmp_path / "none")).count() == 0


def test_whole_export(sources, tmp_path):
    path, schema = str(tmp_path / "out"), "n long, s string, xs array<long>"
    df = sources.range(50).select(F.col("id").alias("n"), F.concat(F.lit("ü\n"), "id").alias("s"), F.array("id").alias("xs")).repartition(4)
    read = lambda: sorted(tuple(r) for r in sources.read.format("whole_export").schema(schema).load(path).collect())
    first = [(i, f"ü\n{i}", [i]) for i in range(50)]
    df.write.format("whole_export").mode("append").save(path)
    assert read() == first

    @F.udf("long")
    def breaks(n):
        if n == 33:
            raise ValueError("no")
        return n

    files = sorted(p.name for p in (tmp_path / "out/files").iterdir())
    for mode in ("append", "overwrite"):  # what fails is never seen
        with pytest.raises(Exception, match="no"):
            df.withColumn("n", breaks("n")).write.format("whole_export").mode(mode).save(path)
        assert read() == first
    time.sleep(1)  # tasks that were at work when the job failed
    swept(path, older=0)
    assert sorted(p.name for p in (tmp_path / "out/files").iterdir()) == files and read() == first
    df.filter("n < 3").write.format("whole_export").mode("append").save(path)
    assert read() == sorted(first + first[:3])
    df.filter("n = 7").write.format("whole_export").mode("overwrite").save(path)
    assert read() == [first[7]]
    df.limit(0).write.format("whole_export").mode("overwrite").save(path)
    assert read() == []
