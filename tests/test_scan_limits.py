import pytest

from ferrule.sources import files


def test_files_over_their_limit_are_not_opened(spark, tmp_path):
    for name, size in {"a.log": 90, "B.LOG": 200, "c.dat": 250, "none": 30}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    setting = "spark.sql.sources.binaryFile.maxLength"  # Spark refuses to open what is longer
    spark.conf.set(setting, "260")
    (tmp_path / "d.log").write_bytes(b"x" * 300)
    try:
        got = files.capped(files.scan(spark, str(tmp_path), limits={"log": 100}), {"log": 100}).collect()
        with pytest.raises(Exception, match="(?i)length"):
            files.scan(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset(setting)
    told = {r["name"]: (r["size"], r["oversized"], r["content"] and len(r["content"])) for r in got}
    assert told == {"a.log": (90, False, 90), "B.LOG": (200, True, None), "d.log": (300, True, None), "c.dat": (250, False, 250), "none": (30, False, 30)}


def test_one_file_as_root(spark, tmp_path):
    (tmp_path / "one.log").write_bytes(b"abc")
    (tmp_path / "two.log").write_bytes(b"abc")
    got = files.scan(spark, str(tmp_path / "one.log"), limits={"log": 10}).collect()
    assert [(r["name"], r["ext"], r["size"], bytes(r["content"])) for r in got] == [("one.log", "log", 3, b"abc")]
