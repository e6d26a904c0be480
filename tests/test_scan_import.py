from regspark.operators import scan as C
from regspark.operators.findings import FindingStore
from regspark.plans import importer as I
from regspark.plans.scan_import import scan_to_import
from regspark.session import fresh_path

RULES = (C.Rule("key", r"key=([a-z]+)", ("key=",)),)


def test_files_to_imported_secrets(spark):
    files = spark.createDataFrame([
        ("l1", "etc/a.env", "x\nkey=abc key=abd\n"), ("l1", "b", None), ("l2", "opt/c/d.txt", "key=abc key=abd"),
        ("l2", "e", "nothing"), ("l3", "f", "")], "layer string, file string, text string")
    want = [("l1", "etc/a.env", ".env", 2, "abd"), ("l2", "etc/a.env", ".env", 2, "abd")]
    store = FindingStore(spark, fresh_path(spark, "store"))
    for more in ({}, {"store": store, "run": "1"}, {"store": store, "run": "2"}):
        counts, held, records = scan_to_import(files, RULES, **more)
        secrets, occurrences = I.import_held(held, records)
        got = occurrences.join(secrets.select("fragment_hash", "secret"), "fragment_hash").select(
            "digest", "file", "file_type", "start_line", "secret")
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(tuple(r)[:4] for r in counts.collect()) == [("l1", 2, 2, 18), ("l2", 2, 3, 22), ("l3", 1, 1, 0)]


def test_no_files(spark):
    files = spark.createDataFrame([], "layer string, file string, text string")
    assert [df.count() for df in scan_to_import(files, RULES)] == [0, 0, 0]
