import json

import pytest
from pyspark.sql import functions as F

from regspark import schemas
from regspark.operators import scan as C
from regspark.operators import windows as W
from regspark.sources import readers, writers
from regspark.streaming import streams as Q


def test_jsonl_rules(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_bytes(b"\n".join([
        b'{"digest": "a", "size": 5, "repos": ["x"]}\r', b"", b"{broken", b'{"digest": "", "size": 1}', b'{"size": 2}',
        b'{"digest": "b", "size": "text"}', b'{"digest": "c", "extra": 1, "repo_count": 3}', b"null"]))
    df = readers.read_jsonl(spark, str(path), schemas.DIGEST_ANALYSIS, "digest")
    assert sorted(map(tuple, df.select("digest", "size", "repo_count").collect())) == [("a", 5, None), ("c", 0, 3)]
    assert sorted(r.digest for r in df.select("digest").collect()) == ["a", "c"]


def test_order_columns_follow_the_file(spark, tmp_path):
    path = tmp_path / "stream.jsonl"
    lines = []
    for q in range(40):
        lines.append({"repo_name": "#/#", "query": f"q{q}"})
        lines += [{"repo_name": f"r{q}-{i}"} for i in range(25)]
    path.write_text("\n".join(map(json.dumps, lines)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = readers.read_jsonl(spark, str(path), schemas.SEARCH_ROW, "repo_name", order=True)
        assert raw.select("_offset").distinct().count() > 3
        filled = W.sentinel_fill(raw.withColumnRenamed("query", "_q"), F.col("repo_name") == "#/#", F.col("_q"),
                                 F.col("_offset"), ["_file"], ["_row"])
        got = {r.repo_name: r.query for r in filled.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"r{q}-{i}": f"q{q}" for q in range(40) for i in range(25)}


def test_chunks_and_lists(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"tags__{n}.jsonl").write_text('{"digest": "d%d"}\n' % n)
    df = readers.read_chunks(spark, str(tmp_path / "tags__*.jsonl"), schemas.DIGEST_ANALYSIS, "digest")
    assert sorted(map(tuple, df.select("chunk_no", "digest").collect())) == [(0, "d0"), (1, "d1"), (2, "d2")]
    (tmp_path / "list.json").write_text('{"repos": [\n "a",\n "", "b"]}')
    assert [r.repo for r in readers.read_list(spark, str(tmp_path / "list.json"), "repos", "repo").collect()] == ["a", "b"]
    names = spark.createDataFrame([('q"uote',), ("back\\slash",), (None,), ("é",)], "n string").repartition(3)
    writers.write_list(names, "n", str(tmp_path / "out"), "repos")
    back = readers.read_list(spark, str(tmp_path / "out"), "repos", "repo")
    assert sorted(r.repo for r in back.collect()) == sorted(['q"uote', "back\\slash", "é"])


def test_array_lines(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('null\n[]\n[{"fragment_hash": "h", "secrets": {"file": "f", "start_line": 3}}, {"fragment_hash": "g"}]\n')
    df = readers.read_array_lines(spark, str(path), schemas.SECRET_RECORD)
    assert [(r.fragment_hash, r.secrets.start_line if r.secrets else None) for r in df.collect()] == [("h", 3), ("g", None)]


def test_csv_round_trips(spark, tmp_path):
    hist = spark.createDataFrame([("a", 2), ("b", 6)], "key string, count long")
    writers.write_hist(hist, str(tmp_path / "h"))
    assert sorted(map(tuple, readers.read_hist(spark, str(tmp_path / "h")).collect())) == [("a", 2), ("b", 6)]
    writers.write_distribution(hist, str(tmp_path / "d"))
    assert {r["proportion"] for r in spark.read.option("header", True).csv(str(tmp_path / "d")).collect()} == {"0.25", "0.75"}
    (tmp_path / "wrong.csv").write_text("x,y\n1,2\n")
    assert readers.read_hist(spark, str(tmp_path / "wrong.csv")).count() == 0
    assert readers.read_bias(spark, str(tmp_path / "absent.csv")).count() == 0
    (tmp_path / "m.csv").write_text("key,p_full,p_sample\n2024-01,0.5,0.25\n2024-02,0.5,0\n2024-03,0,0\n")
    got = {r.key: r.bias_full_over_sample for r in readers.read_bias(spark, str(tmp_path / "m.csv"), True).collect()}
    assert got == {"2024-01": 2.0, "2024-02": float("inf"), "2024-03": 1.0}
    assert readers.read_bias(spark, str(tmp_path / "m.csv")).count() == 0


def test_jsonl_sink_rolls(spark, tmp_path):
    writers.write_jsonl(spark.range(100).coalesce(1), str(tmp_path / "z"), 30)
    assert len(list((tmp_path / "z").glob("*.json.gz"))) == 4


RULES = [C.Rule("key", r"key=([a-z0-9]+)", ("KEY",)), C.Rule("pin", r"pin:([0-9]{4})", min_entropy=1.0),
         C.Rule("any", r"(never)")]


def test_scan_reports_each_fragment_once(spark):
    files = spark.createDataFrame(
        [("l1", "a/x.env", "first\nkey=abc key=def pin:1234"), ("l2", "b/y.cfg", "key=abc key=def pin:1234\npin:1111"),
         ("l2", "z", ""), ("l3", "q", "Pin:9999 only")], "layer string, file string, text string")
    frags = C.fragments(files)
    found = C.secret_findings(frags, RULES)
    assert sorted((r.file, r.file_type, r.origin, r.secret, r.start_line) for r in found.collect()) == [
        ("a/x.env", ".env", "key", "abc", 2), ("a/x.env", ".env", "key", "def", 2), ("a/x.env", ".env", "pin", "1234", 2)]
    spread = C.scan_distinct(frags, RULES)
    assert sorted((r.layer, r.secret) for r in spread.collect()) == sorted(
        (layer, s) for layer in ("l1", "l2") for s in ("abc", "def", "1234"))
    assert sorted(r.layer for r in C.layer_secret_list(spread).collect()) == ["l1", "l2"]


def test_whole_file_fragments_find_the_line(spark):
    files = spark.createDataFrame([("l", "f", "a\nb\nkey=zz")], "layer string, file string, text string")
    [hit] = C.secret_findings(C.fragments(files, unit="file"), RULES).collect()
    assert hit.start_line == 3


def test_a_finding_has_the_line_of_its_own_match(spark):
    text = "abc\nkey=abc1\nx\nkey=abc1 key=\nkey=abc1\n-----BEGIN\nab\ncd\nEND"
    rules = [C.Rule("key", r"key=([a-z0-9]+)"), C.Rule("block", r"-----BEGIN\n([a-z\n]+)END")]
    files = spark.createDataFrame([("l", "f", text), ("m", "g", text)], "layer string, file string, text string")
    want = [("block", "ab\ncd\n", 7), ("key", "abc1", 2), ("key", "abc1", 4), ("key", "abc1", 5)]
    whole = C.secret_findings(C.fragments(files, unit="file"), rules).select("origin", "secret", "start_line").collect()
    assert sorted(map(tuple, whole)) == want
    for lines, overlap in ((5, 4), (6, 4), (40, 5)):
        cut = C.scan_distinct(C.fragments(files, unit="chunk", lines=lines, overlap=overlap), rules)
        for layer in "lm":
            mine = cut.where(F.col("layer") == layer).select("origin", "secret", "start_line").collect()
            assert sorted(map(tuple, mine)) == want, (lines, overlap)


def test_long_matches_are_whole_in_chunks(spark):
    lines = [f"line {i}" for i in range(1, 301)]
    lines[154:205] = ["-----BEGIN KEY-----", *(f"k{i}" for i in range(49)), "-----END KEY-----"]
    files = spark.createDataFrame([("l", "f", "\n".join(lines))], "layer string, file string, text string")
    regex = r"(-----BEGIN KEY-----[\s\S]*?-----END KEY-----)"
    for most, parts in ((None, 1), (51, 2), (120, 2)):
        rules = [C.Rule("key", regex, most_lines=most), C.Rule("line", r"(line 29[0-9])", most_lines=1)]
        cut = C.fragments(files, unit="chunk", rules=rules)
        assert cut.count() == parts
        found = [(r.origin, r.start_line) for r in C.secret_findings(cut, rules).collect()]
        assert sorted(found) == [("key", 155), *(("line", i) for i in range(290, 300))]
    [hit] = C.secret_findings(C.fragments(files, unit="chunk"), [C.Rule("key", regex)]).collect()
    assert hit.start_line == 155 and hit.secret == "\n".join(lines[154:205])


@pytest.mark.parametrize("text, bits", [("", 0.0), ("aaaa", 0.0), ("abab", 1.0), ("abcd", 2.0)])
def test_entropy(spark, text, bits):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.finding_entropy(F.col("t"))).first()[0] == pytest.approx(bits)


def _write(spark, folder, rows):
    spark.createDataFrame(rows, "k string, v int, w int, seq long").coalesce(1).write.mode("append").json(str(folder))


def _stream(spark, folder):
    return spark.readStream.schema("k string, v int, w int, seq long").json(str(folder))


def test_dedup_survives_a_restart(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    _write(spark, src, [("a", 1, 1, 1), ("a", 2, 1, 2), ("b", 1, 1, 3)])
    Q.stream_dedup(_stream(spark, src), "k", out, cp).awaitTermination()
    _write(spark, src, [("b", 9, 1, 4), ("c", 1, 1, 5)])
    Q.stream_dedup(_stream(spark, src), "k", out, cp).awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_histogram_is_kept_current(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([("a", 1, 1, 1), (" ", 2, 1, 2)], [("a", 9, 1, 4), (None, 1, 1, 5)]):
        _write(spark, src, rows)
        Q.stream_histogram(_stream(spark, src), "k", out, cp).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 2), ("unknown", 2)]


def test_upserts_over_batches(spark, tmp_path):
    src, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([("a", 1, 7, 9), ("b", 1, 1, 2)], [("a", 5, None, 1)]):
        _write(spark, src, rows)
        Q.stream_upsert(_stream(spark, src), out, "k", "seq", cp).awaitTermination()
    last = Q.read_upserted(spark, out, "k", "seq").select("k", "v", "w")
    assert sorted(map(tuple, last.collect())) == [("a", 5, None), ("b", 1, 1)]
    known = Q.read_upserted(spark, out, "k", "seq", "coalesce").select("k", "v", "w")
    assert sorted(map(tuple, known.collect())) == [("a", 5, 7), ("b", 1, 1)]
    base = spark.createDataFrame([("b", 0, 0), ("z", 3, 3)], "k string, v int, w int")
    folded = Q.compact(base, spark, out, "k", "seq", "coalesce").select("k", "v", "w")
    assert sorted(map(tuple, folded.collect())) == [("a", 5, 7), ("b", 1, 1), ("z", 3, 3)]


def test_stored_dedup_equals_batch_distinct_over_restarts_and_replays(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    batches = [[("a", 2), ("a", 1), (None, 1), ("b", 1)], [("b", 9), ("c", 3), (None, 0)], [("a", 0), ("c", 1)], [("d", 5)]]
    for rows in batches:
        _write(spark, src, [(k, 0, 0, seq) for k, seq in rows])
        Q.stream_dedup_stored(_stream(spark, src), "k", out, cp).awaitTermination()
        Q.stream_dedup_stored(_stream(spark, src), "k", out, cp).awaitTermination()
    expected = [("a", 1), ("b", 1), ("c", 3), ("d", 5), (None, 1)]

    def found():
        return sorted(((r.k, r.seq) for r in Q.read_stored(spark, out).collect()), key=str)

    assert found() == sorted(expected, key=str)
    # A batch that died half way, and one that is run again.
    again = spark.createDataFrame([("d", 0, 0, 5), ("a", 0, 0, 0)], "k string, v int, w int, seq long")
    (tmp_path / "out" / "batch=3" / "_SUCCESS").unlink()
    Q.admit_new(again, 3, "k", out)
    Q.admit_new(again, 3, "k", out)
    assert found() == sorted(expected, key=str)
    assert spark.read.parquet(f"{out}/batch=2").count() == 0
