"""Sources: order, names, positions, bad rows and files, on temporary directories."""

import gzip
import json
import warnings

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corploom import Corpus, Document, chain, from_table, queries_io, read
from corploom.errors import (
    ConfigurationError,
    DuplicateSourceError,
    MissingTextFieldError,
    ReadError,
    RevisionResolutionError,
    SourceNotFoundError,
    UnsupportedFormatError,
)
from corploom.sources import stream as stream_module
from corploom.sources.formats import default_formats
from corploom.sources.reader import Reader

pytestmark = pytest.mark.usefixtures("spark")


def quiet(stream):
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        docs = list(stream)
    return docs, [str(w.message) for w in caught if issubclass(w.category, UserWarning)]


def brief(docs):
    return [(d.source, d.position, d.text) for d in docs]


def test_a_mixed_directory_reads_in_code_point_order(tmp_path):
    (tmp_path / "B.txt").write_bytes("﻿one\r\n\ntwo\rstill two\n".encode())
    (tmp_path / "a.txt").write_bytes(b"")
    (tmp_path / "_c.csv").write_text('text,k\n"x, ""y""",1\n\nz\n', encoding="utf-8")
    with gzip.open(tmp_path / "d.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write('{"text": "é", "lang": "fr"}\n\nnot json\n{"text": 5}\n{"text": "", "lang": ""}\n[1]\n{"lang": "x"}\n')
    (tmp_path / "notes.md").write_text("skip me")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.txt").write_text("no")
    stream = read(tmp_path, name="n", unit="line", lang="en", lang_field="lang", metadata_fields="all")
    docs, said = quiet(stream)
    assert brief(docs) == [
        ("n/B.txt", 0, "one"), ("n/B.txt", 1, ""), ("n/B.txt", 2, "two\rstill two"), ("n/_c.csv", 0, 'x, "y"'), ("n/_c.csv", 1, "z"), ("n/d.jsonl.gz", 0, "é"), ("n/d.jsonl.gz", 4, ""),
    ]
    assert [d.lang for d in docs] == ["en"] * 5 + ["fr", "en"]
    assert [dict(d.metadata) for d in docs[3:6]] == [{"k": "1"}, {"k": None}, {"lang": "fr"}]
    assert [str(e) for e in stream.errors] == [
        "n/d.jsonl.gz#2: invalid JSON: Expecting value", "n/d.jsonl.gz#3: field 'text' is int, expected str",
        "n/d.jsonl.gz#5: expected an object/row, got list", "n/d.jsonl.gz#6: missing or null field 'text'",
    ]
    assert stream.skipped == ["n/notes.md"] and any("skipped 1 file(s) with unsupported extensions (.md)" in s for s in said)
    assert any("skipped 4 row(s); first: n/d.jsonl.gz#2" in s for s in said)
    whole, _ = quiet(read(tmp_path, format="text", glob="*.txt"))
    assert brief(whole) == [("B.txt", 0, "one\r\n\ntwo\rstill two\n"), ("a.txt", 0, "")]


def test_bad_files_keep_their_good_prefix(tmp_path):
    (tmp_path / "a.txt").write_text("good")
    (tmp_path / "b.jsonl.gz").write_bytes(b"not gzip")
    packed = gzip.compress("".join(json.dumps({"text": f"{k} " + "x" * 50}) + "\n" for k in range(5000)).encode())
    (tmp_path / "c.jsonl.gz").write_bytes(packed[: len(packed) - 20])
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "e.jsonl").write_text('{"body": "x"}\n{"text": "late"}\n')
    (tmp_path / "f.parquet").write_bytes(b"PAR1 no")
    stream = read(tmp_path)
    docs, said = quiet(stream)
    assert docs[0].text == "good" and [d.position for d in docs[1:4]] == [0, 1, 2] and {d.source for d in docs} == {"a.txt", "c.jsonl.gz"}
    assert [(e.source, e.level) for e in stream.errors] == [(f, "file") for f in ("b.jsonl.gz", "c.jsonl.gz", "d.txt", "e.jsonl", "f.parquet")]
    assert "BadGzipFile" in str(stream.errors[0]) and "UnicodeDecodeError" in str(stream.errors[2]) and len(said) == 5
    assert isinstance(stream.errors[3], MissingTextFieldError)
    assert "available fields: body; set text_field=" in str(stream.errors[3]) and "format='text'" in str(stream.errors[3])
    with pytest.raises(ReadError, match="b.jsonl.gz"):
        list(read(tmp_path, on_error="raise"))
    silent = read(tmp_path, on_error="skip")
    assert quiet(silent)[1] == [] and len(silent.errors) == 5


def test_parquet_is_pruned_and_checked_by_schema(tmp_path):
    table = pa.table({"text": ["a", None, "c"], "k": pa.array([1, 2, 3], pa.int64()), "lang": ["te", "", None], "big": ["x"] * 3})
    pq.write_table(table, tmp_path / "p.parquet", row_group_size=2)
    stream = read(tmp_path / "p.parquet", metadata_fields=["k", "absent", "text"], lang_field="lang", lang="en", on_error="skip")
    docs = list(stream)
    assert brief(docs) == [("p.parquet", 0, "a"), ("p.parquet", 2, "c")] and [d.lang for d in docs] == ["te", "en"]
    assert [dict(d.metadata) for d in docs] == [{"k": 1}, {"k": 3}]
    assert [str(e) for e in stream.errors] == ["p.parquet#1: missing or null field 'text'"]
    wrong = read(tmp_path / "p.parquet", text_field="k", on_error="skip")
    assert list(wrong) == [] and [str(e) for e in wrong.errors][0] == "p.parquet#0: field 'k' is int, expected str" and len(wrong.errors) == 3
    missing = read(tmp_path / "p.parquet", text_field="nope", on_error="skip")
    assert list(missing) == [] and "available fields: text, k, lang, big" in str(missing.errors[0])
    pq.write_table(table, tmp_path / "_hidden_from_spark.parquet")
    names = [d.source for d in read(tmp_path, on_error="skip")]
    assert names == ["_hidden_from_spark.parquet"] * 2 + ["p.parquet"] * 2


def test_large_fields_and_delimiters(tmp_path):
    (tmp_path / "big.csv").write_text("text\n" + "x" * 200_000 + "\n")
    (tmp_path / "t.tsv").write_text("text\tn\na,b\t1\textra\n")
    docs = list(read(tmp_path, metadata_fields="all"))
    assert [len(d.text) for d in docs] == [200_000, 3] and dict(docs[1].metadata) == {"n": "1"}
    (tmp_path / "s.csv").write_text("text;n\nq;2\n")
    assert [d.text for d in read(tmp_path / "s.csv", delimiter=";")] == ["q"]


def test_iterables_pass_documents_through_and_report_bad_items():
    own = Document("own", "elsewhere", 7, "xx", {"m": [1, {"b": 2, "a": None}]})
    stream = read([own, "plain", {"text": "row", "lang": 3}, 5, {"text": "ok"}], name="it", lang_field="lang", on_error="skip")
    docs = list(stream)
    assert docs[0] == own and brief(docs[1:]) == [("it", 1, "plain"), ("it", 4, "ok")]
    assert [str(e) for e in stream.errors] == ["it#2: field 'lang' is int, expected str", "it#3: expected an object/row, got int"]
    assert len(list(read((f"t{k}" for k in range(12_000)), name="many"))) == 12_000
    with pytest.raises(ConfigurationError, match="name="):
        read(x for x in "a")


def test_several_sources_chain_and_must_differ_in_name(tmp_path):
    (tmp_path / "a.txt").write_text("file")
    both = read([read(["x"], name="one"), tmp_path / "a.txt", [read(["y"], name="two")]])
    assert brief(both) == [("one", 0, "x"), ("a.txt", 0, "file"), ("two", 0, "y")] and both.source_names() == ["one", "a.txt", "two"]
    with pytest.raises(DuplicateSourceError, match="a.txt"):
        read([tmp_path / "a.txt", str(tmp_path / "a.txt")])
    assert [d.text for d in chain([read(["x"], name="1"), read(["y"], name="2")])] == ["x", "y"]


def test_errors_beyond_the_listed_ones_still_count(tmp_path, monkeypatch):
    monkeypatch.setattr(stream_module, "KEPT_ERRORS", 3)
    for name in ("x", "y"):
        (tmp_path / f"{name}.jsonl.gz").write_bytes(b"not gzip")
    skips = lambda: read([5] * 4, name="many", on_error="skip")
    with pytest.raises(ReadError, match="late#1: expected an object/row, got int"):
        list(chain([skips(), read(["fine", 5, 6], name="late", on_error="raise")]))
    with pytest.raises(ReadError, match="late#1"):
        Corpus(chain([skips(), read(["fine", 5, 6], name="late", on_error="raise")])).stats()
    both = chain([skips(), read(tmp_path), read(["ok", 7], name="rows")])
    docs, said = quiet(both)
    assert [d.text for d in docs] == ["ok"] and len(both.errors) == 3 and both.error_rows.count() == 7
    assert [s.split(":")[0] for s in said] == ["x.jsonl.gz", "y.jsonl.gz", "rows"] and "first: rows#1: expected" in said[2]


def test_settings_fail_before_anything_is_read(tmp_path):
    for wrong in ({"unit": "page"}, {"on_error": "ignore"}, {"text_field": ""}, {"lang": ""}, {"metadata_fields": "src"}, {"format": "xml"}, {"nonsense": 1}):
        with pytest.raises(ConfigurationError):
            read(["a"], name="x", **wrong)
    with pytest.raises(SourceNotFoundError):
        read(tmp_path / "absent")
    (tmp_path / "x.bin").write_text("raw")
    with pytest.raises(UnsupportedFormatError):
        read(tmp_path / "x.bin")
    assert [d.text for d in read(tmp_path / "x.bin", format="text")] == ["raw"]
    with pytest.raises(ConfigurationError, match="type int"):
        read(5, name="n")


class FakeHub:
    def __init__(self, online=True):
        self.online = online

    def resolve_revision(self, dataset, revision):
        if not self.online:
            raise RevisionResolutionError("offline")
        return "abc123"

    def stream_rows(self, request):
        self.request = request
        return [{"text": "h1"}, {"text": "h2"}]


def test_hub_reads_are_pinned_or_marked():
    hub = FakeHub()
    stream = read("hf:org/data", split="test", reader=Reader(hub=hub))
    assert brief(stream) == [("hf:org/data/default:test", 0, "h1"), ("hf:org/data/default:test", 1, "h2")]
    assert hub.request.revision == "abc123" and stream.info == {"hf:org/data/default:test": {"revision": "abc123", "pinned": True}} and stream.reproducible
    offline = read("hf:org/data", revision="v1", on_error="skip", reader=Reader(hub=FakeHub(online=False)))
    _, said = quiet(offline)
    assert "Could not pin org/data" in said[0] and not offline.reproducible
    assert Corpus(stream).stats().by_source["hf:org/data"].documents == 2


def test_own_formats_can_be_registered(tmp_path):
    def shout(path, source):
        yield source.document(path.read_text().upper(), 0)

    formats = default_formats()
    formats.register("shout", [".sh.txt"], shout)
    (tmp_path / "a.sh.txt").write_text("hey")
    (tmp_path / "b.txt").write_text("hey")
    assert [d.text for d in read(tmp_path, reader=Reader(formats=formats))] == ["HEY", "hey"]


def test_tables_are_sources_too(spark):
    df = spark.createDataFrame([(2, "b", "x"), (0, "a", None), (1, None, "y")], "n long, body string, l string")
    stream = from_table(df, name="t", text="body", position="n", lang="l")
    docs, _ = quiet(stream)
    assert [(d.position, d.text, d.lang) for d in docs] == [(0, "a", None), (2, "b", "x")] and len(stream.errors) == 1
    with pytest.raises(ConfigurationError):
        from_table(df, text="body")


def test_many_small_files_share_tasks_and_large_ones_do_not(spark, tmp_path, monkeypatch):
    for k in range(400):
        (tmp_path / f"{k:03}.txt").write_text(f"text {k}")
    (tmp_path / "200.txt").write_bytes(b"\xff")
    stream = read(tmp_path, on_error="skip")
    frame, _ = stream.frame(spark, 0, stream_module.PassReport())
    assert frame.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert brief(stream) == [(f"{k:03}.txt", 0, f"text {k}") for k in range(400) if k != 200] and [e.source for e in stream.errors] == ["200.txt"]
    monkeypatch.setattr("corploom.sources.reader._FILE_BYTES", 8)
    assert read(tmp_path, on_error="skip").frame(spark, 0, stream_module.PassReport())[0].rdd.getNumPartitions() == 400


def test_one_file_a_document_takes_few_tasks(spark, tmp_path):
    rows = [(k, "é" * (k % 7), "de" if k % 4 else "en") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.sparkContext.setJobGroup("raw", "raw")
    got = [r.bytes for r in queries_io.read_raw_text_of_any_format(spark, str(tmp_path)).collect()]
    status = spark.sparkContext.statusTracker()
    stages = [s for j in status.getJobIdsForGroup("raw") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext._jsc.clearJobGroup()
    assert sorted(got) == sorted(2 * (k % 7) + 1 for k in range(300) if k % 4)
    assert max(info.numTasks for s in stages if (info := status.getStageInfo(s))) <= 8 * spark.sparkContext.defaultParallelism
