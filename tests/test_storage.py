"""Saving, loading, verifying; statistics and how they print."""

import json
import shutil
import warnings

import pyarrow.parquet as pq
import pytest

from corploom import Corpus, CorpusStats, Document, read
from corploom.errors import (
    CorpusExistsError,
    IntegrityError,
    ManifestError,
    MetadataNotSerializableError,
    UnsafeDestinationError,
    UnsupportedManifestVersionError,
)
from corploom.functions import hashing
from corploom.plans import display, storage
from corploom.plans.stats import Counts, fingerprint

pytestmark = pytest.mark.usefixtures("spark")


def corpus_of(items, name="toy"):
    return Corpus(read(items, name=name))


def saved(tmp_path, items=("a", "b", "a", "é"), **options):
    at = tmp_path / "v1"
    corpus_of(list(items)).dedup().save(at, **options)
    return at


def test_round_trip_keeps_order_metadata_and_fingerprint(tmp_path):
    docs = [Document(f"t{k % 7}", "s/" + "xy"[k % 2], k, None if k % 3 else "l", {"b": [k], "a": {"z": None}}) for k in range(50)]
    corpus = corpus_of(docs)
    stats = corpus.save(tmp_path / "out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["corpus.parquet", "manifest.json"] and list(tmp_path.iterdir()) == [tmp_path / "out"]
    assert stats.fingerprint == fingerprint(hashing.text_hash(d.text) for d in docs)
    loaded = Corpus.load(tmp_path / "out")
    assert list(loaded) == docs and loaded.stats().fingerprint == stats.fingerprint
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["format_version"] == 1 and manifest["history"][0]["op"] == "read" and not manifest["reproducible"]
    assert manifest["stats"] == json.loads(json.dumps(stats.to_dict())) and manifest["files"]["corpus.parquet"]["rows"] == 50
    assert CorpusStats.from_dict(manifest["stats"]) == stats


def test_steps_continue_over_saves_and_history_chains(tmp_path):
    items = [f"t{k}" for k in range(300)]
    corpus_of(items).sample(0.5, seed=1).save(tmp_path / "half")
    again = Corpus.load(tmp_path / "half").sample(0.5, seed=1)
    stats = again.save(tmp_path / "quarter")
    assert 45 < stats.documents < 105
    manifest = json.loads((tmp_path / "quarter" / "manifest.json").read_text())
    assert [h["op"] for h in manifest["history"]] == ["load", "sample"] and [h["op"] for h in manifest["parent"]["history"]] == ["read", "sample"]
    train, _ = corpus_of(items).split(validation=0.5, seed=9)
    train.save(tmp_path / "train")
    with pytest.raises(Exception, match="seed=9"):
        Corpus.load(tmp_path / "train").split(validation=0.5, seed=9)
    with pytest.raises(Exception, match="against"):
        Corpus.load(tmp_path / "train").dedup(near=True)


def test_destinations_are_protected(tmp_path):
    at = saved(tmp_path)
    with pytest.raises(CorpusExistsError):
        saved(tmp_path)
    assert saved(tmp_path, ["new"], overwrite=True) == at and [d.text for d in Corpus.load(at)] == ["new"]
    (at / "mine.txt").write_text("keep")
    with pytest.raises(UnsafeDestinationError):
        saved(tmp_path, overwrite=True)
    (at / "mine.txt").unlink()
    with pytest.raises(UnsafeDestinationError, match="being read"):
        Corpus.load(at).save(at, overwrite=True)
    with pytest.raises(UnsafeDestinationError):
        Corpus.load(at).save(at / "below")
    with pytest.raises(UnsafeDestinationError):
        Corpus.load(at).save(tmp_path, overwrite=True)


def test_a_failed_save_leaves_the_old_corpus_and_nothing_else(tmp_path, monkeypatch):
    at = saved(tmp_path)
    bad = corpus_of([{"text": "x", "when": {1, 2}}])
    stream = read([{"text": "x", "when": {1, 2}}], name="bad", metadata_fields="all")
    with pytest.raises(MetadataNotSerializableError, match="bad#0"):
        Corpus(stream).save(at, overwrite=True)
    bad.save(tmp_path / "fine")
    shutil.rmtree(tmp_path / "fine")
    monkeypatch.setattr(storage, "ordered_fingerprint", None)
    monkeypatch.setattr("corploom.plans.corpus.ordered_fingerprint", lambda rows: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        corpus_of(["y"]).save(at, overwrite=True)
    monkeypatch.undo()
    assert [d.text for d in Corpus.load(at)] == ["a", "b", "é"] and list(tmp_path.iterdir()) == [at]


def test_a_leftover_of_the_old_copy_is_warned_about(tmp_path, monkeypatch):
    saved(tmp_path)
    real = shutil.rmtree

    def stuck(path, ignore_errors=False):
        if ".old." in str(path) and not ignore_errors:
            raise OSError("busy")
        real(path, ignore_errors=ignore_errors)

    monkeypatch.setattr(storage.shutil, "rmtree", stuck)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        saved(tmp_path, ["n"], overwrite=True)
    assert any("busy" in str(w.message) for w in caught)


def edit(at, change):
    part = next((at / "corpus.parquet").glob("*.parquet"))
    table = pq.read_table(part).to_pylist()
    change(table)
    import pyarrow as pa

    pq.write_table(pa.Table.from_pylist(table, pq.read_schema(part)), part)
    for crc in (at / "corpus.parquet").glob(".*.crc"):
        crc.unlink()


def test_tampering_is_found(tmp_path):
    at = saved(tmp_path)
    edit(at, lambda rows: rows[0].update(text="changed"))
    with pytest.raises(IntegrityError, match="toy#0"):
        list(Corpus.load(at))
    assert [d.text for d in Corpus.load(at, verify=False)][0] == "changed"
    other = saved(tmp_path / "o")
    edit(other, lambda rows: rows.pop())
    with pytest.raises(IntegrityError, match="fingerprint"):
        Corpus.load(other).stats()


def test_manifests_are_checked_when_loading(tmp_path):
    at = saved(tmp_path)
    path = at / "manifest.json"
    good = json.loads(path.read_text())
    for text, error in (("{", ManifestError), ("[]", ManifestError), (json.dumps(good | {"format_version": 2}), UnsupportedManifestVersionError),
                        (json.dumps({k: v for k, v in good.items() if k != "stats"}), ManifestError)):
        path.write_text(text)
        with pytest.raises(error):
            Corpus.load(at)
    path.write_text(json.dumps(good | {"format_version": "1.7"}))
    Corpus.load(at)
    path.unlink()
    with pytest.raises(ManifestError, match="no manifest"):
        Corpus.load(at)


def test_a_corpus_file_of_one_piece_loads_too(tmp_path):
    at = saved(tmp_path)
    table = pq.read_table(at / "corpus.parquet")
    shutil.rmtree(at / "corpus.parquet")
    pq.write_table(table, at / "corpus.parquet")
    assert [d.text for d in Corpus.load(at)] == ["a", "b", "é"]


def test_bad_rows_are_counted_in_full_and_listed_in_part(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.jsonl").write_text("no\n" * 1000 + '{"text": "ok"}\n')
    Corpus(read(tmp_path / "in", on_error="skip")).save(tmp_path / "out")
    reader = json.loads((tmp_path / "out" / "manifest.json").read_text())["reader"]
    assert reader["errors_by_level"] == {"row": 1000} and reader["errors_by_source"] == {"x.jsonl": 1000} and len(reader["first_errors"]) == 100


def test_counts_of_characters_bytes_languages_and_sources():
    docs = [Document("ab", "te/news/a", 0, "te"), Document("త", "te/blogs/b", 0, "te"), Document("hello", "en", 0)]
    stats = corpus_of(docs).stats()
    assert (stats.documents, stats.chars, stats.bytes, stats.length_min, stats.length_max) == (3, 8, 10, 1, 5) and stats.length_mean == pytest.approx(8 / 3)
    assert stats.by_lang == {"te": Counts(2, 5), "und": Counts(1, 5)} and stats.by_source == {"te": Counts(2, 5), "en": Counts(1, 5)}
    nothing = corpus_of([]).stats()
    assert nothing.fingerprint == "cae66941d9efbd404e4d88758ea67670" and nothing.length_mean is None and nothing.by_lang == {}
    assert corpus_of(["x", "y"]).stats().fingerprint != corpus_of(["y", "x"]).stats().fingerprint


def test_printing():
    assert [display.human_bytes(n) for n in (730, 4_700, 999_949, 999_950, 5_200_000_000, 10**18)] == ["730 B", "4.7 kB", "999.9 kB", "1.0 MB", "5.2 GB", "1000.0 PB"]
    stats = corpus_of([Document("x" * (k + 1), f"<s{k:02}>", 0) for k in range(23)]).filter().stats()
    text = str(stats)
    assert text.startswith("CorpusStats: 23 documents, 276 B\n\nTotals\n") and "  ... and 3 more" in text and text.isascii()
    assert "  filter          23         23   100.0%      276 B       276 B" in text or "filter" in text
    html = stats._repr_html_()
    assert "&lt;s22&gt;" in html and "<s22>" not in html and html.count("<table") == 4
    assert "none" in str(corpus_of([]).stats())


def test_a_saved_file_is_bounded_by_its_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "BYTES_PER_FILE", 2_000)
    texts = [f"{k} " + "x" * 200 for k in range(100)]
    stats = corpus_of(texts).save(tmp_path / "out")
    files = [pq.read_metadata(p).num_rows for p in (tmp_path / "out" / "corpus.parquet").glob("*.parquet")]
    assert len(files) >= 8 and max(files) <= 30 and sum(files) == 100
    assert list(Corpus.load(tmp_path / "out").texts()) == texts and Corpus.load(tmp_path / "out").stats().fingerprint == stats.fingerprint


def test_files_are_loaded_by_their_number():
    names = ["part-100000-x.parquet", "part-99999-x.parquet", "part-00002-x.parquet"]
    assert [p.name for p in sorted(map(storage.Path, names), key=storage._in_order)] == names[::-1]
