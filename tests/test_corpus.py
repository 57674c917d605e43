"""Selection steps over in-memory documents, against rules restated in plain Python."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from corploom import Corpus, Document, read
from corploom.errors import ConfigurationError, IncompletePassError, StreamConsumedError, UnreachableMixError
from corploom.functions import hashing, near

pytestmark = pytest.mark.usefixtures("spark")


def texts(corpus):
    return list(corpus.texts())


def corpus_of(items, name="toy"):
    return Corpus(read(items, name=name))


def test_documents_carry_exact_text_and_identities():
    d = Document("a\r\nb", "src", 12)
    assert d.id == hashing.hex128(b"3:src:12") and d.content_hash == hashing.hex128(b"a\r\nb")
    assert Document("x", "a1", 2).id != Document("x", "a", 12).id
    for wrong in ({"position": -1}, {"position": True}, {"source": ""}, {"lang": ""}, {"text": None}, {"metadata": 3}):
        with pytest.raises(Exception, match="must be"):
            Document(**({"text": "x", "source": "s", "position": 0} | wrong))


def test_filter_drops_blank_and_short_and_asks_the_function_last():
    items = ["hello world", "", " 　\x1c\t", "hi", "long enough text", "é" * 5]
    assert texts(corpus_of(items).filter(min_chars=5)) == ["hello world", "long enough text", "ééééé"]
    assert texts(corpus_of(items).filter(lambda d: "o" in d.text)) == ["hello world", "long enough text"]
    assert texts(corpus_of(items).filter(F.col("text").contains("o"), min_chars=12)) == ["long enough text"]
    kept = corpus_of(items).filter(lambda d: True)
    assert not kept.history[-1].reproducible and "lambda" in kept.history[-1].params["fn"]
    with pytest.raises(ConfigurationError):
        corpus_of(items).filter(min_chars=-1)


def test_exact_dedup_keeps_first_occurrences_over_sources():
    rng = random.Random(3)
    a, b = ([rng.choice("abcde") * 3 for _ in range(30)] for _ in range(2))
    corpus = Corpus(read([read(a, name="a"), read(b, name="b")])).dedup()
    assert texts(corpus) == list(dict.fromkeys(a + b))
    stats = corpus.stats()
    assert [s.docs_in for s in stats.steps] == [60, 60] and stats.steps[1].docs_out == len(set(a + b))
    assert texts(Corpus(read([read(a, name="a"), read(b, name="b")])).dedup(on_disk=True)) == texts(corpus)


def greedy(all_texts, threshold):
    seen, kept = set(), []
    for t in all_texts:
        keys = near.keys_of(t, *near.bands_for(threshold))
        if not seen & set(keys):
            seen |= set(keys)
            kept.append(t)
    return kept


def test_near_dedup_is_the_greedy_scan():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(12)]
    items = []
    for _ in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            t[rng.randrange(60)] = rng.choice(words)
        items.append(" ".join(t))
    items += ["One two", "one  TWO", "one three", "", " "]
    for threshold in (0.6, 0.75, 0.9):
        assert texts(corpus_of(items).dedup(near=True, threshold=threshold)) == greedy(items, threshold)


def test_near_dedup_keeps_a_document_that_only_matches_a_dropped_one():
    # b matches a and c, c does not match a: the greedy scan keeps c, components would not.
    rng = random.Random(11)
    found = None
    while found is None:
        a = [f"x{rng.randrange(500)}" for _ in range(60)]
        b, c = list(a), None
        for k in rng.sample(range(60), 2):
            b[k] = f"y{rng.randrange(500)}"
        c = list(b)
        for k in rng.sample(range(60), 3):
            c[k] = f"z{rng.randrange(500)}"
        trio = [" ".join(x) for x in (a, b, c)]
        ka, kb, kc = (set(near.keys_of(t, 14, 8)) for t in trio)
        if ka & kb and kb & kc and not ka & kc:
            found = trio
    assert texts(corpus_of(found).dedup(near=True)) == [found[0], found[2]]


def test_banding_follows_the_threshold():
    table = {0.5: (28, 4), 0.6: (22, 5), 0.7: (16, 7), 0.75: (14, 8), 0.8: (12, 9), 0.85: (9, 12), 0.9: (7, 16), 0.95: (4, 23)}
    assert {t: near.bands_for(t) for t in table} == table


def test_against_removes_matches_first_and_counts_them():
    train, held = ["a", "b", "a", "c"], ["a", "z"]
    corpus = corpus_of(train).dedup(against=corpus_of(held, "held"))
    assert texts(corpus) == ["b", "c"]
    corpus.stats()
    assert corpus.provenance().steps[1].selection == {"removed_against": 2}
    near_one = corpus_of(["One Two", "three"]).dedup(near=True, against=corpus_of(["one  two"], "held"))
    assert texts(near_one) == ["three"]


def test_selection_values_depend_on_seed_step_and_id():
    items = [f"t{k}" for k in range(400)]
    first = corpus_of(items).sample(0.5, seed=1)
    expected = [t for k, t in enumerate(items) if hashing.unit(f"1:1:{hashing.location_hash('toy', k)}") < 0.5]
    assert texts(first) == expected and 150 < len(expected) < 250
    assert texts(first.sample(0.5, seed=1)) == [t for k, t in enumerate(items) if t in expected and hashing.unit(f"1:2:{hashing.location_hash('toy', k)}") < 0.5]
    assert texts(corpus_of(items).sample(0)) == [] and texts(corpus_of(items).sample(1)) == items
    for wrong in ({}, {"fraction": 0.5, "max_bytes": 3}, {"fraction": 1.5}, {"max_bytes": -1}):
        with pytest.raises(ConfigurationError):
            corpus_of(items).sample(**wrong)


def test_byte_budget_resolves_to_a_fraction():
    corpus = corpus_of(["x" * 10] * 100).sample(max_bytes=500)
    corpus.stats()
    record = corpus.provenance().steps[1].to_dict()
    assert record["fraction"] == 0.5 and record["target_bytes"] == 500 and record["achieved_bytes"] == record["bytes_out"]
    assert texts(corpus_of([]).sample(max_bytes=5)) == []


def two_languages():
    rows = [{"text": "a" * 10, "lang": "a"}] * 300 + [{"text": "b" * 10, "lang": "b"}] * 100 + [{"text": "u"}]
    return Corpus(read(rows, name="langs", lang_field="lang"))


def test_mix_shares_fractions_and_counts():
    corpus = two_languages().mix({"a": 1, "b": 1}, seed=2)
    stats = corpus.stats()
    record = corpus.provenance().steps[1].to_dict()
    assert record["target_shares"] == {"a": 0.5, "b": 0.5} and record["keep_fractions"] == {"a": pytest.approx(1 / 3), "b": 1.0}
    assert record["dropped"] == {"und": 1} and stats.by_lang["b"].documents == 100 and 70 < stats.by_lang["a"].documents < 130
    half = two_languages().mix(alpha=1.0, max_bytes=2000)
    half.stats()
    assert half.provenance().steps[1].to_dict()["keep_fractions"] == {"a": pytest.approx(0.5), "b": pytest.approx(0.5)}
    only = two_languages().mix({"b": 3})
    assert set(texts(only)) == {"b" * 10}
    with pytest.raises(UnreachableMixError, match="xx"):
        two_languages().mix({"xx": 1}).stats()
    with pytest.raises(UnreachableMixError):
        corpus_of(["no language"]).mix(alpha=0.3).stats()
    assert corpus_of([]).mix(alpha=0.3).stats().documents == 0
    for wrong in ({}, {"weights": {}}, {"weights": {"a": 0}}, {"alpha": 0}, {"alpha": 0.3, "weights": {"a": 1}}, {"alpha": 1, "max_bytes": -1}):
        with pytest.raises(ConfigurationError):
            two_languages().mix(**wrong)


def test_split_partitions_by_key_and_guards_later_steps():
    items = [f"text {k % 150}" for k in range(200)]
    train, held = corpus_of(items).split(validation=0.2, seed=4)
    t, h = texts(train), texts(held)
    assert sorted(t + h) == sorted(items) and not set(t) & set(h)
    assert set(h) == {x for x in items if hashing.unit(f"split:4:{hashing.text_hash(x)}") < 0.2}
    with pytest.raises(ConfigurationError, match="seed=4"):
        train.split(validation=0.1, seed=4)
    train.dedup()
    with pytest.raises(ConfigurationError, match="against"):
        train.dedup(near=True)
    train.dedup(near=True, against=held)
    held.dedup(near=True)
    by_source, _ = corpus_of(items).split(validation=0.5, by="source")
    with pytest.raises(ConfigurationError):
        by_source.dedup()
    odd, even = corpus_of(items).split(validation=0.5, by=lambda d: d.text[-1])
    assert len({x[-1] for x in texts(odd)} & {x[-1] for x in texts(even)}) == 0 and not odd.history[-1].reproducible
    for wrong in ({"validation": 0}, {"validation": 1}, {"validation": 0.5, "by": "id"}):
        with pytest.raises(ConfigurationError):
            corpus_of(items).split(**wrong)


def test_passes_are_lazy_and_results_need_a_complete_one():
    corpus = corpus_of(["a", "b"]).filter()
    with pytest.raises(IncompletePassError):
        corpus.provenance()
    next(iter(corpus))
    with pytest.raises(IncompletePassError):
        corpus.provenance()
    list(corpus)
    assert corpus.provenance().step_counts[1].docs_out == 2
    with pytest.raises(ConfigurationError):
        corpus.dedup(threshold=0.9)
    with pytest.raises(ConfigurationError):
        corpus.dedup(near=True, threshold=1.0)


def test_iterators_are_read_once():
    corpus = Corpus(read(iter(["a", "b"]), name="once"))
    assert texts(corpus) == ["a", "b"]
    with pytest.raises(StreamConsumedError):
        texts(corpus)
    with pytest.raises(StreamConsumedError):
        Corpus(read(iter([{"text": "a", "lang": "x"}]), name="once", lang_field="lang")).mix(alpha=1).stats()
    fresh = Corpus(read(lambda: iter(["a"]), name="fresh"))
    assert texts(fresh) == texts(fresh) == ["a"]


def test_warnings_come_once_a_pass_with_its_prepass():
    rows = [{"text": "a", "lang": "x"}, {"text": 5}]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        Corpus(read(rows, name="w", lang_field="lang")).mix(alpha=1).stats()
    ours = [w for w in caught if "skipped" in str(w.message)]
    assert [str(w.message) for w in ours] == ["w: skipped 1 row(s); first: w#1: field 'text' is int, expected str"]
    assert ours[0].filename == __file__
