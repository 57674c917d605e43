"""Invariants over generated inputs."""

import hashlib
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corploom import Corpus, read
from corploom.functions import hashing, near, text
from corploom.operators.mix import Balance, proportions
from corploom.plans.manifest import whole_history
from corploom.plans.stats import fingerprint

slow = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
texts = st.lists(st.text(alphabet="ab \n\té", max_size=6), max_size=12)


def kept(corpus):
    return list(corpus.texts())


@slow
@given(texts)
def test_dedup_filter_and_sample_select_in_order(spark, items):
    corpus = Corpus(read(items, name="p"))
    assert kept(corpus.dedup()) == list(dict.fromkeys(items))
    assert kept(corpus.filter(min_chars=2)) == [t for t in items if t.strip() and len(t) >= 2]
    half = kept(corpus.sample(0.5, seed=3))
    rest = iter(items)
    assert all(t in rest for t in half) and half == kept(corpus.sample(0.5, seed=3))
    train, held = corpus.split(validation=0.5, seed=1)
    assert not set(kept(train)) & set(kept(held)) and len(kept(train)) + len(kept(held)) == len(items)


@slow
@given(items=texts)
def test_saving_and_loading_change_nothing(spark, tmp_path_factory, items):
    at = tmp_path_factory.mktemp("saved") / "c"
    corpus = Corpus(read(items, name="p"))
    stats = corpus.save(at)
    loaded = Corpus.load(at)
    assert list(loaded) == list(corpus) and loaded.stats().fingerprint == stats.fingerprint == fingerprint(map(hashing.text_hash, items))


@slow
@given(st.lists(st.lists(st.sampled_from("abcD"), min_size=1, max_size=9).map(" ".join), max_size=14))
def test_near_dedup_keeps_the_first_of_every_match(spark, items):
    seen, expected = set(), []
    for t in items:
        keys = near.keys_of(t, *near.bands_for(0.75))
        if seen.isdisjoint(keys):
            seen.update(keys)
            expected.append(t)
    assert kept(Corpus(read(items, name="p")).dedup(near=True)) == expected


@given(st.lists(st.sampled_from(["a", "B", "ß", "İ", "dd", "e"]), min_size=5, max_size=40))
def test_keys_follow_the_published_definition(words):
    own = " ".join(words).casefold().split()
    shingles = {int.from_bytes(hashlib.blake2b(" ".join(own[k : k + 5]).encode(), digest_size=8).digest(), "big") for k in range(len(own) - 4)}
    bins = {}
    for s in shingles:
        bins[s % 112] = min(bins.get(s % 112, 1 << 64), s // 112)

    def probe(k, n):
        x = (k * 0x9E3779B97F4A7C15 + n * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64
        x = ((x ^ (x >> 31)) * 0xD6E8FEB86659FD93) % 2**64
        return (x ^ (x >> 32)) % 112

    values = []
    for k in range(112):
        n, at = 0, k
        while at not in bins:
            n += 1
            at = probe(k, n)
        values.append(bins[at])
    assert near.minima(own) == values
    keys = near.keys_of(" ".join(words), 14, 8)
    assert keys[3] == hashlib.blake2b(struct.pack("<B8Q", 3, *values[24:32]), digest_size=16).digest() and len(keys) == 14


def test_white_space_is_what_python_calls_so(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, t string")
    assert {r.c for r in df.where(~text.has_text(F.col("t"))).collect()} == {c for c in points if chr(c).isspace()}


def test_source_groups_agree(spark):
    names = ["te/news/a.jsonl", "plain", "hf:org/data/default:train", "hf:x", "a/", "/a", "hf:o/d/c:s\nx"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", text.source_group(F.col("s")).alias("g")).collect()
    assert {r.s: r.g for r in got} == {n: text.source_group_of(n) for n in names}


@given(st.dictionaries(st.sampled_from("abcd"), st.integers(1, 10**9), min_size=1))
def test_mixing_arithmetic(available):
    shares = proportions({k: v**0.3 for k, v in available.items()})
    keep = Balance(available).kept(shares, None)
    assert sum(shares.values()) == pytest.approx(1) and all(0 < f <= 1 for f in keep.values()) and max(keep.values()) == pytest.approx(1)
    out = proportions({k: available[k] * keep[k] for k in available})
    assert all(out[k] == pytest.approx(shares[k]) for k in shares)
    assert proportions({"a": 0}) == {"a": 0.0} and Balance({}).kept({}, 5) == {}


def test_near_duplicates_are_found_as_often_as_promised():
    import random

    rng = random.Random(9)
    words = [f"w{k}" for k in range(2000)]

    def rate(changed, threshold=0.75):
        hits = 0
        for _ in range(60):
            t = [rng.choice(words) for _ in range(400)]
            u = [rng.choice(words) if rng.random() < changed else w for w in t]
            hits += not set(near.keys_of(" ".join(t), *near.bands_for(threshold))).isdisjoint(near.keys_of(" ".join(u), *near.bands_for(threshold)))
        return hits / 60

    assert rate(0.01) >= 0.95 and rate(0.08) <= 0.2 and rate(0.02, 0.6) > rate(0.02, 0.9)


def test_histories_chain():
    assert whole_history([3], {"history": [2], "parent": {"history": [1], "parent": None}}) == [1, 2, 3]
