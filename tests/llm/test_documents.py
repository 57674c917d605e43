"""Operators on `documents`, each against a brute-force version over the same odd rows."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import noise, twins, words_of
from pyspark.sql import functions as F

from corploom.llm import blocks, language, minhash, mixing, packing, quality, sharding, substring


# kernels


def test_span_hashes_agree_over_any_cut():
    raw = np.frombuffer(("ab " * 900_000 + "x" * 3_000_000 + " ab").encode(), np.uint8)
    words = blocks.split_words(raw, np.array([0, len(raw)]))
    h = words.hashes()
    assert len(h) == 900_002 and len(set(h.tolist())) == 2 and h[0] == h[-1]
    assert not blocks.Chunks.of(raw, words.starts[[0, 1]], words.ends[[0, 1]]).differ(np.array([0]), np.array([0])).any()
    alone = np.frombuffer(b"x" * 3_000_000, np.uint8)
    assert blocks.span_hashes(alone, np.array([0]), np.array([len(alone)]))[0] == h[-2]


@pytest.mark.parametrize("n", [64, 1024, 1 << 15])
def test_arrangements_of_bytes_do_not_collide(n):
    raw = np.frombuffer(" ".join([*twins("ab", n), *twins("ab", n)[::-1]]).encode(), np.uint8)
    words = blocks.split_words(raw, np.array([0, len(raw)]))
    for which in (0, 1):
        h = words.hashes(which).tolist()
        assert h[0] == h[3] != h[1] == h[2]
    assert words.chunks.differ(np.array([0, 0, 1]), np.array([1, 3, 2])).tolist() == [True, False, False]


def test_rolled_windows_are_equal_where_words_are():
    rng = random.Random(2)
    texts = [noise(rng, rng.randrange(60), 4) for _ in range(50)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    words = blocks.split_words(data, offsets)
    rolling, flat = blocks.Rolling(words.hashes(), words.rows), [w for t in texts for w in words_of(t)]
    for size in (1, 2, 3, 5, 13):
        starts, keys = rolling.windows(size)
        assert len(starts) == sum(max(0, len(words_of(t)) - size + 1) for t in texts)
        grams = [tuple(flat[s : s + size]) for s in starts.tolist()]
        assert len(set(zip(grams, keys.tolist()))) == len(set(grams)) == len(set(keys.tolist()))


# quality


def brute_quality(text, limits):
    text = text or ""
    w = words_of(text)
    chars = sum(map(len, w))

    def covered(n):
        grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return {i + k for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for k in range(n)}

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if words_of(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, words_of(line)))
            seen.add(line)
    repeat = len(covered(3))
    base = len(w) < 50 or 100 * repeat > 50 * len(w)
    bad = 100 * dup_chars > limits.lines * chars or any(100 * sum(len(w[i]) for i in covered(n)) > most * chars for n, most in limits.ngrams.items())
    return len(w), chars, sum(text.count(c) for c in "#*$%&|<>"), dup, repeat, base, not base and not bad


def test_quality_rules(odd_docs, odd_rows, no_docs):
    limits = quality.RepetitionLimits()
    got = Counter(tuple(r)[:8] for r in quality.quality_rules(odd_docs).collect())
    assert got == Counter((i, *brute_quality(t, limits)) for i, t, *_ in odd_rows)
    kept = quality.drop_low_quality(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(brute_quality(r[1], limits)[-1] for r in odd_rows)
    assert quality.quality_rules(no_docs).count() == quality.drop_low_quality(no_docs).count() == 0


def test_the_method_rejects_what_the_base_rule_keeps(spark):
    """One sentence twice among 100 words: 20 percent of the words, far below the base rule."""
    rng = random.Random(3)
    sentence = " ".join(f"sentence{k}" for k in range(10))
    plain = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    line = "\n".join(f"a{k} b{k} c{k}\nrepeatedline{k % 20}" for k in range(40))
    rows = [(1, f"{sentence} {plain} {sentence}"), (2, plain), (3, line), (4, plain.replace(" ", "\n"))]
    limits = quality.RepetitionLimits()
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (got[i].base_failed, got[i].kept) for i in got} == {1: (False, False), 2: (False, True), 3: (False, False), 4: (False, True)}
    assert 100 * got[3].dup_line_chars > 20 * got[3].word_chars and max(got[3].dup_ngram_chars) == 0
    assert all(tuple(got[i])[1:8] == brute_quality(t, limits) for i, t in rows)


# substring


def brute_substring(rows, size):
    first = {}
    big = 1 << 62
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, big + 1), big if i is None else i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = {k + j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < (big if i is None else i) for j in range(size)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return Counter(out)


@pytest.mark.parametrize(("window", "block_bytes"), [(13, 1 << 14), (5, 8 << 20)])
def test_substring_dedup(odd_docs, odd_rows, no_docs, window, block_bytes):
    p = substring.SubstringParameters(window=window, block_bytes=block_bytes)
    out = substring.drop_repeated_passages(odd_docs.drop("n_words"), p, counts=True)
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()) == brute_substring(odd_rows, window)
    whole = substring.drop_repeated_passages(odd_docs, p, length_column="n_chars")
    assert whole.columns == odd_docs.columns and whole.where("n_chars <> length(text)").count() == 0
    assert substring.drop_repeated_passages(no_docs, p).count() == 0


def test_sorted_values_survive_their_code():
    rng = np.random.default_rng(1)
    for kind, top in ((np.uint32, 1 << 24), (np.uint64, (1 << 64) - 1), (np.uint32, 3), (np.uint64, 1)):
        for n in (1, 2, 7, 300, 5000):
            values = np.sort(rng.integers(0, top, n, dtype=np.uint64)).astype(kind)
            code = substring._squeeze(values)
            assert substring._expand(code, kind).tolist() == values.tolist()
            if kind is np.uint32 and top > n > 100:
                assert len(code) * 8 < n * (np.log2(top / n) + 3) + 150
    flags = rng.random(999) < 0.1
    assert substring._read_flags(substring._flags(flags), 999).tolist() == flags.tolist()


def test_blocks_and_ranges_grow_together():
    """Messages of the first pass, at 1 TB, hold enough windows to cost less than a byte for a byte of text."""
    p = substring.SubstringParameters()
    lay = substring._Layout.of(10**12, 8, p)
    windows = 10**12 / p.bytes_per_word
    a_message = windows / lay.blocks / lay.ranges
    bits = np.log2((1 << lay.cell_bits) / a_message) + 3 + 8 * 60 / a_message
    assert a_message > 200 and len(substring._SALTS) * bits / 8 / p.bytes_per_word < 1
    small = substring._Layout.of(10**9, 8, p)
    assert (small.blocks, small.cell_bits) == (-(-(10**9) // p.block_bytes), 24)


def test_a_crowded_sketch_loses_no_window(odd_docs, odd_rows):
    p = substring.SubstringParameters(cells_per_window=1, cell_bits=10, most_cell_bits=10)  # nearly every window is estimated repeated
    out = substring.drop_repeated_passages(odd_docs.select("doc_id", "text"), p, counts=True)
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()) == brute_substring(odd_rows, 13)


# near duplicates


def brute_near(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.setdefault(i, s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = [i for i in sets if i is not None and sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(odd_docs, odd_rows, no_docs, size):
    p = minhash.NearParameters(words=size)
    expected = brute_near(odd_rows, size, 80)
    got = minhash.near_duplicates(odd_docs, p).collect()
    assert len(got) == len(odd_rows)
    assert all((r.n_shingles, r.component_id) == expected[r.doc_id] for r in got if r.doc_id is not None)
    if size == 5:
        kept = minhash.drop_near_duplicates(odd_docs, p)
        ids = [r.doc_id for r in kept.collect()]
        assert kept.columns == odd_docs.columns and sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in expected.items() if i is not None and i == c)
        assert minhash.near_duplicates(no_docs, p).count() == minhash.drop_near_duplicates(no_docs, p).count() == 0


def test_rows_of_one_id_with_other_texts_are_documents_of_their_own(spark):
    rng = random.Random(8)
    a, b, c = (noise(rng, 80, 10**6) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "y"), (2, b + " more", "x"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (3, c, "x"), (None, None, "x"), (None, "", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = Counter((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect())
    assert kept == Counter([(1, a), (1, b), (3, c), (None, None), (None, ""), (4, None)])
    distinct = df.where("doc_id > 1").unionByName(spark.createDataFrame([(9, b, "z")], df.schema))
    for most in (0, 10):
        assert sorted(r.doc_id for r in minhash.drop_near_duplicates(distinct, broadcast_ids=most).collect()) == [2, 3, 4]


def test_links_between_documents_that_are_no_centres(spark, monkeypatch):
    """Chains whose middle alone resembles both ends, in many copies; groups of one bucket are cut into small blocks."""
    monkeypatch.setattr(minhash, "_FAN", 3)
    monkeypatch.setattr(minhash, "_WIDE", 5)
    rng = np.random.default_rng(4)
    rows = []
    for chain in range(12):
        words = [f"c{chain}w{k}" for k in range(120)]
        for step in range(14):
            rows.append((len(rows), " ".join(words)))
            for k in rng.choice(120, 6, replace=False):
                words[k] = f"c{chain}s{step}k{k}"
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    p = minhash.NearParameters(words=2)
    expected = brute_near(rows, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, p).collect()} == expected


# language


def test_language_profiles(spark, odd_docs, no_docs):
    rng = np.random.default_rng(1)
    alphabets = {"ab": "abcdefgh ", "vowels": "aeiouy lmn ", "greek": "αβγδεζηθ "}
    rows = [(n, "".join(rng.choice(list(alphabets[k]), 200)), k) for n, k in enumerate(list(alphabets) * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = language.learn(df.where("doc_id % 3 = 0 or doc_id % 4 = 1"))
    found = language.identify(df.unionByName(spark.createDataFrame([(900, None, None), (901, "12 !", "ab"), (902, "", None)], df.schema)), learnt).collect()
    right = {n: k for n, _, k in rows}
    assert all(r.lang_pred == right.get(r.doc_id, "und") and 0 <= r.score <= 1 for r in found) and [r.score for r in found if r.doc_id >= 900] == [0, 0, 0]
    model = language.learn(odd_docs)
    assert model.languages == ["de", "en", "fr"]
    predictions = {}
    for r in language.identify(odd_docs, model).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert predictions.setdefault(r.text, r.lang_pred) == r.lang_pred
    untaught = language.learn(no_docs)
    assert untaught.languages == [] and {r.lang_pred for r in language.identify(odd_docs, untaught).collect()} == {"und"}
    assert language.identify(no_docs, model).count() == 0
    with pytest.raises(ValueError, match="languages"):
        language.learn(df, language.ProfileParameters(most_prototype_bytes=2 * 4096))


def brute_vector(text, p):
    total, size = np.zeros(p.dimensions), p.letters
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    for word in low.split():
        line = [0, *map(ord, word), 0]
        for k in range(len(line) - size + 1):
            gram = line[k : k + size]
            if all(gram[1:-1]) and (gram[0] or gram[-1]):
                bound = np.ones(p.dimensions)
                for place, letter in enumerate(gram):
                    bound *= np.roll(language._letter_vector(letter, p.dimensions, p.seed), size - 1 - place)
                total += bound
    length = np.linalg.norm(total)
    return total / length if length else total


@pytest.mark.parametrize("at_once", [7, 4096])
def test_document_vectors_and_predictions_against_brute_force(spark, odd_rows, at_once):
    p = language.ProfileParameters(dimensions=256, grams_at_once=at_once)
    texts = [r[1] for r in odd_rows[::5]] + ["a", "İstanbul ΑΣ ß ŉ", "x1y22z", "漢字かな交じり文 漢字", "\n", None, "word " * 3000]
    raw = [(t or "").encode() for t in texts]
    got, some = language.document_vectors(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), p)
    wanted = np.array([brute_vector(t, p) for t in texts])
    assert np.allclose(got, wanted, atol=1e-5) and some.tolist() == [any(c.isalpha() for c in t or "") for t in texts]
    if at_once > 7:
        rows = [(k, t, "fr" if k % 2 else "en") for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = language.learn(df, p)
        proto = np.array([sum(wanted[k] for k, _, x in rows if x == name) for name in ("en", "fr")])
        proto /= np.linalg.norm(proto, axis=1, keepdims=True)
        for r in language.identify(df, model, p).collect():
            near = proto @ wanted[r.doc_id]
            assert r.lang_pred == (("en", "fr")[near.argmax()] if some[r.doc_id] else "und") and abs(r.score - (max(near.max(), 0) if some[r.doc_id] else 0)) < 1e-4


@pytest.mark.parametrize("letters", [3, 4])
@pytest.mark.parametrize("sparse, codes", [(0, 0), (0, 1 << 22), (1 << 40, 0), (64, 1 << 22)])
def test_every_way_of_bundling_against_brute_force(monkeypatch, letters, sparse, codes):
    monkeypatch.setattr(language, "_SPARSE", sparse, raising=False)
    monkeypatch.setattr(language, "_MOST_CODES", codes, raising=False)
    p = language.ProfileParameters(dimensions=128, letters=letters, grams_at_once=50)
    rng = random.Random(letters)
    texts = ["", "a", "12", *("".join(rng.choices("abcdeé \U0001d49c漢", k=k)) for k in (1, 3, 9, 30, 200, 2000)), "abc abc", "z" * 40]
    raw = [t.encode() for t in texts]
    got, some = language.document_vectors(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), p)
    assert np.allclose(got, [brute_vector(t, p) for t in texts], atol=1e-5) and some.tolist() == [any(map(str.isalpha, t)) for t in texts]


def test_vectors_of_short_rows_in_few_seconds():
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", k=rng.randint(2, 9))) for _ in range(3000)]
    raw = [" ".join(rng.choices(words, k=30)).encode() for _ in range(4000)]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    language._letter_table()
    language.document_vectors(data[: offsets[400]], offsets[:401], language.ProfileParameters())
    began = time.thread_time()
    language.document_vectors(data, offsets, language.ProfileParameters())
    assert time.thread_time() - began < 2


def test_many_different_letters_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    raw = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 700_000))).encode()
    language._letter_table()
    tracemalloc.start()
    vectors, some = language.document_vectors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), language.ProfileParameters())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert some[0] and abs(np.linalg.norm(vectors) - 1) < 1e-3 and peak < 300 << 20


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs.where(language.fold(F.col("doc_id")) != 1))
    held = docs.where(language.fold(F.col("doc_id")) == 1)
    scored = language.identify(held, model).join(held.select("doc_id", "lang"), "doc_id")
    assert scored.where("lang = lang_pred").count() >= 0.97 * held.count()


# packing


def check_packing(pieces, texts, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_sequence, streams = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and 0 < r.length <= capacity and r.start == r.piece * capacity
        by_sequence[r.sequence_id].append((r.offset, r.length))
        streams[r.doc_id].append((r.piece, ids.tolist()))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = defaultdict(list)
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        wanted[i] += [(k // capacity, ids[k : k + capacity]) for k in range(0, len(ids), capacity)]
    for i in wanted:
        key = lambda x: (x[0], x[1])
        assert sorted(streams[i], key=key) == sorted(wanted[i], key=key)
    return len(by_sequence)


def test_packing(spark, odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    check_packing(packing.pack_documents(odd_docs, path, capacity=64, open_bins=4).collect(), [r[:2] for r in odd_rows], 64)
    assert packing.pack_documents(no_docs, path).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    pieces = packing.pack_documents(docs, path).collect()
    used = check_packing(pieces, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= 1.01 * -(-sum(r.length for r in pieces) // 2048) + 1


def test_ids_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    ours, theirs = packing.WordTokenizer(path), Tokenizer.from_file(path)

    def wrong(texts):
        raw = [t.encode() for t in texts]
        ids, at = ours.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        return [t for k, (t, e) in enumerate(zip(texts, theirs.encode_batch_fast(texts, add_special_tokens=False))) if e.ids != ids[at[k] : at[k + 1]].tolist()]

    letters = [chr(c) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]]
    assert wrong([f"{before}{c}{mark} x" for c in letters for mark in "!#$%&*,.:;?)" for before in ("", "b")]) == []
    assert wrong([f"{chr(c)}{mark}" for c in range(0x250, 0x3000) for mark in ",."]) == []
    assert wrong(["İ,", "İstanbul, İ.", "ALİ, VELİ.", *twins("ab", 1024), " ".join(twins("ab", 1024))]) == []
    rng, alphabet = random.Random(5), [*"abzAZİıIßŐàé\u0307\u0301 09,,.;!?)('’\n\t\xa0\u3000漢|<>_-·×÷ǅŉ", "'s", "'T", "  "]
    assert wrong(["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(20_000)]) == []


def test_tokenizers_of_other_rules_are_refused():
    with pytest.raises(ValueError, match="rules"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def test_words_with_one_hash_keep_their_own_ids(monkeypatch):
    monkeypatch.setattr(blocks.Words, "hashes", lambda self, which=0: np.zeros(len(self.starts), np.uint64))
    data = np.frombuffer(b"one two one three two", np.uint8)
    which, inverse = packing._distinct(blocks.split_words(data, np.array([0, len(data)])))
    assert which.tolist() == [0, 1, 3] and inverse.tolist() == [0, 1, 0, 2, 1]


def test_the_fullest_bin_closes_first():
    bins = packing.BestFit(10, open_bins=2)
    assert [bins.place(n) for n in (6, 7, 5)] == [(0, 0), (1, 0), (2, 0)]  # a third bin: the one with 7 closes
    assert bins.place(3) == (0, 6) and bins.place(5) == (2, 5) and bins.place(10) == (3, 0)


# sharding


def test_best_fit_decreasing_places_as_a_plain_search_does():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 400).tolist()
    plan, free = sharding.best_fit_decreasing(sizes, 150), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [(f, b) for b, f in enumerate(free) if f >= sizes[k]]
        b = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(150)
        free[b] -= sizes[k]
        assert plan[k] == b
    assert max(sharding.pack_into(sizes, 7)) == 6 and sharding.pack_into([], 3) == []


def test_shards(odd_docs, odd_rows, no_docs, spark):
    got = sharding.shard_documents(odd_docs, 4).collect()
    raw = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(raw(t)) + 8, zlib.crc32(raw(t))) for i, t, *_ in odd_rows)
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert 0 <= shard < 4 and slots == list(range(len(slots)))
    of_text = defaultdict(set)
    texts = {i: t or "" for i, t, *_ in odd_rows}
    for r in got:
        of_text[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_documents(no_docs, 4).count() == 0
    hot = spark.createDataFrame([(i, "hot text" if i % 3 == 0 else f"text {i}") for i in range(9000)], "doc_id long, text string")
    sums = sharding.shard_documents(hot, 5).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r.n == r.m + 1 for r in sums) and len(sums) == 5 and sorted(r.s for r in sums)[0] >= 0.98 * sorted(r.s for r in sums)[3]


# mixing


def test_mixing_follows_the_weights_by_less_than_a_block(spark, odd_docs, no_docs):
    rows = [(i, "abcd"[min(i % 7, 3)]) for i in range(7000)]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' AS slot", "1 AS block")
    p = mixing.MixParameters(weights={"a": 60, "b": 25, "c": 10, "d": 5}, block_docs=10, ticks=100, rows_per_range=500)
    got = mixing.mix_sources(df, p).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
    slots = {r.slot: r.source for r in got}
    done, shares = Counter(), {"a": 60, "b": 25, "c": 10, "d": 5}
    horizon = max(r.slot for r in got if r.on_target)
    for t in range(horizon + 1):
        done[slots[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / 100) < 1 for s, w in shares.items())
    for r in got:
        assert r.release <= r.slot < r.deadline
    ranks = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.source, r.doc_id)):
        ranks[r.source].append(r.block * 10 + r.place)
    assert all(v == list(range(len(v))) for v in ranks.values())
    plan = mixing.mix_sources(df, p)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD[")) or "Scan ExistingRDD" in plan and "Python" not in plan
    mixed = mixing.interleave(odd_docs)
    assert mixed.columns == odd_docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in odd_docs.collect())
    assert mixing.mix_sources(no_docs).count() == mixing.interleave(no_docs).count() == 0


@pytest.mark.parametrize(
    ("weights", "shares"),
    [({"a": 60, "b": 25}, {"a": 60, "b": 25, "c": 42.5}), ({"a": 0.6, "b": 0.25}, {"a": 60, "b": 25, "c": 42.5}), ({None: 3, "a": 1e-9}, {"a": 1, "b": 1, "c": 1}), ({"z": 5}, {"a": 1, "b": 1, "c": 1})],
)
def test_given_and_derived_weights_share_a_scale(spark, weights, shares):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(6000)], "doc_id long, source string")
    on = Counter(r.source for r in mixing.mix_sources(df, mixing.MixParameters(weights=weights, block_docs=1)).where("on_target").collect())
    total = sum(shares.values())
    assert sum(on.values()) > 900 and all(abs(on[s] / sum(on.values()) - w / total) < 0.003 for s, w in shares.items())


def test_weights_are_checked_and_null_sources_can_have_one(spark):
    for wrong in (0, -1, float("nan"), float("inf"), "3", None):
        with pytest.raises(ValueError, match="weight"):
            mixing.MixParameters(weights={"a": 1, "b": wrong})
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(2000)], "doc_id long, source string")
    on = Counter(r.source for r in mixing.mix_sources(df, mixing.MixParameters(weights={"a": 1, None: 3}, block_docs=1)).where("on_target").collect())
    assert abs(on[None] / sum(on.values()) - 0.75) < 0.003


def test_mixing_with_shuffled_plans_null_ids_and_repeated_rows(spark):
    rows = [(None if i % 3 == 0 else i % 50, f"text {i % 7}", "hot" if i % 3 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    p = mixing.MixParameters(block_docs=4, rows_per_range=50, rows_per_file=64, broadcast_rows=0)
    got = mixing.mix_sources(df, p).collect()
    for source in ("hot", None):
        mine = [r for r in got if r.source == source]
        assert sorted(r.block * 4 + r.place for r in mine) == list(range(len(mine)))
        ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(mine, key=lambda r: r.block * 4 + r.place)]
        assert ids == sorted(ids)
    mixed = mixing.interleave(df, p)
    assert Counter(tuple(r) for r in mixed.collect()) == Counter(rows)
    sizes = [len(x) for x in mixed.rdd.glom().collect()]
    assert max(sizes) <= 68 and len(sizes) > 10


def test_many_sources_cost_a_pass_over_them_a_slot(spark):
    df = spark.range(8000).selectExpr("id AS doc_id", "concat('s', id % 400) AS source")
    got = mixing.mix_sources(df, mixing.MixParameters(block_docs=5)).collect()
    assert len({(r.slot, r.place) for r in got}) == 8000 and all(r.release <= r.slot < r.deadline for r in got)


# the pipeline


def test_the_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    limits = quality.RepetitionLimits()
    rows = [r for r in rows if brute_quality(r[1], limits)[-1]]
    near = brute_near(rows, 5, 80)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    kept = brute_substring(rows, 13)
    expected = sorted((i, t) for i, t, *_ in kept)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "repeated passages", "mixed sources", "packed sequences"]
    staged = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        staged = stage(spark, staged, "/root/testdata/sf0.001")
        assert staged.columns == docs.columns, name
    assert sorted((r.doc_id, r.text) for r in staged.collect()) == expected
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_packing(pieces, expected, 2048)


def test_digests_match_texts(odd_docs):
    out = substring.drop_repeated_passages(odd_docs.select("doc_id", "text"), counts=True).select("text", F.sha2("text", 256).alias("h"))
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.h for r in out.collect())


def test_sequences_follow_the_schedule_of_the_mixed_sources(spark, tmp_path):
    """A hot source, and files whose sizes are not in the order of their names."""
    import corpus_pipeline

    texts = ["word " * (3000 - k if k < 1500 else 20 + k % 700) for k in range(6000)]
    rows = [(k, texts[k], "en", "hot" if k % 3 else f"s{k % 5}", len(texts[k])) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    source = {r[0]: r[3] for r in rows}
    off = {r.doc_id for r in mixing.mix_sources(docs).where("not on_target").collect()}
    stage["mixed sources"](spark, docs, "").write.option("maxRecordsPerFile", 700).parquet(f"{tmp_path}/mixed")
    pieces = stage["packed sequences"](spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    check_packing(pieces, [r[:2] for r in rows], 2048)
    first = {}
    for r in pieces:
        first[r.doc_id] = min(r.sequence_id, first.get(r.doc_id, r.sequence_id))
    weights = {s: n**0.5 for s, n in Counter(source.values()).items()}
    total, done, seen = sum(weights.values()), Counter(), 0
    by_sequence = defaultdict(list)
    for d, s in first.items():
        by_sequence[s].append(d)
    for s in sorted(by_sequence):
        if off & set(by_sequence[s]):
            break
        done.update(source[d] for d in by_sequence[s])
        seen += len(by_sequence[s])
        # A block of 16 for the schedule, half of one for sequences still open.
        assert all(abs(done[x] - seen * weights[x] / total) < 24 for x in weights)
    assert seen > 1000
