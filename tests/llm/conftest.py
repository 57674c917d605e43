import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from llm_rows import noise, twins  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, shared passages, one hot source."""
    rng = random.Random(17)
    passage = noise(rng, 30)
    base = [noise(rng, rng.choice([3, 20, 80, 200])) for _ in range(25)]
    rows = []
    for k in range(160):
        text = rng.choice(base) if k % 3 else noise(rng, 60)
        if k % 4 == 1:
            w = text.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "edited"
            text = " ".join(w)
        if k % 10 == 2:
            text = f"{text}\n{passage}\t{noise(rng, 5)}"
        rows.append((k, text, rng.choice(["en", "fr", None]), "hot" if k % 3 else f"s{k % 7}", len(text)))
    rows += [
        (200, None, "en", None, None), (201, "", None, "hot", 0), (202, " \t\n ", "fr", "hot", 4), (203, "one", "en", "hot", 3), (204, "ONE", "en", "hot", 3),
        (205, noise(rng, 30_000, 90), "en", "hot", None), (206, "é" * 3000 + " ü 漢字 \U0001f600 don't <|endoftext|> ...", "de", "hot", 1), (207, base[0], "en", "hot", 1),
        (207, base[0], "en", "hot", 1), (None, base[1], None, None, None), (208, "a b \x0bc\x1cd", "en", "hot", 7), (209, "x" * 70_000, "en", "s1", 9),
        (210, ("same line here\n" * 30) + noise(rng, 60), "en", "s1", 9), (211, noise(rng, 60) + " #*$%&|<>", "en", "s1", 9),
    ]
    around = noise(rng, 12), noise(rng, 30)
    rows += [(212 + k, f"{around[0]} {word} {around[1]}", "en", "s1", 9) for k, word in enumerate(twins("ab", 1024))]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names are those of results."""
    from pyspark.sql import functions as F

    names = ("n_words", "kept", "component_id", "slot", "shard", "sequence_id", "part", "digest", "label", "block", "place", "media", "key", "size")
    return spark.createDataFrame(odd_rows, DOCS).repartition(3).select("*", *(F.lit(f"mine {n}").alias(n) for n in names))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
