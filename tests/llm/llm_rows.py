import re


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def noise(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def twins(letters, n):
    """Two different words of n letters on which polynomials modulo a power of two agree."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)
