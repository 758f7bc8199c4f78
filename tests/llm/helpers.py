"""Small corpora and plain versions of what the operators compute."""

import random
import re

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so", "ni", "pa") for b in ("dan", "ver", "lim", "sot", "gra", "pel")]
EDGE_TEXTS = [None, "", "   \t\n", "one", "Two words", "two  WORDS", "a b c d e", "A B C D E", "!!! ??? ...", "ünïcödé wörds ärë hërë töö", "x" * 5000, "word " * 3000]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text, k=5):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(n, links):
    """The smallest member that each of 0 to n - 1 reaches."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
