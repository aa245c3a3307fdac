"""Generated texts for the tests of the corpus operators."""

from __future__ import annotations

import random


def words(rng, n, vocab=2000):
    return [f"w{rng.randrange(vocab)}x" for _ in range(n)]


def corpus(seed=1, n=120):
    """(doc_id, text, quality, toxic): prose, junk, toxic prose, copies, near copies, shared passages."""
    rng = random.Random(seed)
    passage = words(rng, 55)
    out, kept = [], []
    for k in range(n):
        kind = rng.random()
        if kind < 0.12 and kept:
            text, bad = rng.choice(kept)
            out.append((k, text, 1, bad))
            continue
        if kind < 0.3 and kept:
            text, bad = rng.choice(kept)
            w = text.split()
            for _ in range(rng.randrange(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            out.append((k, " ".join(w), 1, bad))
            continue
        w = words(rng, rng.randrange(3, 260))
        if kind < 0.4:
            w[len(w) // 2 : len(w) // 2] = passage
        if kind > 0.85:
            out.append((k, " ".join(x + rng.choice(["***", "$$$", "&&&"]) for x in w), 0, 0))
            continue
        bad = int(kind > 0.7)
        if bad:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["idiotic", "moronic", "wretch", "vermin"]))
        text = " ".join(w[:20]) + "\n" + " ".join(w[20:])
        kept.append((text, bad))
        out.append((k, text, 1, bad))
    return out
