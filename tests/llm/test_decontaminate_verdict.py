import numpy as np

from quarry.llm import decontaminate as D


def plain(words, item, answer, begin, end):
    """Every stretch counted word by word, the answer always looked for."""
    n = len(item)
    region = words[max(0, begin - n):min(len(words), end + n)]
    said = D.contains(region, answer)
    least, size, step, best = (D.LOOSE if said else D.SHARE) * n, n + n // 4, max(1, n // 8), 0
    for b in range(0, max(1, len(region) - size + step), step):
        part = region[b:b + size].tolist()
        if sum(min(part.count(x), item.tolist().count(x)) for x in set(item.tolist())) >= least:
            best = max(best, D.lcs(item, region[b:b + size]))
    return best, said, best >= D.SHARE * n or (said and best >= D.LOOSE * n)


def test_verdict_against_plain_count():
    rng = np.random.default_rng(3)
    leaks = 0
    for _ in range(600):
        n, kinds = int(rng.integers(D.SHORT, 60)), int(rng.integers(2, 80))
        item = rng.integers(0, kinds, n).astype(np.uint64)
        words = rng.integers(0, kinds * 2, int(rng.integers(1, 300))).astype(np.uint64)
        if rng.random() < 0.6:
            at = int(rng.integers(0, len(words) + 1))
            changed = np.where(rng.random(n) < rng.choice([0, 0.2, 0.4]), np.uint64(999), item)
            changed[-3:] = item[-3:]
            words = np.concatenate([words[:at], changed, words[at:]])
        begin = int(rng.integers(0, len(words)))
        got, want = D.verdict(words, item, item[-3:], begin, begin + D.WINDOW), plain(words, item, item[-3:], begin, begin + D.WINDOW)
        assert got[0] == want[0] and bool(got[2]) == bool(want[2])
        assert not want[2] or got[1] == want[1]
        assert got == D.verdict(words, item, item[-3:], begin, begin + D.WINDOW, np.unique(item, return_counts=True))
        leaks += bool(want[2])
    assert 50 < leaks < 550


def test_stretches_that_cannot_leak_are_not_searched(monkeypatch):
    rng = np.random.default_rng(5)
    item = np.concatenate([np.arange(30), np.zeros(10)]).astype(np.uint64)
    # full of the item's commonest word, but with too few of its others
    words = np.where(rng.random(5000) < 0.7, 0, 100 + np.arange(5000)).astype(np.uint64)
    calls = []
    real = D.contains
    monkeypatch.setattr(D, "contains", lambda *a: calls.append(1) or real(*a))
    for at in range(0, 4900, D.STEP):
        assert not D.verdict(words, item, item[-3:], at, at + D.WINDOW)[2]
    assert not calls
