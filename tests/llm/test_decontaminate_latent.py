"""Recall of the latent search by itself (the word search switched off), with more items than directions, short and
long items, and reworded copies."""

import numpy as np
import pytest

from quarry.llm.decontaminate import RANK, leaks

WORDS = 12000


def corpus(n_items, low, high, reworded, seed=5):
    """Documents of which some hold an item among other words, the benchmark, and the pairs that were planted."""
    rng = np.random.default_rng(seed)
    share = 1 / (np.arange(WORDS) + 20.0)
    share /= share.sum()
    draw = lambda n: rng.choice(WORDS, n, p=share)      # noqa: E731
    items = [draw(int(rng.integers(low, high + 1))) for _ in range(n_items)]
    docs, planted = [], set()
    for d in range(1500):
        body = [draw(int(rng.integers(40, 120)))]
        if d % 3:
            k = int(rng.integers(n_items))
            copy = items[k].copy()
            if reworded:    # the answer (the last words) stays
                free = len(copy) - min(8, max(1, len(copy) // 3))
                at = rng.choice(free, int(reworded * len(copy)), replace=False)
                copy[at] = draw(len(at))
            body += [copy, draw(int(rng.integers(20, 80)))]
            planted.add((d, k))
        docs.append((d, " ".join(f"w{x}" for x in np.concatenate(body))))
    return docs, [(k, " ".join(f"w{x}" for x in it)) for k, it in enumerate(items)], planted


@pytest.mark.parametrize("n_items, low, high, reworded", [
    (200, 15, 60, 0.0), (1000, 15, 60, 0.0), (4000, 15, 60, 0.0), (1000, 8, 14, 0.0), (4000, 8, 14, 0.0), (200, 100, 600, 0.0),
    (1000, 100, 600, 0.0), (200, 15, 60, 0.4), (1000, 15, 60, 0.4), (4000, 15, 60, 0.4), (1000, 100, 600, 0.4)])
def test_latent_search_alone_reaches_its_recall(spark, n_items, low, high, reworded):
    assert n_items > RANK
    docs, items, planted = corpus(n_items, low, high, reworded)
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    items = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items).select("doc_id", "item_id").collect()}
    alone = {(r["doc_id"], r["item_id"]) for r in leaks(docs, items, word_search=False).select("doc_id", "item_id").collect()}
    assert alone <= whole
    wanted = planted & whole        # some reworded copies are no leaks by the words they keep
    print(n_items, low, high, reworded, len(planted), len(wanted), len(alone & wanted) / len(wanted), len(whole), len(alone))
    assert len(wanted) >= 0.7 * len(planted)
    assert len(alone & wanted) >= 0.9 * len(wanted)
    assert len(alone) >= 0.9 * len(whole)
