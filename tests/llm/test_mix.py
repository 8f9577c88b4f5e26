import collections

import numpy as np
import pytest

from tesserae.llm import source_mix

from .conftest import prose  # noqa: TID252


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(0)
    own = [(i, prose(i, int(r.integers(1, 60)))) for i in range(900)]
    return [*own, *own[:20], (None, "a b c"), (2000, None)]


def by_hand(rows):
    import hashlib

    size = collections.Counter()
    docs = []
    for i, t in rows:
        s = None if i is None else f"s{i % 3}"
        n = len((t or "").split())
        h = int(hashlib.md5(("null" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        docs.append((i, s, n, h))
        size[s] += n
    names = sorted(k for k in size if k is not None) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), 1.5 * sum(size.values())
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * size[s]
            budget -= target[s]
            open_.discard(s)
    return docs, size, target


def test_targets_and_budgets(frame, rows):
    docs, size, target = by_hand(rows)
    got = source_mix.mix_report(frame(rows)).collect()
    assert len(got) == len(docs)
    taken = collections.Counter()
    for r in got:
        s = None if r["doc_id"] is None else f"s{r['doc_id'] % 3}"
        assert r["source_size"] == size[s]
        assert r["target"] == pytest.approx(target[s])
        assert r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in size:
        assert target[s] - 130 <= taken[s] <= target[s] + 1e-6
    again = sorted((str(r["doc_id"]), r["taken"]) for r in source_mix.mix_report(frame(rows).repartition(3)).collect())
    assert again == sorted((str(r["doc_id"]), r["taken"]) for r in got)


def test_documents_follow_the_report(frame, rows):
    df = frame(rows)
    want = collections.Counter()
    for r in source_mix.mix_report(df).collect():
        if r["size"]:
            want[r["doc_id"]] += r["taken"] // r["size"]
    got = collections.Counter(r["doc_id"] for r in source_mix.mix_documents(df).collect() if r["text"])
    assert got == +want
