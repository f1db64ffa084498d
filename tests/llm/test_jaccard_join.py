import random
import re

import numpy as np
import pytest

from lamina.errors import LaminaError
from lamina.llm import jaccard_join
from lamina.llm.components import components
from lamina.llm.jaccard_join import candidates_in, deduplicate, joined

UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    """(doc_id, n, component) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
    return words


def corpus(seed, passage=True):
    """Groups of near copies of many sizes around the threshold, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(30)]
    texts = []
    for n in [1, 2, 3, 4, 5, 6, 8, 9, 10, 13, 20, 40, 80, 150, 300]:
        base = [word() for _ in range(n)]
        for e in range(8):
            texts.append(edited(base, min(n, e * max(1, n // 60)), rng))
            texts.append(base[: max(1, n - e)])
    base = [word() for _ in range(120)]
    texts += [edited(base, rng.randrange(6), rng) for _ in range(60)]  # a large group
    if passage:
        for _ in range(60):
            own = [word() for _ in range(rng.randrange(5, 60))]
            texts.append(own + shared)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_matches_brute_force(make):
    rows = corpus(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_small_buckets_of_two_still_lose_nothing(make, monkeypatch):
    """With every bucket treated as large, the slow exact way does all the work."""
    import lamina.llm.jaccard_join as j

    real = candidates_in
    monkeypatch.setattr(j, "candidates_in", lambda s, k: real(s, k, small=2))
    rows = corpus(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_edge_rows(make):
    rows = [
        (5, None), (6, ""), (7, " \n\t"), (8, "One two"), (3, "one TWO"), (9, "one two three"), (None, "one two"), (8, "One two"),
        (8, "é É É É É é é"), (None, "a b c d e f g"), (None, "A b c d e f g"), (20, "long " * 3000), (2, "long " * 5), (30, "a b c d e a b c d e a"), (31, "a b c d e a b c d e a b c"),
    ]
    extra = make([(*r, 1, 2) for r in rows], "doc_id long, text string, k long, n long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined(extra).collect()), key=str)
    assert got == brute(rows)
    assert joined(make([])).count() == 0


def test_deduplicate_keeps_one_of_each_group(make):
    rows = [(5, None), (6, ""), (8, "one two"), (3, "one TWO"), (3, "other words"), (None, "one two"), (3, "one two"), (9, "x y"), (9, "x y"), (None, "q"), (None, "Q")]
    kept = deduplicate(make([(*r, "s") for r in rows], "doc_id long, text string, k string"))
    assert kept.columns == ["doc_id", "text", "k"]
    got = sorted(((r.doc_id, (r.text or "").lower()) for r in kept.collect()), key=str)
    assert got == sorted([(5, ""), (6, ""), (3, "one two"), (3, "other words"), (9, "x y"), (None, "q")], key=str)


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 3), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and 200 not in got


def test_candidates_skip_pairs_of_probes():
    s = np.array([1, 1, 1, 2, 2], dtype=np.uint64)
    k = np.array([2 << 1, 3 << 1 | 1, 4 << 1 | 1, 5 << 1 | 1, 6 << 1 | 1], dtype=np.uint64)
    kind, a, b, times = candidates_in(s, k)
    assert times.tolist() == [1, 1] and kind.tolist() == [0, 0] and a.tolist() == [2, 2] and b.tolist() == [3, 4]


def test_different_texts_of_one_polynomial_never_link(make):
    """Thue-Morse words collide under any base of a polynomial modulo 2^64."""
    t = "a"
    for _ in range(10):
        t = "".join({"a": "ab", "b": "ba"}[c] for c in t)
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, t), (2, u), (3, f"one two three four {t}"), (4, f"one two three four {u}")]
    assert sorted((r.doc_id, r.component_id) for r in joined(make(rows)).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_a_shared_key_is_found_out(make, monkeypatch):
    """Keys of the first seed are made alike: the sets differ, so another seed is taken, and at last an error."""
    import lamina.llm.jaccard_join as j

    rows = [(i, f"w{i} a b c d e f") for i in range(6)] + [(9, "q " * 9), (8, "q " * 7)]
    real = j.sets_of
    monkeypatch.setattr(j, "sets_of", lambda text, seed=0: [x // 2**62 if n == 1 and not seed else x for n, x in enumerate(real(text, seed))])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in joined(make(rows)).collect())
    assert got == brute(rows)
    monkeypatch.setattr(j, "sets_of", lambda text, seed=0: [x // 2**62 if n == 1 else x for n, x in enumerate(real(text, seed))])
    with pytest.raises(LaminaError):
        joined(make(rows))


def test_hot_signatures_and_values_lose_nothing(make, monkeypatch):
    """With every frequent signature, set, bucket and component treated as hot."""
    import lamina.llm.jaccard_join as j
    import lamina.llm.joins as joins

    monkeypatch.setattr(j, "HOT", 10_000)
    monkeypatch.setattr(j, "HOT_FLOOR", 3)
    real = joins.hot_values
    for module in (j, joins):
        monkeypatch.setattr(module, "hot_values", lambda rows, on: real(rows, on, 10_000, 2))
    rows = corpus(4)
    rows += [(1000 + i, rows[40][1]) for i in range(30)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in joined(make(rows)).collect()), key=str)
    assert got == brute(rows)


def test_linked_sets_share_as_many_signatures_as_the_slack_says():
    """Random pairs of linked sets: common signatures in the band where they meet against the slack of either."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        both = int(rng.integers(1, 200))
        d = rng.integers(0, both // 4 + 1)
        x = int(rng.integers(0, d + 1))
        values = rng.integers(0, 2**63, both + d).astype(np.uint64)
        sets = [np.sort(values[: both + x]), np.sort(np.concatenate((values[:both], values[both + x :])))]
        bands = [int(np.searchsorted(jaccard_join.TOPS, len(s))) for s in sets]
        found = []
        for s, band in zip(sets, bands, strict=True):
            role = max(bands) - band
            _, signature, slack = jaccard_join._signatures(np.zeros(len(s), np.int64), s, np.array([len(s)]), role)
            found.append((set(signature.tolist()), int(slack[0])))
        assert len(found[0][0] & found[1][0]) >= max(found[0][1], found[1][1]) + 1
