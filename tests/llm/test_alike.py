"""Near copies beyond the fingerprints' radius: exact Jaccard shares by brute force."""

import random

import numpy as np

from kinlight.llm import simhash

from .test_dedup import components, plain_simhash


def plain_set(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def alike(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b)


def test_copies_with_changed_words_are_dropped(spark, docs_of):
    draw = random.Random(7)
    texts = []
    for _ in range(40):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.randrange(60, 300))]
        texts.append(" ".join(words))
        for changed in (1, 2, 4, 9):
            copy = list(words)
            for i in draw.sample(range(len(copy)), changed):
                copy[i] = f"x{draw.randrange(4000)}"
            texts.append(" ".join(copy))
    texts += [None, "", "few words", "Few  words", "other few words"]
    sets, fps = [plain_set(t) for t in texts], [plain_simhash(t or "") for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    apart = [(fps[i] ^ fps[j]).bit_count() for i, j in near]
    assert sum(d > 4 for d in apart) > 50  # the fingerprints' radius alone leaves these
    name = list(range(len(texts)))
    linked = near + [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    for _ in name:
        for i, j in linked:
            name[i] = name[j] = min(name[i], name[j])
    by_radius = set(components(fps, range(len(texts)), 4))
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs_of(texts), least=0.8).collect())
    assert kept == sorted(set(name)) and len(kept) < len(by_radius)


def joined(n, links):
    name = list(range(n))
    for _ in range(n):
        before = list(name)
        for i, j in links:
            name[i] = name[j] = min(name[i], name[j])
        if name == before:
            return name


def test_pairs_connect_what_all_alike_pairs_connect():
    draw = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.unique(draw.integers(0, 14, draw.integers(1, 14)).astype(np.int64)) for _ in range(25)]
        plain = [set(s.tolist()) for s in sets]
        want = [(i, j) for i in range(25) for j in range(i) if alike(plain[i], plain[j])]
        assert joined(25, simhash.alike_pairs(sets, None, 0.8)) == joined(25, want)
        across = {(i, j) for i in range(1) for j in range(24) if alike(plain[i], plain[j + 1])}
        assert set(simhash.alike_pairs(sets[:1], sets[1:], 0.8)) == across
        both = [(i, j + 10) for i, j in simhash.alike_pairs(sets[:10], sets[10:], 0.8)]
        assert joined(25, both) == joined(25, [(i, j) for i in range(10) for j in range(10, 25) if alike(plain[i], plain[j])])


def test_large_bands_in_blocks(spark, docs_of):
    # one band family of hundreds of texts that chain away from each other, copies of them, and tiny tasks
    draw = random.Random(11)
    words = [f"w{draw.randrange(5000)}" for _ in range(120)]
    texts = []
    for _ in range(150):
        words = list(words)
        words[draw.randrange(120)] = f"y{draw.randrange(10**6)}"
        texts += [" ".join(words)] * (1 + draw.randrange(3))
    texts += [" ".join(texts[0].split()).upper(), None, "", "x"]
    docs = docs_of(texts)
    by_size = {}
    for held in (1 << 20, 300):
        links = [(r.a, r.b) for r in simhash.alike_links(docs, held=held).collect()]
        nodes = sorted({x for link in links for x in link})
        at = {x: i for i, x in enumerate(nodes)}
        names = joined(len(nodes), [(at[a], at[b]) for a, b in links])
        by_size[held] = {frozenset(x for x in nodes if names[at[x]] == c) for c in set(names)}
    assert by_size[300] == by_size[1 << 20] and max(map(len, by_size[300])) > 100


def test_no_links_without_texts(spark, docs_of):
    assert simhash.alike_links(docs_of([])).count() == 0
    assert simhash.alike_links(docs_of([None, "", " "])).count() == 0
