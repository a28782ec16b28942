import random
from itertools import combinations

import numpy as np

from millrace.llm.components import components
from millrace.llm.near_dedup import SIMILARITY, _hashes, aligned, drop_near_copies, labelled_shingles, link_blocks, near_classes
from tests.llm.helpers import EDGES, edges, empty


def subsequence(a, b):
    """Length of the longest common subsequence by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a, b):
    if not len(a) or not len(b):
        return 0.0
    common = subsequence(a.tolist(), b.tolist())
    return common / (len(a) + len(b) - common)


def classes(links, n):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def corpus(seed=3):
    """Families of texts by chains of edits, moved blocks and unrelated texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(900)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(at, "new"), lambda: copy.insert(at, "ins"), lambda: copy.pop(at)])()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
        texts.append(" ".join(base[len(base) // 2 :] + base[: len(base) // 2]))
    return texts + ["short one", "Short, one!", "a b c d e f", "a b c d e f g"]


def test_classes_match_brute_force(spark):
    texts = corpus()
    rows = near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    seq = [labelled_shingles(_hashes(t)) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(seq[i], seq[j]) >= SIMILARITY - 1e-9]
    label = classes(links, len(texts))
    assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(label))
    assert sum(r.kept for r in rows) == len(set(label)) and all(r.class_size == label.count(r.class_id) for r in rows)


def boilerplate(n=60, seed=8):
    """A large group of near copies, and texts that share most of their words with it and each other."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for k in range(n):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{k}"
        texts.append(" ".join(copy))
    for k in range(n):
        texts.append(" ".join(base[: 84 + k % 5] + [f"own{k // 2}_{j}" for j in range(30)]))
    return texts


def test_large_neighbourhoods_match_brute_force(spark, monkeypatch):
    import millrace.llm.near_dedup as N

    texts = corpus(9) + boilerplate()
    seq = [labelled_shingles(_hashes(t)) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(texts)), 2) if min(len(seq[i]), len(seq[j])) >= 0.8 * max(len(seq[i]), len(seq[j])) and similarity(seq[i], seq[j]) >= SIMILARITY - 1e-9]
    label = classes(links, len(texts))
    assert max(label.count(c) for c in set(label)) > 50
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    turns = []
    between = N._between_parts
    monkeypatch.setattr(N, "_between_parts", lambda *a: turns.append(1) or between(*a))
    for block in (700, 3000):
        monkeypatch.setattr(N, "BLOCK_SHINGLES", block)
        rows = near_classes(table).collect()
        assert {r.doc_id: r.class_id for r in rows} == dict(enumerate(label))
        assert all(r.class_size == label.count(r.class_id) for r in rows) and sum(r.kept for r in rows) == len(set(label))
    assert turns


def test_parts_of_one_label_are_not_compared():
    a, b = np.arange(50, dtype=np.uint32), np.arange(1, 51, dtype=np.uint32)
    assert link_blocks([(b"1", b"x", a)], [(b"2", b"x", b)]) == [] and link_blocks([(b"1", b"x", a)], [(b"2", b"y", b)]) == [(b"2", b"1")]


def test_alignment_is_exact_where_it_matters():
    rng = random.Random(1)
    for _ in range(200):
        a = np.array(rng.sample(range(300), rng.randint(5, 60)), np.uint32)
        b = np.array([x for x in a if rng.random() < 0.95] + [400], np.uint32)
        true = similarity(a, b)
        assert aligned(a, b) == true if true >= SIMILARITY else aligned(a, b) < SIMILARITY


def test_blocks_find_what_one_block_finds():
    seq = [(str(k).encode(), str(k).encode(), labelled_shingles(_hashes(t)).astype(np.uint32)) for k, t in enumerate(corpus(5))]
    seq = [t for t in seq if len(t[2])]
    def parts(links):
        index = {t[0]: k for k, t in enumerate(seq)}
        return classes([(index[a], index[b]) for a, b in links], len(seq))
    half = len(seq) // 2
    split = link_blocks(seq[:half], None) + link_blocks(seq[half:], None) + link_blocks(seq[:half], seq[half:])
    assert parts(link_blocks(seq, None)) == parts(split)


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 101)]
    found = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_edges(spark):
    rows = near_classes(edges(spark, "row")).collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id in (1, 2, 3, 5, 6)} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert sum(r.kept for r in rows if r.doc_id == 7) == 1
    left = drop_near_copies(edges(spark, "row"))
    assert left.columns == edges(spark, "row").columns and sorted(r.doc_id for r in left.collect() if r.doc_id is not None and r.doc_id < 7) == [1, 4, 5]
    assert near_classes(empty(spark)).count() == 0


def test_repeated_ids_lose_copies_only(spark):
    a, b, c, d = ("alpha one two three four five six", "beta ten twenty thirty forty fifty", "gamma red green blue black white", "delta up down left right back")
    rows = [(1, a), (1, b), (0, b), (2, c), (2, c + "!"), (3, d), (3, d), (None, a + "!"), (None, "no copy of any other text here"), (None, "no copy of any other text here")]
    left = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in left if r.doc_id != 2)
    assert found == [(-1, "no copy of any other text here"), (0, b), (1, a), (3, d)]
    assert [r.text.rstrip("!") for r in left if r.doc_id == 2] == [c]
    assert sum(r.doc_id == 7 for r in drop_near_copies(edges(spark, "row")).collect()) == 1


def test_many_texts_under_one_id_are_read_once(spark):
    """Sequences are joined by id and text: near copies that share an id give no more rows than there are texts."""
    words = [f"w{k}" for k in range(60)]
    rows = [(7, " ".join(words[:50] + [f"x{k}"] + words[50:])) for k in range(300)] + [(8, " ".join(words))]
    decided = near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.class_id, r.class_size) for r in decided.collect()} == {(7, 301)}
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.count() == 1
