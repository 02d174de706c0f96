"""SimHash near duplicates, vector codes and hard negatives against brute-force versions, and on odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash

from refsieve.llm import codes, negatives, simhash, vectors

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, score double, code string, root long"


# Operator 11


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_classes(rows):
    """{(id, fingerprint): least id reachable}, comparing all fingerprints with all."""
    prints = sorted({fp for _, fp in rows})
    least = {fp: min((i for i, f in rows if f == fp and i is not None), default=math.inf) for fp in prints}
    apart = np.array(prints, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(apart ^ apart[i]) <= 4) for i in range(len(prints))]
    changed = True
    while changed:
        changed = False
        for i, around in enumerate(near):
            best = min(least[prints[j]] for j in around)
            if best < least[prints[i]]:
                least[prints[i]], changed = best, True
    return least


def check_fingerprints(frame, rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in frame.collect()), key=str)
    least = brute_classes(rows)
    assert got == sorted(((i, f"{fp:016x}", None if least[fp] == math.inf else least[fp]) for i, fp in rows), key=str)


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_fingerprints(simhash.join(docs), [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])


def test_simhash_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (4, " \t\r\n\x0b\x0c "), (5, "One TWO"), (5, "three four five six seven"), (5, "three four five six seven"), (6, "word " * 50_000), (7, "Ärger   naïve 中文 \U0001f600"), (None, "only without an id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id as node", "doc_id as fp", "'x' as root")
    check_fingerprints(simhash.join(frame), [(i, brute_fingerprint(t)) for i, t in rows])
    assert simhash.join(frame.limit(0)).collect() == []


def test_long_texts_in_runs():
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(90)}" for _ in range(333))
    for step in (1, 7, 100, 329, 330, 331):
        assert simhash.fingerprint(text, step=step) == brute_fingerprint(text)


@pytest.mark.parametrize("block", [3, 2048])
def test_lists_find_every_link(spark, monkeypatch, block):
    """A tight family, chains that step by 4 bits, pairs at 4 and 5 bits in any bytes, and strangers that share bytes; in small blocks, too."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)

    def flipped(fp, n):
        return fp ^ sum(1 << b for b in rng.sample(range(64), n))

    centre = rng.getrandbits(64)
    prints = [centre, 0, (1 << 64) - 1] + [flipped(centre, rng.randrange(1, 5)) for _ in range(150)]
    for _ in range(20):
        at = rng.getrandbits(64)
        for _ in range(6):
            prints.append(at)
            at = flipped(at, 4)
    for n in (4, 5) * 25:
        one = rng.getrandbits(64)
        prints += [one, flipped(one, n)]
    prints += [(centre & 0xFFFFFFFF) | (rng.getrandbits(32) << 32) for _ in range(60)]
    rows = [(rng.randrange(10**6), fp) for fp in prints]
    table = {f"text {i}": fp for i, (_, fp) in enumerate(rows)}
    monkeypatch.setattr(simhash, "fingerprint", lambda text: table[text])
    frame = spark.createDataFrame([(i, f"text {n}") for n, (i, _) in enumerate(rows)], "doc_id long, text string")
    check_fingerprints(simhash.join(frame), rows)


# Operator 12


def whole(x, scale):
    return None if x is None or not x or any(c is None or not math.isfinite(c) for c in x) else [math.floor(scale * c) for c in x]


def brute_codes(rows):
    """Plain Lloyd with Python integers: every part anew in every round."""
    kept = sorted(((i, whole(x, 1024), label) for i, x, label in rows if whole(x, 1024)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [part[:256] for part in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), e) for e, entry in enumerate(book)) for x in part] for part, book in zip(parts, books, strict=True)]

    for _ in range(4):
        for p, at in enumerate(assign()):
            for e in range(len(books[p])):
                mine = [x for x, (_, its) in zip(parts[p], at, strict=True) if its == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(c) // len(mine) for c in zip(*mine, strict=True)], *books[p][e + 1 :]]
    last = assign()
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    errors = [sum(last[p][i][0] for p in range(4)) for i in range(len(kept))]
    total = {label: sum(e for e, (_, _, its) in zip(errors, kept, strict=True) if its == label) for label in {r[2] for r in kept}}
    return sorted(((kept[i][0], "".join(f"{last[p][i][1]:02x}" for p in range(4)), errors[i], total[kept[i][2]], digest) for i in range(len(kept))), key=str)


def vector_rows(n, size, seed, families=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(families, size))
    label = rng.integers(0, families, n)
    return [(int(i), [float(np.float32(c)) for c in centres[label[i]] + 0.3 * rng.normal(size=size)], int(label[i]) % 10) for i in range(n)]


def framed(spark, rows, parts=5):
    return spark.createDataFrame([(i, x, label, 0.5, "x", 1) for i, x, label in rows], VECTORS).repartition(parts)


ODD = [(3, None, 1), (4, [], 1), (5, [1.0, None, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0], 1), (6, [float("nan")] * 8, 1), (7, [float("inf")] * 8, 2), (900, [0.1] * 8, None), (901, [0.1] * 8, None), (901, [0.1] * 8, None), (902, [-0.0001] * 8, 3), (902, [0.2] * 8, 3), (14, [0.1] * 8, 9)]


@pytest.mark.parametrize("rows", [vector_rows(700, 16, 1), [*vector_rows(330, 8, 2), *ODD], vector_rows(5, 8, 3), [(i, [1.0] * 8, 0) for i in range(300)]])
def test_codes_equal_brute_force(spark, rows):
    rows = [(i, x if x is None else [None if c is None else float(np.float32(c)) for c in x], label) for i, x, label in rows]
    got = codes.compress(framed(spark, rows))
    assert sorted((tuple(r) for r in got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str) == brute_codes(rows)


def test_codes_shuffle_only_changes(spark):
    frame = framed(spark, vector_rows(300, 8, 4))
    state = codes.state(frame, 8, "vec_id", "embedding", "label")
    books = codes.matrix_of(state.orderBy("vec_id").limit(256).select("v").toArrow().column("v").combine_chunks()).reshape(256, 4, -1).transpose(1, 0, 2)
    first = codes.written(codes.assigned(state, books), "first")
    assert {r.slot: r.delta for r in codes.changes(first, 2).collect()}
    assert codes.changes(codes.assigned(first, books), 2).collect() == []


def test_codes_of_odd_tables(spark):
    assert codes.compress(framed(spark, ODD[:5])).collect() == []
    assert codes.compress(framed(spark, ODD).limit(0)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(framed(spark, [(1, [1.0, 2.0, 3.0], 0)]))
    # other lengths and sizes than fit are left out
    assert [r.vec_id for r in codes.compress(framed(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0), (3, [5e6] * 4, 0)])).collect()] == [1]


# Operator 13


def brute_negatives(rows, every):
    kept = [(i, whole(x, 256), label) for i, x, label in rows if i is not None and label is not None and whole(x, 256)]
    out = []
    for i, q, label in kept:
        if i % every:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, its) for j, v, its in kept if j != i)
        for score, j, _ in [r for r in ranked if r[2] == label][:5]:
            good = [(s, n) for s, n, its in ranked if its != label and 30 * -score <= 100 * -s <= 90 * -score][:10]
            out += [(i, j, at, n, -score, -s) for at, (s, n) in enumerate(good, 1)]
    return sorted(out)


def check_negatives(spark, rows, every=10, parts=5):
    rows = [(i, x if x is None else [None if c is None else float(np.float32(c)) for c in x], label) for i, x, label in rows]
    got = negatives.mine(framed(spark, rows, parts), every=every)
    want = brute_negatives(rows, every)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want
    return want


@pytest.mark.parametrize("tree_rows, anchors", [(8192, 16_384), (150, 16_384), (8192, 9)])
def test_negatives_equal_brute_force(spark, monkeypatch, tree_rows, anchors):
    monkeypatch.setattr(negatives, "TREE_ROWS", tree_rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    assert len(check_negatives(spark, vector_rows(600, 16, 5))) > 1000


def test_negatives_on_odd_rows(spark):
    assert check_negatives(spark, [*vector_rows(80, 8, 6), *ODD, (10, [0.3] * 8, 4), (None, [0.3] * 8, 4)])
    # equal scores go by id, and two labels only
    assert check_negatives(spark, [(i, [1.0, 0.5 if i % 2 else 0.9], i % 2) for i in range(400)], 50)
    # every row a label of its own: no positives; one label: no negatives
    assert check_negatives(spark, [(i, [1.0, 0.1 * i], i) for i in range(200)]) == []
    assert check_negatives(spark, [(i, [1.0, 0.1 * i], 1) for i in range(200)]) == []
    assert check_negatives(spark, [(i, [0.0, 0.0], i % 3) for i in range(100)])
    assert negatives.mine(framed(spark, ODD[:5])).collect() == []
    assert negatives.mine(framed(spark, ODD).limit(0)).collect() == []


def test_balls_bound_and_prune():
    rows = vector_rows(3000, 16, 7)
    ids, labels = (np.array([r[i] for r in rows], np.int64) for i in (0, 2))
    v = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int32)
    tree = negatives.grow(ids, labels, v)
    nodes, centres, radii = tree[3:]
    for lo, hi, left, _, least, most in nodes:
        assert (left < 0) == (hi - lo <= negatives.LEAF)
        assert (tree[1][lo:hi] >= least).all() and (tree[1][lo:hi] <= most).all()
    for at in range(len(nodes)):
        lo, hi = nodes[at][:2]
        assert (np.sqrt(((tree[2][lo:hi] - centres[at]) ** 2).sum(axis=1)) <= radii[at] + 1e-6).all()
    # the walk reads far fewer rows than there are
    read = []
    usual = negatives.products
    negatives.products = lambda a, b: (read.append(len(a) * len(b)), usual(a, b))[1]
    try:
        asked = ids[:20], labels[:20], v[:20].astype(np.int64), np.full((20, 1), negatives.NONE), np.full((20, 1), -negatives.NONE)
        negatives.walk(tree, asked, (np.full((20, 1, 5), negatives.NONE), np.zeros((20, 1, 5), np.int64)), True)
    finally:
        negatives.products = usual
    assert sum(read) < 20 * len(rows) / 4


def test_products_are_exact():
    rng = np.random.default_rng(8)
    big = rng.integers(-vectors.LIMIT, vectors.LIMIT, (5, 4096))
    want = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in big] for x in big]
    assert vectors.products(big, big).tolist() == want
    assert vectors.products(big[:, :8] % 100, big[:, :8] % 100).dtype == np.int64
