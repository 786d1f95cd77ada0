import random

from strandline.llm import minhash as M


def test_every_near_pair_of_a_hot_bucket_meets(spark, monkeypatch):
    monkeypatch.setattr(M, "BANDS", 1)
    monkeypatch.setattr(M, "ROWS", 0)  # all texts in one bucket
    monkeypatch.setattr(M, "BLOCK", 10)
    start = " ".join(f"w{i}" for i in range(30))
    tail = lambda i: " ".join(f"t{i}x{k}" for k in range(20))
    texts = [f"{start} {tail(i)}" for i in range(120)]
    near = {f"{t} end": t for t in texts[:40]}  # 47 of 46 shingles: over 0.8; others share 26 of 66
    got = {r.template: r.cluster for r in M.clusters(spark.createDataFrame([(t,) for t in [*texts, *near]], "template string")).collect()}
    assert got == {t: near.get(t, t) for t in [*texts, *near]}


def test_a_text_joins_all_leaders_it_is_near(spark):
    words = [f"w{i:02d}" for i in range(64)]  # 60 shingles
    a, both, b = (" ".join(words[i : i + 54]) for i in (0, 5, 10))  # 50 shingles, each 5 further: 45 of 55 near, 40 of 60 not
    got = {r.cluster for r in M.clusters(spark.createDataFrame([(a,), ("z " + both,), (b,)], "template string")).collect()}
    assert got == {min(a, b)}


def test_recall_against_all_pairs(spark):
    rnd = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(60)]
        for _ in range(10):
            ws = base[:]
            for _ in range(rnd.randint(0, 2)):
                ws[rnd.randrange(60)] = rnd.choice(vocabulary)
            texts.append(" ".join(ws))
    texts = sorted(set(texts))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    got = {r.template: r.cluster for r in M.clusters(spark.createDataFrame([(t,) for t in texts], "template string")).collect()}
    pairs = [(i, j) for i in range(0, len(texts), 4) for j in range(len(texts)) if i != j and len(sets[i] & sets[j]) >= M.SIMILARITY * len(sets[i] | sets[j])]
    met = sum(got[texts[i]] == got[texts[j]] for i, j in pairs)
    assert len(pairs) > 100 and met >= 0.99 * len(pairs)


def shingle_sets(texts):
    return [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def exact(texts):
    """The smallest text of the cluster of each text, from all pairs."""
    sets, label = shingle_sets(texts), {t: t for t in texts}
    near = [(texts[i], texts[j]) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            least = min(label[a], label[b])
            moved |= label[a] != least or label[b] != least
            label[a] = label[b] = least
    return label, near


def chains(n, steps):
    """Chains of texts, each near the next one and not the one after it."""
    out = []
    for k in range(n):
        words = [f"c{k}w{i}" for i in range(54 + 5 * steps)]  # windows of 50 shingles, each 5 further
        out += [" ".join(words[5 * i : 5 * i + 54]) for i in range(steps + 1)]
    return out


def test_near_texts_that_follow_different_leaders_meet(spark, monkeypatch):
    monkeypatch.setattr(M, "BANDS", 1)
    monkeypatch.setattr(M, "ROWS", 0)  # all texts in one bucket
    monkeypatch.setattr(M, "BLOCK", 4)
    texts = chains(12, 7)
    want, near = exact(texts)
    assert len(near) == 12 * 7 and len(set(want.values())) == 12
    got = {r.template: r.cluster for r in M.clusters(spark.createDataFrame([(t,) for t in texts], "template string")).collect()}
    assert got == want


def test_near_texts_that_agree_in_no_band_meet(spark, monkeypatch):
    monkeypatch.setattr(M, "BANDS", 1)
    monkeypatch.setattr(M, "ROWS", 60)  # only equal sets of shingles are sure to agree
    monkeypatch.setattr(M, "BLOCK", 5)
    start = " ".join(f"w{i}" for i in range(80))
    rnd = random.Random(7)
    texts = chains(4, 5) + [f"{start} {' '.join(f'{i}t{k}' for k in range(rnd.randint(3, 16)))}" for i in range(60)] + ["a", "a b c d e", "a b c d f"]
    want, near = exact(texts)
    assert len(near) > 100
    got = {r.template: r.cluster for r in M.clusters(spark.createDataFrame([(t,) for t in texts], "template string")).collect()}
    assert got == want
