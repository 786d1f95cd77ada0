import pytest

from strandline.llm import mixing as M
from strandline.llm import tokenizer as T

WORD = " token"


def docs(spark, **sources):
    rows = [(1000 * k + i, s, WORD * n, "clash") for k, (s, ns) in enumerate(sources.items()) for i, n in enumerate(ns)]
    rows += [(-1, None, WORD, ""), (-2, "a", None, ""), (-3, "a", "", ""), (-4, "untargeted", WORD, "")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, position string")


def targets(spark, *rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_within_repeats(spark):
    d = docs(spark, a=[3] * 400, b=[5] * 60, c=[2] * 30)
    t = targets(spark, ("a", 0.6, 1), (" B ", 0.3, 2), ("c", 0.05, 3), ("nothing", 0.05, 2))
    mixture = M.mix(d, t).cache()
    rows = mixture.collect()
    # c has 60 tokens, three times 180, at 5 of 95 parts: 3,420 tokens; a has 1,200 at 60 of 95 parts: 1,900; b 300 twice at 30 of 95: 1,900
    total = min(1200 / (0.6 / 0.95), 600 / (0.3 / 0.95), 180 / (0.05 / 0.95))
    assert abs(sum(r.n_tokens for r in rows) - total) <= 5 + 3 + 2
    for s, share, most in (("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.05, 3)):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.n_tokens for r in own) - share / 0.95 * total) <= 5 and max(getattr(r, "pass") for r in own) <= most
        uses = {}
        for r in own:
            uses[r.doc_id] = uses.get(r.doc_id, 0) + 1
        assert max(uses.values()) - min(uses.values()) <= 1 and max(uses.values()) <= most
    assert {r.doc_id for r in rows}.isdisjoint({-1, -2, -3, -4})
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1
    rep = {r.source: r for r in M.reached(mixture, t).collect()}
    assert rep["nothing"].tokens == 0 and abs(rep["a"].reached_share - 0.6 / 0.95) < 0.01 and rep["c"].most_uses <= 3


def test_positions_follow_the_schedule(spark):
    d = docs(spark, a=[1] * 1000, b=[1] * 1000)
    t = targets(spark, ("a", 0.5, 1), ("b", 0.5, 1))
    plan = {"a": [(0.0, 1.0), (0.5, 0.5), (1.0, 0.0)], "b": [(0.0, 0.0), (1.0, 1.0)]}
    rows = M.mix(d, t, schedule=plan).collect()
    for lo, hi in ((0.0, 0.25), (0.25, 0.5), (0.5, 1.0)):
        n = sum(r.source == "a" and lo <= r.position < hi for r in rows)
        area = (hi - hi * hi / 2) - (lo - lo * lo / 2)
        assert abs(n - 2000 * area) <= 2
    b = sorted(r.position for r in rows if r.source == "b")
    assert all(abs(p - ((k + 0.5) / 1000) ** 0.5) < 1e-9 for k, p in enumerate(b))


def test_buckets_do_not_change_the_mixture(spark, monkeypatch):
    d, t = docs(spark, a=[1, 2, 3] * 50), targets(spark, ("a", 1.0, 2))
    one = sum(r.n_tokens for r in M.mix(d, t).collect())
    monkeypatch.setattr(M, "BUCKET", 7)
    rows = M.mix(d, t).collect()
    assert sum(r.n_tokens for r in rows) == one == 600 and len({(r.doc_id, getattr(r, "pass")) for r in rows}) == 300
    spans = sorted((r.position * 600 - r.n_tokens / 2, r.n_tokens) for r in rows)
    assert all(abs(a + n - b) < 1e-6 for (a, n), (b, _) in zip(spans, spans[1:]))  # no gap and no overlap


def test_larger_total_and_schedule_of_shares(spark):
    d, t = docs(spark, a=[1] * 100, b=[1] * 10), targets(spark, ("a", 0.5, 1), ("b", 0.5, 2))
    rows = M.mix(d, t, total_tokens=200).collect()
    assert sum(r.source == "a" for r in rows) == 100 and sum(r.source == "b" for r in rows) == 20
    for shares in ({"a": 1.0}, {"a": 0.99, "b": 0.01}, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}):
        s = M.default_schedule(shares)
        assert all(min(w for _, w in s[k]) >= -1e-12 and abs(sum(w for _, w in s[k]) / 2 - shares[k]) < 1e-12 for k in shares)
        assert all(abs(sum(s[k][i][1] for k in shares) - 1) < 1e-12 for i in (0, 1))


def test_empty(spark):
    d, t = docs(spark), targets(spark, ("zzz", 1.0, 1))
    assert M.mix(d, t).count() == 0 and [r.tokens for r in M.reached(M.mix(d.where("false"), t), t).collect()] == [0]
    assert T.vocabulary_path("x").endswith("x")
    with pytest.raises(FileNotFoundError):
        M.token_counts(d, path="/nowhere")


def test_spellings_of_a_source(spark):
    d = docs(spark, **{"agent_answers": [4] * 5, "agent-answers": [4] * 5, " Agent  Answers": [4] * 5, "b": [4] * 15})
    t = targets(spark, ("agent_answers", 0.5, 1), ("b", 0.5, 1))
    rows = M.mix(d, t).collect()
    assert sorted(r.source for r in rows) == ["agent_answers"] * 15 + ["b"] * 15
