import random
from datetime import datetime, timedelta

from strandline.llm import conversations as C

SCHEMA = "message_id bigint, session_id string, turn_id string, role string, message string, msg_ts string, ingested_at timestamp, h string"
DAY = datetime(2025, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r[:6], r[6] if len(r) > 6 else DAY, "clash") for r in rows], SCHEMA)


def kept(spark, rows):
    return {(r.session_id, r.pos, r.message_id) for r in C.conversations(frame(spark, rows)).collect()}


def at(n, form="2025-01-01T00:00:00.{:09d}Z"):
    return form.format(n)


def brute(rows):
    spell = {s: k for k, v in C.ROLES.items() for s in v}
    out = set()
    for s in {r[1] for r in rows if r[1]}:
        seen = {}
        for i, own, turn, role, text, ts, *_ in rows:
            if own != s or not text or not text.strip():
                continue
            key = (spell.get((role or "").strip().lower()), text, int(ts.split(".")[1][:9]) if ts else None)
            seen.setdefault(key, []).append((i, turn or None))
        msgs = sorted(((k[2] if k[2] is not None else -1), min(i for i, _ in v), k[0], min((t for _, t in v if t), default=None)) for k, v in seen.items())
        talk = [m for m in msgs if m[2] in ("user", "assistant")]
        asked = {m[3] for m in msgs if m[2] == "user"}
        ok = bool(talk) and talk[0][2] == "user" and talk[-1][2] == "assistant" and not any(a[2] == b[2] == "user" for a, b in zip(talk, talk[1:]))
        ok = ok and not any(m[2] == "assistant" and m[3] and m[3] not in asked for m in msgs) and all(m[0] >= 0 and m[2] for m in msgs)
        if ok:
            out |= {(s, n + 1, m[1]) for n, m in enumerate(msgs)}
    return out


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows, n = [], 0
    for s in range(120):
        t = 0
        for k in range(rnd.randint(1, 4)):
            for role in rnd.choice([["user", "assistant"], ["User ", "tool", "model"], ["human", "ASSISTANT", "agent"], ["system", "user", "assistant"], ["user"], ["assistant"], [rnd.choice(["user", "x", None]), "assistant"]]):
                n, t = n + 1, t + rnd.choice([1, 1, 500])
                row = (n, f"s{s}", rnd.choice([f"t{k}"] * 8 + [None, "", "zz"]), role, rnd.choice(["hi", "hi", "yo", " ", None]) if rnd.random() < 0.2 else f"m{n}", at(t) if rnd.random() > 0.02 else None)
                rows.append(row)
                if rnd.random() < 0.2:
                    n += 1
                    rows.append((n, *row[1:3], row[3].upper() if row[3] else None, *row[4:]))
    rnd.shuffle(rows)
    want = brute(rows)
    assert len({s for s, *_ in want}) > 20 and kept(spark, rows) == want


def test_instants_across_hours_offsets_and_nanoseconds(spark):
    rows = [(9, "s", "t", "user", "a", "2025-01-01T01:59:59.000000001+02:00"), (5, "s", "t", "assistant", "b", "2025-01-01T00:00:00.000000001Z"), (4, "s", "t", "assistant", "c", "2025-01-01T00:00:00.000000002Z"), (3, "s", None, "user", "d", "2025-01-01T09:00:00Z"), (2, "s", None, "assistant", "e", "2025-01-01T11:00:00Z"), (7, "s", "t", "user", "a", "2024-12-31T23:59:59.000000001Z")]
    assert kept(spark, rows) == {("s", 1, 7), ("s", 2, 5), ("s", 3, 4), ("s", 4, 3), ("s", 5, 2)}
    assert kept(spark, rows[:4]) == set() and kept(spark, [*rows, (8, "s", None, "user", "f", "2025-01-01T10:00:00Z")]) == set()


def test_dirty_rows(spark):
    good = [(1, "s", "t", "user", "q", at(1)), (2, "s", "t", "assistant", "a", at(2))]
    assert len(kept(spark, good)) == 2
    for bad in [(3, "s", "other", "assistant", "x", at(3)), (3, "s", None, "alien", "x", at(3)), (3, "s", None, "tool", "x", "yesterday"), (3, "s", None, "assistant", "x", at(0))]:
        assert kept(spark, [*good, bad]) == set()
    for fine in [(3, "s", None, "assistant", "​ ﻿", None), (3, "s", None, None, None, "bad"), (3, None, None, None, "x", None), (3, "u", None, "tool", "x", at(1))]:
        assert len(kept(spark, [*good, fine])) == 2
    assert C.conversations(frame(spark, good).where("false")).count() == 0
    assert C.contigs(C.clean_messages(frame(spark, good).where("false"))).count() == 0


def test_overlapping_fragments_become_contigs(spark):
    say = lambda i, k, d: (i, "s", None, "user", f"m{k}", at(k), DAY + timedelta(days=d))
    rows = [say(1, 1, 0), say(2, 2, 0), say(3, 3, 0), say(4, 2, 1), say(5, 3, 1), say(6, 4, 1), say(7, 4, 2), say(8, 5, 2), say(9, 9, 3)]
    got = {r.fragment.day: (r.contig.day, r.overlap) for r in C.contigs(C.clean_messages(frame(spark, rows))).collect()}
    assert got == {1: (1, 0), 2: (1, 2), 3: (1, 1), 4: (4, 0)}
    inner = [say(1, 1, 0), say(2, 2, 0), say(3, 3, 0), say(4, 2, 1), say(5, 7, 1)]  # 2 is no suffix
    assert all(r.overlap == 0 for r in C.contigs(C.clean_messages(frame(spark, inner))).collect())


def test_conversations_are_laid_out_by_contigs(spark):
    say = lambda i, k, d, s="s": (i, s, None, ("assistant", "user")[k % 2], f"m{k}", at(k), d and DAY + timedelta(days=d))
    # days 1 and 2 overlap; day 3 falls inside them; day 5 follows with the days that brought its beginning later
    rows = [say(1, 1, 1), say(2, 2, 1), say(3, 3, 1), say(4, 3, 2), say(5, 4, 2), say(6, 5, 3), say(7, 6, 2), say(8, 9, 5), say(9, 10, 5), say(10, 7, 6), say(11, 8, 6), say(12, 9, 6)]
    rows += [say(20, 1, 1, "t"), say(21, 2, None, "t")]
    got = {(r.session_id, r.pos): (r.message_id, r.contig.year > 1 and r.contig.day - 1) for r in C.conversations(frame(spark, rows)).collect()}
    want = [(1, 1), (2, 1), (3, 1), (5, 1), (6, 3), (7, 1), (10, 6), (11, 6), (8, 6), (9, 6)]
    assert got == {("s", n + 1): x for n, x in enumerate(want)} | {("t", 1): (20, 1), ("t", 2): (21, False)}
    lay = {(r.session_id, r.fragment.day - 1): r.scaffold for r in C.layout(C.merge_copies(C.clean_messages(frame(spark, [r for r in rows if r[1] == "s"])))).collect()}
    assert lay == {("s", 1): 0, ("s", 2): 0, ("s", 3): 0, ("s", 5): 1, ("s", 6): 1}


def brute_contigs(fragments):
    """{fragment: contig} of one session from the sorted messages of each fragment, by suffix-prefix matches of every pair."""
    edges = set()
    for a, x in fragments.items():
        for b, y in fragments.items():
            if a != b and any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)) + 1)) and (x != y or a < b):
                edges.add((a, b))
    direct = {(a, b) for a, b in edges if not any((a, c) in edges and (c, b) in edges for c in fragments)}
    links = {b: a for a, b in direct if sum(x == a for x, _ in direct) == 1 and sum(y == b for _, y in direct) == 1}
    out = {}
    for f in fragments:
        top = f
        while top in links:
            top = links[top]
        out[f] = top
    return out


def test_contigs_and_conversations_of_random_fragments(spark):
    rnd = random.Random(11)
    rows, want, n = [], {}, 0
    for s in range(60):
        fragments = {}
        size = rnd.randint(4, 14)
        texts = [(k, at(1 + k // 2) if s % 4 == 0 else at(k)) for k in range(size)]
        for d in rnd.sample(range(1, 12), rnd.randint(2, 6)):
            lo = rnd.randrange(size)
            own = [k for k in range(lo, min(size, lo + rnd.randint(1, 6))) if rnd.random() < 0.95]
            fragments[d] = own or [lo]
        first = {}
        for d, own in sorted(fragments.items(), key=lambda _: rnd.random()):
            for k in own:
                n += 1
                first.setdefault(k, n)
                rows.append((n, f"s{s}", None, ("user", "assistant")[k % 2], f"m{k}", texts[k][1], DAY + timedelta(days=d)))
        order = {k: (texts[k][1], first[k]) for k in first}
        want |= {(f"s{s}", d): c for d, c in brute_contigs({d: sorted(own, key=order.get) for d, own in fragments.items()}).items()}
    rnd.shuffle(rows)
    got = {(r.session_id, r.fragment.day - 1): r.contig.day - 1 for r in C.contigs(C.clean_messages(frame(spark, rows))).collect()}
    assert got == want and sum(d != c for (_, d), c in want.items()) > 30
    assert kept(spark, rows) == brute(rows) and len(brute(rows)) > 50
