from strandline.llm import pii as P

NAMES = ["Ida Berg", "Olaf Lind", "Rosa Kuhn"]


def corpus():
    rows = []
    for i in range(60):
        n = NAMES[i % 3]
        rows += [f"Signed-off-by: {n} <{n.split()[0].lower()}{i}@mail.example>", f"According to {n} the job ran twice.", f"The job ran {i} times. The Blue Harbor team saw it."]
    return rows


CASES = [
    ("Send it to ida.berg+x@mail.example now.", [("email", "ida.berg+x@mail.example")]),
    ("mail <OLAF@MAIL.EXAMPLE.ORG>, or mailto:a-b@c.example", [("email", "OLAF@MAIL.EXAMPLE.ORG"), ("email", "a-b@c.example")]),
    ("write to ida [at] mail.example or olaf dot lind at mail dot example today", [("email", "ida [at] mail.example"), ("email", "olaf dot lind at mail dot example")]),
    ("copy to deploy@build-07:/srv, pin core@2.80.1, use @retry", []),
    ("Call me at +49 30 23125 115 or (436) 555-0144; text 07700 900178.", [("phone", "+49 30 23125 115"), ("phone", "(436) 555-0144"), ("phone", "07700 900178")]),
    ("phone=795.555.0156 and 555-0145 ext. 12", [("phone", "795.555.0156"), ("phone", "555-0145 ext. 12")]),
    ("Epoch 1741936275, part number 4417-11, range 10.0.85.0, session 20250136-394956, call scan with 231 93 355.", []),
    ("SSN 977-63-5547, passport QQ 87 75 57 B, tax id HY8564066.", [("id_number", "977-63-5547"), ("id_number", "QQ 87 75 57 B"), ("id_number", "HY8564066")]),
    ("Ship it to Flat 30, 170 Thistle Road, Ashcombe.", [("address", "Flat 30, 170 Thistle Road, Ashcombe")]),
    ("Deliver to: P.O. Box 77, Northwick or Birkenweg 156, 92653 Lowmarsh", [("address", "P.O. Box 77, Northwick"), ("address", "Birkenweg 156, 92653 Lowmarsh")]),
    ("A 5 way merge needs 113 lanes. Line 42 Street parser fails. ул. Лесная, д. 79, кв. 184", [("address", "ул. Лесная, д. 79, кв. 184")]),
    ("Dr. Ida Berg met O. Lind; see Kuhn, Rosa. Reach Olaf Lind on Monday.", [("name", "Ida Berg"), ("name", "O. Lind"), ("name", "Kuhn, Rosa"), ("name", "Olaf Lind")]),
    ("Reviewed by the Blue Harbor team. Run 290 Round Robin, then 288 Warm Start.", []),
    ("name=ida berg phone=+1 884 555 0150", [("name", "ida berg"), ("phone", "+1 884 555 0150")]),
]


def model(spark):
    rows = [("f", str(i), t) for i, t in enumerate(corpus())]
    return P._model(spark.createDataFrame(rows, "field string, row_key string, text string"))


def test_kinds_and_positions(spark):
    stats, weights = model(spark)
    for text, want in CASES:
        got = [(m.kind, text[m.start : m.end]) for m in P.personal(text, stats, weights)]
        assert got == want, text
    wide = "😀🧪 é " + CASES[0][0]
    assert P.personal(wide, stats, weights)[0].start == 5 + CASES[0][0].index("ida")
    text = CASES[8][0]
    assert P.redact(text, P.personal(text, stats, weights)) == "Ship it to [ADDRESS]."
    assert P.redact(None, []) is None and P.personal(None, stats, weights) == [] and P.personal("", stats, weights) == []
    assert P.personal("word " * 30_000, stats, weights) == []


def test_contexts_are_learned_from_the_corpus(spark):
    """Sentences that no list holds: around known names they announce unknown ones, around known things they do not."""
    names = ["Ida Berg", "Olaf Lind", "Rosa Kuhn", "Timo Falk", "Vera Holm", "Nils Brandt"]
    things = ["Blue Harbor", "Copper Ridge", "Warm Start", "Round Robin"]
    rows = [f"Signed-off-by: {names[i % 6]}" for i in range(120)] + [f"Yesterday evening we had dinner alongside {names[i % 6]} downtown." for i in range(120)]
    rows += [f"Later {names[i % 6]} and {names[(i + 1) % 6]} wrote; {names[i % 6]} left." for i in range(60)]
    rows += [f"They finally rebooted {things[i % 4]} overnight." for i in range(120)] + [f"The {things[i % 4]} team knows." for i in range(40)]
    stats, fitted = P._model(spark.createDataFrame([("f", str(i), t) for i, t in enumerate(rows)], "field string, row_key string, text string"))
    found = lambda t: [(m.kind, t[m.start : m.end]) for m in P.personal(t, stats, fitted)]
    for n in ("Tomasz Wojcik", "Anneliese Okafor", "Kenji Watanabe"):  # none is in the corpus
        assert found(f"Yesterday evening we had dinner alongside {n} downtown.") == [("name", n)]
        assert found(f"They finally rebooted {n} overnight.") == []
    blind = P.Model(fitted.node, fitted.context * 0)
    t = "Yesterday evening we had dinner alongside Kenji Watanabe downtown."
    nodes = P.mentions(t, stats)
    assert P.marginals(nodes, blind)[0] < P.marginals(nodes, fitted)[0] - 0.2
    assert (fitted.near, fitted.same) != (P.NEAR, P.SAME)  # fitted with the nodes


def test_overlapping_mentions_exclude_each_other():
    x = lambda b: [b, *[0.0] * (len(P.FEATURES) - 1)]
    w = {"name": P.np.array(x(1.0))}
    a, b = P.Mention("name", 0, 9, x(1.0), frozenset(["a"])), P.Mention("name", 5, 14, x(3.0), frozenset(["b"]))
    p = P.marginals([a, b], w)
    assert p[0] < 0.5 < p[1] and P.marginals([a], w)[0] > 0.5


def test_long_texts_grow_linearly(spark):
    import time

    stats, fitted = model(spark)
    text = lambda n: " ".join(f"Mail ida.berg{i}@mail.example or Ida Berg, +49 30 2312{i % 10} 115, 12 Thistle Road, Ashcombe." for i in range(n))
    took = []
    for n in (300, 1200):
        began = time.perf_counter()
        assert len(P.personal(text(n), stats, fitted)) >= 3 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 7 * took[0]


def test_skip_edges_carry_evidence():
    sure, unsure = [0.0] * len(P.FEATURES), [0.0] * len(P.FEATURES)
    sure[0] = unsure[0] = 1.0
    w = {"name": P.np.zeros(len(P.FEATURES))}
    w["name"][1] = 4.0
    sure[1], unsure[1] = 1.0, -0.2
    far = lambda x, at, *ws: P.Mention("name", at, at + 5, x, frozenset(ws))
    alone = P.marginals([far(unsure, 500, "berg")], w)[0]
    linked = P.marginals([far(sure, 0, "ida", "berg"), far(unsure, 500, "berg")], w)
    apart = P.marginals([far(sure, 0, "ida", "kuhn"), far(unsure, 500, "berg")], w)
    assert alone < 0.5 < linked[1] and apart[1] < 0.5 and linked[0] > 0.9
    ring = [far(unsure, k * 100, "berg", "ida") for k in range(50)] + [far(sure, 9000, "berg")]
    assert all(0 <= p <= 1 for p in P.marginals(ring, w))


def test_queries_over_tables(spark):
    i = spark.createDataFrame([(1, None, "write to a.b@c.example", "x"), (2, "", None, "x"), (3, "a.b@c.example a.b@c.example", "", "x")], "interaction_id bigint, prompt string, answer string, kind string")
    c = spark.createDataFrame([("c1", "call +49 30 23125 115"), ("c2", None)], "case_id string, followup_prompt string")
    texts = P.text_fields(i, c)
    assert {tuple(r) for r in P.find(texts).collect()} == {("interactions.answer", "1", "email", 9), ("interactions.prompt", "3", "email", 0), ("interactions.prompt", "3", "email", 14), ("cases.followup_prompt", "c1", "phone", 5)}
    assert {r.text for r in P.redacted(texts).collect()} == {"write to [EMAIL]", "[EMAIL] [EMAIL]", "call [PHONE]"}
    assert P.find(texts.where("false")).count() == 0
