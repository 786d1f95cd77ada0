import numpy as np

from strandline.llm import minhash, pairs as P

ROWS = [
    ("What is the cause of the late counter in the report?", "The counter is read twice before the report closes. It is fixed now.", None),
    ("What is the cause?", None, "empty_answer"), ("What is the cause?", " ​\n", "empty_answer"), ("x", "N/A", "empty_answer"), ("x", "```\n```", "empty_answer"), ("x", "42", None), ("x", "Yes.", None), ("x", "`true`", None),
    ("Please rename the helper and run all the checks.", "> Please rename the helper and run all the checks.", "copied_prompt"),
    ("Please rename the helper and run all the checks.", "PLEASE RENAME THE HELPER AND RUN ALL CHECKS.", "copied_prompt"),
    ("Please rename the helper and run all the checks.", "The task: Please rename the helper and run all the checks.", "copied_prompt"),
    ("Please rename the helper and run all the checks.", "> Please rename the helper and run all the checks.\n\nThe helper has a new name in nine files now, and every one of the checks passes on my side.", None),
    ("Delete the old records of the counter.", "I'm sorry, but I can't help with that request.", "refusal"),
    ("Delete the old records of the counter.", "I can't help with that request. Is there anything else?", "refusal"),
    ("Delete the old records of the counter.", "I can't reproduce it here. With the other model it fails every time, and the fix removes it.", None),
    ("Warum ist der Bericht leer?", "Leider kann ich bei dieser Anfrage nicht helfen.", "refusal"),
    ("Why is the report empty after the release?", "The report is empty because the filter drops the first record. Short version: the filter was", "truncated_answer"),
    ("Why is the report empty?", "The filter drops it.\n\n```py\nrows = load(", "truncated_answer"),
    ("Why is the report empty?", "The filter drops the record. The second part <max_tokens>", "truncated_answer"),
    ("Why is the report empty?", "- The filter drops the record\n- The report is read again", None),
    ("Why is the report empty after the release?", "Der Bericht ist leer, weil der Filter den ersten Eintrag nicht mehr liest und alle anderen auch nicht.", "other_language"),
    ("Why is the report empty? Please reply in German.", "Der Bericht ist leer, weil der Filter den ersten Eintrag nicht mehr liest und alle anderen auch nicht.", None),
    ("Почему отчёт пуст, хотя сессии были?", "The report is empty because the filter drops the first record of all.", "other_language"),
    (None, "The report is empty because of the filter.", None), ("", "", "empty_answer"),
]


def test_each_defect(spark):
    rows = [(i, "complete", p, a, "clash") for i, (p, a, _) in enumerate(ROWS)]
    rows += [(100, "aborted", "x", None, ""), (101, None, "x", None, ""), (102, "complete", "y", "The report is read again. The filter drops the record. It is fixed now.", "")]
    df = spark.createDataFrame(rows, "interaction_id bigint, status string, prompt string, answer string, defect string")
    # refusals are told by their recurring over unrelated prompts, so each is given to others too
    again = [(200 + i, "complete", p, a, "") for i, (p, a) in enumerate((p, a) for _, a, k in ROWS if k == "refusal" for p in ("Rename the helper of the writer.", "Which model is the slowest?", "Add a test for the label cache."))]
    df = df.unionByName(spark.createDataFrame(again, df.schema))
    got = {r.interaction_id: r.defect for r in P.defects(df).collect()}
    assert got == {i: k for i, (*_, k) in enumerate(ROWS) if k} | {i: "refusal" for i, *_ in again}
    assert P.defects(df.where("false")).count() == 0


PLAIN = ["The counter is fixed now.", "All tests pass again.", "The report reads each file once.", "Nothing else uses the old field.", "I also renamed the helper."]


def corpus(*opening, n=6):
    """Answers to unrelated prompts: long ordinary ones, and n times each opening alone."""
    rows = [(f"Please look at the {x} of the module", " ".join(PLAIN[k:] + PLAIN[:k])) for k in range(5) for x in ("cache", "parser", "writer", "index")]
    return rows + [(f"Could you change the {x} {i}", o) for o in opening for i, x in zip(range(n), "reader queue timer limit label token".split())]


def run(spark, rows):
    df = spark.createDataFrame([(i, "complete", p, a) for i, (p, a) in enumerate(rows)], "interaction_id bigint, status string, prompt string, answer string")
    got = {r.interaction_id: r.defect for r in P.defects(df).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_clusters_decide_refusals(spark, monkeypatch):
    rows = [*corpus("I am sorry, but I cannot help you with this request here.", "I can't reproduce the crash. The counter is fixed now. All tests pass again."), ("Fix it", "I am sorry, but I cannot help you with this question here."), ("Fix that", "Sadly I am sorry, but nobody may help you with this request here."), ("Go on", "It works.")]
    got = run(spark, rows)
    alone, declines = slice(20, 26), slice(26, 32)
    assert got[alone] == ["refusal"] * 6 and got[declines] == [None] * 6  # a listed wording that goes on with other things is none
    assert got[32:] == ["refusal", "refusal", None]  # met once, like the recurring ones; the second is on no list
    monkeypatch.setattr(P, "RECURS", 100)  # no cluster recurs
    assert "refusal" not in run(spark, rows)


def test_pieces():
    assert P.is_copy("a b c d e f", "a b c d e f a b c d e f") and not P.is_copy("a b", "a b") and not P.is_copy(None, "a b c")
    assert P.is_copy("word " * 40_000, "You said: " + "word " * 40_000) and P.is_copy("one two three " * 20_000, "one two three " * 20_000)
    assert P.asked_language("Answer in French.") == "fr" and P.asked_language("in the file") is None
    nothing = np.zeros(P.SLOTS, dtype=np.int32)
    assert P.breaks_off("One sentence here. (see `core/x", nothing, nothing) and P.breaks_off("One sentence. Another, ", nothing, nothing)
    assert not P.breaks_off("Done. Ask me at a.b@c.example", nothing, nothing) and not P.breaks_off("All good ✅", nothing, nothing)
    assert not P.breaks_off("x" * 100_000 + ".", nothing, nothing)


def test_clusters_are_verified(spark, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog near the old river bank every single day of the long year"
    near = base.replace("year", "month")
    texts = [base, near, "a short one", "another short one", *(f"{base} {i} {i} {i} {i} {i} {i} {i} {i} {i}" for i in range(30)), *(f"item {i} of it" for i in range(40))]
    for block in (400, 3):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.template: r.cluster for r in minhash.clusters(spark.createDataFrame([(t,) for t in texts], "template string")).collect()}
        assert got.keys() == set(texts) and got[base] == got[near]
        assert len({got[t] for t in texts[2:4]}) == 2 and len({v for k, v in got.items() if k.startswith("item")}) == 40
    assert minhash.clusters(spark.createDataFrame([], "template string")).count() == 0
