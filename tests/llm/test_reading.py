import random

from strandline.llm import reading as R
from strandline.llm.text import language, prose, sentences

BASIC = ["The {n} is {a} and the {n} is {a}.", "We saw a {a} {n} at the end.", "Put the {n} in the box and close it.", "Why is the {n} so {a}?"]
MIDDLE = ["After several attempts the team decided to move the {n} into a separate file that every worker can read.", "The table lists the {n} for each model and explains which values were left out.", "If a worker stops without an answer, the {n} marks the task as {a} and continues with the next file."]
HIGH = ["Notwithstanding its apparent simplicity, the {n} remains methodologically indispensable, because any retrospective aggregation inherently accommodates heterogeneity that it purports to evaluate.", "Insofar as epistemic limitation undermines the {n}, practitioners must acknowledge that conventional longitudinal decomposition is operationally consequential and occasionally misleading."]
CODE = "```py\nfor x in rows:\n    print(x)\n```\n| a | 1 | 2.5 % | ok |\n12ms INFO com.x.loadFactory state=ok total=5\nat internal.x.load(core/a.py:3)\n"


def make(rnd, pool, n):
    return " ".join(rnd.choice(pool).format(n=rnd.choice(["log", "note", "counter"]), a=rnd.choice(["old", "late", "small"])) for _ in range(n))


def test_held_out_accuracy_with_wrong_ratings(spark):
    rnd = random.Random(5)
    docs, truth = [], {}
    for i in range(300):
        k = i % 3
        truth[i] = R.LEVELS[k]
        docs.append((i, make(rnd, (BASIC, MIDDLE, HIGH)[k], rnd.randint(8, 14)) + "\n\n" + CODE * (i % 2), "clash"))
    rated = [(i, truth[i] if i % 10 else R.LEVELS[(i // 10) % 3], "r") for i in range(90)] + [(0, None, "r"), (1, "odd", "r"), (9999, "basic", "r")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, x string")
    labels = spark.createDataFrame(rated, "doc_id bigint, reading_level string, rater string")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(d, labels).collect()}
    assert got.keys() == truth.keys()
    assert sum(got[i] == truth[i] for i in range(90, 300)) >= 205
    assert R.reading_levels(d, labels.where("false")).count() == 0 and R.reading_levels(d.where("false"), labels).count() == 0


def test_which_documents_count(spark):
    m = R.WordMeasures(R.np.ones(R.SLOTS, dtype=R.np.float32))
    rnd = random.Random(1)
    english = make(rnd, MIDDLE, 10)
    german = "Der Bericht ist leer, weil der Filter den ersten Eintrag nicht liest. " * 8
    assert R.features(english, m) and R.features(english + "\n" + CODE * 20, m)
    for none in (None, "", " ", "Too short for a level.", CODE * 50, german, german + make(rnd, BASIC, 2), "日志已读取，没有错误。" * 50, "1 2 3 " * 100):
        assert R.features(none, m) is None
    assert R.features(english + " " + german[:70], m)
    assert abs(R.features((english + " ") * 300, m)[2] - R.features(english, m)[2]) < 1e-9  # very long texts are read whole


def test_text_measures():
    assert language("Ошибка исправлена в файле app/x.py") == ("ru", 4.0) and language("")[0] == "none" and language("日志")[0] == "other"
    assert language("La causa era que el informe está vacío")[0] == "es" and language("Toutes les vérifications passent et la sortie ne change pas")[0] == "fr"
    assert "print" not in prose("Text.\n```\nprint(1)") and prose(None) == "" and prose("a\r\nb") == "a\nb"
    assert sentences("One here. Two there?\n- three\n- four") == ["One here.", "Two there?", "- three", "- four"]
