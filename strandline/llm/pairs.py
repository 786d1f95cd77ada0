"""Broken prompt and response pairs.

Each answer is read once: its sentences as templates (names, numbers and paths masked), whether it has any
content, repeats the prompt, breaks off, or is in another language. The openings of all answers are clustered
by verified MinHash. A cluster that recurs over unrelated prompts, stands alone in its answers and mostly declines
in wording is a refusal template; the other recurring clusters, and what long answers say, are the counterexamples.
The words of both sides judge the openings that do not recur, so the wordlist only points at clusters, and
without clusters nothing is a refusal. Sentences that follow refusals and hardly anything else are their closing
phrases. An answer made of nothing but these is a refusal.
"""

from __future__ import annotations

import difflib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.minhash import clusters
from strandline.llm.text import language, words
from strandline.session import cut, spread

#: Size of the hashed table of word pairs at sentence ends and elsewhere.
SLOTS = 1 << 20
#: Share of the answer's words that come from the prompt in order, and of the prompt that is repeated, in a copy.
COPIED, REPEATED = 0.8, 0.6
#: Words of a frame around a whole prompt that add nothing, as in "You asked the following:".
FRAME = 6
#: Share of a closing phrase's uses that follow a refusal.
CLOSING = 0.8
#: A last word pair that ends a sentence in less than this share of its uses shows that the text breaks off.
ENDS = 0.1
#: Prompt templates that a cluster of openings answers, from which on it recurs over unrelated prompts.
RECURS = 2
#: Sentences, courtesies aside, from which on an answer is long.
LONG = 4
#: Size of the hashed table of words and word pairs of openings; weight of the wordlist; score from which on an opening that does not recur refuses.
WORDING, LISTED, THRESHOLD = 1 << 17, 2.0, 3.0
#: Words an answer needs to be judged by its language.
LANGUAGE_WORDS = 5

#: Texts that stand for an absent answer (fixed values).
PLACEHOLDERS = frozenset("none null nil n/a na nan empty undefined blank void".split()) | {"no answer", "no output", "no response", "no content", "no reply", "not available", "keine antwort", "sin respuesta", "pas de réponse", "нет ответа"}
#: Wordings by which an answerer declines, by language (fixed values).
DECLINES = re.compile(
    "|".join(
        (
            r"\bI(?:['’]m| am)(?: sorry,? but I(?:['’]m| am))? (?:unable|not able|not permitted|not allowed|not in a position|afraid I)\b",
            r"\bI (?:can(?:no|['’])t|can not|won['’]t|will not|must (?:decline|refuse)|have to (?:decline|refuse|stop)|decline|refuse|do not feel|don['’]t feel|may not|am forced to decline)\b",
            r"\bI(?:['’]d| would) (?:rather|prefer) not\b|\b(?:not|never) (?:be )?able to (?:assist|help|do this|comply)\b|\bsomething I(?:['’]m| am) not\b",
            r"\bcan(?:no|['’])t (?:be fulfilled|help with|assist)|\boutside what I\b|\bmust decline\b|\bagainst (?:the|my) (?:guidelines|policy|policies|rules|principles)\b|\bnot be (?:appropriate|right|possible) for me\b|\bbeyond what I\b",
            r"не могу|не буду|не имею права|не вправе|вынужден[аы]? отказать|противоречит моим|должен отказать|отказываюсь|не смогу|нельзя мне",
            r"\bkann ich\b[^.!?]*\bnicht\b|\bich kann\b[^.!?]*\bnicht\b|\bdarf ich\b[^.!?]*\bnicht\b|\bich darf\b[^.!?]*\bnicht\b|\bmuss ich\b[^.!?]*\bablehnen\b|\bich muss\b[^.!?]*\bablehnen\b|widerspricht meinen|lehne ich\b|\bwerde ich\b[^.!?]*\bnicht\b|\bich werde\b[^.!?]*\bnicht\b",
            r"\bno (?:puedo|estoy autorizad[oa]|me está permitido|debo|voy a|podré|tengo permiso)\b|\b(?:debo|tengo que) (?:rechazar|negarme|declinar)|(?:contra|contradice) (?:de )?mis (?:normas|reglas|directrices)",
            r"\bje ne (?:peux|suis|pourrai|dois|vais)\b|\bje (?:dois|me vois)\b[^.!?]*\b(?:refuser|décliner)|contraire à mes|\bje refuse\b|\bne m['’]est pas permis",
        )
    ),
    re.I,
)
#: Wordings that only regret or thank (fixed values).
COURTESY = re.compile(r"^\W*(?:(?:I(?:['’]m| am) )?(?:so |very |really )?sorry|my apologies|apologies|unfortunately|thank(?:s| you)[^.!?]*|is there anything else[^.!?]*|please (?:ask|choose|try|contact|consult)\b[^.!?]*|let me know[^.!?]*|извините|простите|к сожалению|спасибо[^.!?]*|leider|entschuldigung|es tut mir leid|tut mir leid|danke[^.!?]*|vielen dank[^.!?]*|lo siento|lo lamento|gracias[^.!?]*|désolée?|je suis désolée?|pardon|merci[^.!?]*)\W*$", re.I)
MARKER = re.compile(r"(?:<\|?/?(?:max_tokens|truncated|cut|endoftext|eos)\|?>|[\[(]\s*(?:…|\.\.\.)?\s*(?:cut(?: off)?|truncated|output (?:limit|truncated)[^\])]*|max[_ ]?tokens?[^\])]*|limit reached|continues?|length)\s*[\])])\s*$", re.I)
ASKED = re.compile(r"\b(?:in|into|to|auf|en|на)\s+(english|german|spanish|french|russian|englisch|deutsch|spanisch|französisch|russisch|inglés|alemán|español|francés|ruso|anglais|allemand|espagnol|français|russe|английск\w+|немецк\w+|испанск\w+|французск\w+|русск\w+)\b", re.I)
_ASKED = {"en": "english englisch inglés anglais английск", "de": "german deutsch alemán allemand немецк", "es": "spanish spanisch español espagnol испанск", "fr": "french französisch francés français французск", "ru": "russian russisch ruso russe русск"}
_MASKS = (
    (re.compile(r"```.*?(?:```|\Z)", re.S), " CODE. "),
    (re.compile(r"`[^`\n]*`"), "CODE"),
    (re.compile(r"\b[\w.+\-]*/[\w./\-]+\w"), "PATH"),
    (re.compile(r"\b[A-Z]{2,}-\d+\b"), "TICKET"),
    (re.compile(r"--[a-z][\w-]*"), "FLAG"),
    (re.compile(r"\b(?=\w*\d)(?=\w*[a-f])[0-9a-f]{6,}\b"), "HASH"),
    (re.compile(r"\b[a-z]+(?:[A-Z]\w*|_\w+)"), "NAME"),
    (re.compile(r"\d+(?:[.,]\d+)*"), "0"),
)
_BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+")
_END = re.compile(r"[.!?…。]['\"”»’)\]*_]*$|[^\w\s,;:(\[{<>*\-–—/\\=+&@#%$`'\"”’|]$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n+")
_PERSONAL = re.compile(r"@|\bdot\b|\w=|\||;|//|\btel:|\bcc\b|[\[({]at[\])}]|(?:\d[ ()\-./]*){7}|:\s*\S+$", re.I)


def mask(text: str) -> str:
    for pattern, name in _MASKS:
        text = pattern.sub(name, text)
    return text


def templates(text: str) -> list[str]:
    """The sentences of a text with names, numbers, paths and code masked, in lower case and without punctuation; code is no sentence."""
    out = []
    for s in _SPLIT.split(mask(text)):
        ws = re.findall(r"[^\W_]+", s.lower())
        if ws and ws != ["code"]:
            out.append(" ".join(ws))
    return out


def is_empty(answer: str | None) -> bool:
    """True for null and for answers without content: blanks, marks, an empty code block, or a word that stands for nothing."""
    if not answer:
        return True
    inner = re.sub(r"^\W+|\W+$", "", re.sub(r"```\w*", " ", answer).replace("_", " ")).lower()
    return not inner and not re.search(r"[✅✔👍]", answer) or inner in PLACEHOLDERS


def is_copy(prompt: str | None, answer: str) -> bool:
    """True if the answer is in order made of the prompt's words, once or more, with at most a frame around them."""
    p, a = (re.findall(r"\w+", x.lower()) for x in (prompt or "", answer))
    if len(p) < 3 or len(a) < 3:
        return False
    shared = sum((Counter(a) & Counter({w: n * (1 + len(a) // len(p)) for w, n in Counter(p).items()})).values())
    if shared < COPIED * (len(a) - FRAME):
        return False
    times = max(1, round(len(a) / len(p)))
    if a == p * times or times == 1 and len(a) - len(p) <= FRAME and f" {' '.join(p)} " in f" {' '.join(a)} ":
        return True  # a whole copy needs no alignment, however long it is
    blocks = difflib.SequenceMatcher(None, p * times, a, autojunk=False).get_matching_blocks()
    kept = sum(b.size for b in blocks)
    frame = len(a) - kept
    return kept >= REPEATED * len(p) * times and (frame <= (1 - COPIED) * len(a) or times == 1 and frame <= FRAME and kept >= 0.9 * len(p))


def asked_language(prompt: str) -> str | None:
    m = None
    for m in ASKED.finditer(prompt):
        pass
    return next((k for k, v in _ASKED.items() if m and any(m[1].lower().startswith(x) for x in v.split())), None)


def is_other_language(prompt: str | None, answer: str) -> bool:
    """True if the answer has words enough to tell and they are neither in the prompt's language nor in the one it asks for."""
    if len(words(answer)) < LANGUAGE_WORDS or not prompt:
        return False
    want, got = language(prompt), language(answer)
    asked = asked_language(prompt)
    known = want[0] not in ("none", "other") and want[1] >= 2
    return got[0] not in ("none", "other", want[0], asked) and got[1] >= 2 and (known or asked is not None)


def slot(a: str, b: str) -> int:
    return zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) % SLOTS


def _last_words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", mask(s).lower())


def pair_counts(text: str) -> tuple[list[int], list[int]]:
    """(ends, inner): slots of the word pairs and triples that end finished sentences and list items, and of all others."""
    ends, inner = [], []
    lines = text.split("\n")
    for n, line in enumerate(lines):
        parts = [x for x in re.split(r"(?<=[.!?…])\s+", line) if x.strip()]
        for k, s in enumerate(parts):
            ws = _last_words(s)
            pairs = [slot(a, b) for a, b in zip(ws, ws[1:])]
            threes = [slot(a, f"{b} {c}") for a, b, c in zip(ws, ws[1:], ws[2:])]
            whole = bool(_END.search(s.rstrip())) or k == len(parts) - 1 and n < len(lines) - 1 and bool(_BULLET.match(line))
            if pairs:
                inner += pairs[:-1] + threes[:-1]
                if whole:
                    ends += pairs[-1:] + threes[-1:]
    return ends, inner


def breaks_off(answer: str, ends: np.ndarray, inner: np.ndarray) -> bool:
    """True if the answer stops before its end: an open code block, bracket or quote, a mark of cutting, or a last word pair that does not end sentences."""
    text = answer.rstrip()
    if MARKER.search(text) or text.count("```") % 2:
        return True
    if text.endswith("```"):
        return False
    line = text.split("\n")[-1]
    segment = re.split(r"(?<=\S[.!?…])\s+", line)[-1]
    before = text[: len(text) - len(segment)].strip()
    if segment.count("`") % 2 or line.count("**") % 2 or segment.rfind("(") > segment.rfind(")"):
        return True
    bare = _BULLET.sub("", line if _BULLET.match(line) and segment in line[-len(segment) :] and not before.endswith((".", "!", "?")) else segment).strip("*_ ")
    if before and not re.search(r"[^\W_]", re.sub(r"^\d+[.)]\s*", "", bare)) and re.match(r"\s*(?:\d+[.)]|[-*•])", line):
        return True
    if _END.search(text):
        return False
    if re.search(r"[,;:(\[{\-–—/\\=+&]$", text) and before:
        return True
    ws = _last_words(bare)
    if not ws or re.fullmatch(r"\S*/\S+\.\w{1,5}", bare) or _PERSONAL.search(bare) or not before and len(ws) <= 5:
        return False
    last = re.findall(r"\w+", bare)[-1]
    if re.search(r"\b[^\W\d_a-zа-я]\w*[ ,]+(?:\d{5,}|[^\W\d_a-zа-я]\w+)$", bare):
        return False  # a place with its code, or a name
    if last[0].isupper() and (re.search(r"\d", bare) or re.search(r",\s*\w+$", bare)):
        return False
    if len(ws) == 1:
        return last.islower() or language(last)[0] != "none"
    e = i = 0
    for k in (*([slot(ws[-3], f"{ws[-2]} {ws[-1]}")] if len(ws) > 2 else []), slot(ws[-2], ws[-1])):
        if not e + i:
            e, i = int(ends[k]), int(inner[k])
    return e < ENDS * (e + i) if e + i else last.islower() and last.isalpha()


def _end_table(interactions: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of word pairs over all prompts and answers, in a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS, dtype=np.int64)
        for b in batches:
            for c in (0, 1):
                for t in b.column(c).to_pylist():
                    if t:
                        e, i = pair_counts(t)
                        np.add.at(total, e, 1)
                        np.add.at(total, np.array(i, dtype=np.int64) + SLOTS, 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    rows = spread(interactions.select("prompt", "answer")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(2 * SLOTS, dtype=np.int64)
    table[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return table[:SLOTS], table[SLOTS:]


def read_pairs(interactions: DataFrame) -> DataFrame:
    """(interaction_id, defect, sentences, declines, courteous, topic) of each complete interaction; defect is null where only the corpus can tell."""
    complete = interactions.where(F.lower(F.trim("status")) == "complete")
    ends, inner = _end_table(interactions)
    tables = interactions.sparkSession.sparkContext.broadcast((ends, inner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, inner = tables.value
        for b in batches:
            out: list[tuple] = []
            for i, p, a in zip(*(b.column(c).to_pylist() for c in range(3))):
                if is_empty(a):
                    out.append((i, "empty_answer", [], [], [], ""))
                    continue
                if is_copy(p, a):
                    out.append((i, "copied_prompt", [], [], [], ""))
                    continue
                late = "truncated_answer" if breaks_off(a, ends, inner) else "other_language" if is_other_language(p, a) else None
                raw = [s for s in _SPLIT.split(a) if re.search(r"[^\W_]", s)]
                short = [(templates(s) or [""])[0] for s in raw]
                topic = (templates(p or "") or [""])[0]
                out.append((i, late, short, [bool(DECLINES.search(s)) for s in raw], [bool(COURTESY.match(s)) for s in raw], topic))
            cols = [*zip(*out)] or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["interaction_id", "defect", "sentences", "declines", "courteous", "topic"])

    return spread(complete.select("interaction_id", "prompt", "answer")).mapInArrow(run, "interaction_id bigint, defect string, sentences array<string>, declines array<boolean>, courteous array<boolean>, topic string")


def _opening_uses(read: DataFrame) -> DataFrame:
    """(template, topic, n, d, alone): the openings by the prompts they answer; n answers, of which d decline in wording and alone say nothing else but courtesies."""
    spoken = read.where(F.size("sentences") > 0)
    first = F.when(F.element_at("courteous", 1) & (F.size("sentences") > 1), 2).otherwise(1)
    rest = F.size("sentences") - F.size(F.filter("courteous", lambda x: x))
    opening = spoken.withColumn("k", first).select(F.expr("element_at(sentences, k)").alias("template"), F.expr("element_at(declines, k)").alias("declines"), (rest <= 1).alias("alone"), "topic")
    return opening.groupBy("template", "topic").agg(F.count("*").alias("n"), F.count_if("declines").alias("d"), F.count_if("alone").alias("alone"))


def opening_clusters(read: DataFrame) -> DataFrame:
    """(template, cluster, answers, prompts, d, alone): every opening with the counts of its MinHash cluster; ``prompts`` are the different prompt templates it answers."""
    uses = cut(_opening_uses(read))
    named = uses.join(clusters(uses.select("template").distinct()), "template")
    judged = named.groupBy("cluster").agg(F.sum("n").alias("answers"), F.sum("d").alias("d"), F.sum("alone").alias("alone"), F.count_distinct("topic").alias("prompts"))
    return named.select("template", "cluster").distinct().join(judged, "cluster").select("template", "cluster", "answers", "prompts", "d", "alone")


def verdict() -> Column:
    """What a cluster of openings shows: ``refusal`` if it recurs over unrelated prompts, stands alone in most of its answers and mostly declines, ``other`` if it recurs without that, null if it does not recur."""
    recurs = F.col("prompts") >= RECURS
    return F.when(recurs & (2 * F.col("d") > F.col("answers")) & (2 * F.col("alone") > F.col("answers")), "refusal").when(recurs, "other")


def refusal_templates(read: DataFrame) -> DataFrame:
    """(template, cluster, prompts, answers): the openings whose cluster recurs over unrelated prompts, stands alone and declines."""
    return opening_clusters(read).where(verdict() == "refusal").select("template", "cluster", "prompts", "answers")


def wording(template: str) -> list[int]:
    """Slots of the words and word pairs of a template."""
    ws = ["^", *template.split(" "), "$"]
    return [*{zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) % WORDING for a, b in zip(ws, ws[1:])} | {zlib.crc32(w.encode("utf-8", "replace")) % WORDING for w in ws[1:-1]}]


def wording_weights(judged: DataFrame) -> np.ndarray:
    """Log odds of words and word pairs between the templates of refusal clusters and those of the other recurring ones, from (template, verdict). Counts of all of them, in a table of fixed size; zero without either."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * WORDING + 2, dtype=np.int64)
        for b in batches:
            for t, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                side = int(v == "refusal")
                total[2 * WORDING + side] += 1
                for k in wording(t):
                    total[side * WORDING + k] += 1
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["slot", "n"])

    rows = judged.select("template", "verdict").where("verdict is not null").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(2 * WORDING + 2)
    table[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    others, refusals = table[-2], table[-1]
    if not refusals:
        return np.zeros(WORDING, dtype=np.float32)
    # smoothed in proportion to both sides, so that what is met once says little
    weights = np.log((table[WORDING : 2 * WORDING] + 0.5) / refusals) - np.log((table[:WORDING] + 0.5 * max(1.0, others / refusals)) / max(1.0, others))
    weights[(table[:WORDING] + table[WORDING : 2 * WORDING]) == 0] = 0.0
    return weights.astype(np.float32)


def refusing_templates(read: DataFrame) -> DataFrame:
    """(template): the sentences that refuse: those of refusal clusters, and those that their wording shows to be like these and unlike the other recurring openings.

    Sentences of long answers are examples of the others too, as who refuses says little else. That a sentence
    declines by the wordlist is one feature beside its words and word pairs; by itself it does not suffice.
    """
    judged = cut(opening_clusters(read).select("template", "cluster", verdict().alias("verdict")))
    said = F.size("sentences") - F.size(F.filter("courteous", lambda x: x))
    parts = read.where(F.size("sentences") > 0).select((said >= LONG).alias("long"), F.explode(F.arrays_zip("sentences", "declines")).alias("x"))
    distinct = cut(parts.groupBy(F.col("x.sentences").alias("template")).agg(F.count_if("x.declines").alias("d"), F.count("*").alias("n"), F.max("long").alias("long")))
    plain = distinct.where("long").join(judged, "template", "left_anti").select("template", F.lit("other").alias("verdict"))
    weights = wording_weights(judged.select("template", "verdict").unionByName(plain))
    if not weights.any():
        return judged.where("false").select("template")
    model = read.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            ts, ds, ns = (b.column(k).to_pylist() for k in range(3))
            xs = [float(w[wording(t)].sum()) + (LISTED if 2 * d > n else -LISTED) for t, d, n in zip(ts, ds, ns)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(xs, pa.float64())], names=["template", "score"])

    scored = distinct.select("template", "d", "n").mapInArrow(score, "template string, score double").join(judged, "template", "left")
    # the members of a cluster are judged as one, by the mean of their scores
    mean = scored.where("cluster is not null").groupBy("cluster").agg(F.avg("score").alias("mean"))
    whole = scored.join(mean, "cluster", "left")
    keep = F.when(F.col("verdict") == "refusal", True).when(F.col("verdict") == "other", False).otherwise(F.coalesce("mean", "score") > THRESHOLD)
    return whole.where(keep).select("template").distinct()


def defects(interactions: DataFrame) -> DataFrame:
    """(interaction_id, defect) of each complete interaction with a defective answer.

    Of several defects the first counts in the order empty_answer, copied_prompt, refusal, truncated_answer,
    other_language. Null and blank prompts allow empty, truncated and refusing answers only.
    """
    read = cut(read_pairs(interactions))
    refusing = cut(refusing_templates(read).withColumn("refusing", F.lit(True)))
    parts = read.where(F.size("sentences") > 0).select("interaction_id", F.explode(F.arrays_zip("sentences", "courteous")).alias("x"))
    parts = parts.select("interaction_id", F.col("x.sentences").alias("template"), "x.courteous").join(refusing, "template", "left")
    parts = cut(parts.select("interaction_id", "template", "courteous", F.coalesce("refusing", F.lit(False)).alias("refusing")))
    refuser = parts.where("refusing").select("interaction_id").distinct().withColumn("refuser", F.lit(True))
    follow = parts.where("not refusing").join(refuser, "interaction_id", "left").groupBy("template").agg(F.count("*").alias("n"), F.count_if("refuser").alias("r"))
    closing = follow.where((F.col("r") >= 2) & (F.col("r") >= CLOSING * F.col("n"))).select("template", F.lit(True).alias("closing"))
    plain = parts.join(closing, "template", "left").groupBy("interaction_id").agg(F.max("refusing").alias("some"), F.min(F.col("refusing") | F.col("courteous") | F.coalesce("closing", F.lit(False))).alias("only"))
    refusals = plain.where("some and only").select("interaction_id", F.lit("refusal").alias("refusal"))
    out = read.select("interaction_id", "defect").join(refusals, "interaction_id", "left")
    return out.select("interaction_id", F.when(F.col("defect").isin("empty_answer", "copied_prompt"), F.col("defect")).otherwise(F.coalesce("refusal", "defect")).alias("defect")).where("defect is not null")
