"""Personal information in free text: finding and replacing it.

Spans that may be an email address, phone number, identity number, address or person name become the nodes of a
conditional random field, one a text. A node's own potential is log-linear in its form, in what the whole corpus
says about its words, and in the words around it, by hashed features whose weights are learned. Neighbours in the
text are coupled, spans that overlap exclude each other, and skip edges couple mentions anywhere in the text that
share words or nearly do, so that one clear mention settles its unclear repetitions. Marginals come from loopy
message passing until the messages stand still. The weights of nodes and edges are fitted together by
pseudo-likelihood, with the labels of unclear mentions taken from the field of the round before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import FUNCTION_WORDS
from strandline.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
#: Size of a hashed table of word statistics, whatever the corpus; a count is the lesser of two tables with different hashes.
SLOTS = 1 << 19
#: Texts used at most for fitting the weights, the ones with the smallest hash of those of at most so many characters.
FIT_TEXTS, FIT_CHARS = 6_000, 20_000
#: Strength with which weights are held to their priors (node weights, context weights, couplings), prior couplings of neighbours and of mentions that share words, most rounds of messages and the change at which they stand still.
HOLD, HOLD_CONTEXT, HOLD_EDGE, NEAR, SAME, ROUNDS, STILL = 20.0, 2.0, 20.0, 0.3, 2.0, 60, 1e-3
#: Slots of the hashed words around a mention, rounds of fitting, distance in characters up to which mentions are neighbours.
CONTEXT, FIT_ROUNDS, NEARBY = 1 << 15, 2, 30

_DOT = r"(?:\.|[ \t]+\.[ \t]+|[ \t]*[\[({][ \t]*(?:dot|\.)[ \t]*[\])}][ \t]*|[ \t]+dot[ \t]+)"
_AT = r"(?:[ \t]?@[ \t]?|[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*)"
EMAIL = regex.compile(
    rf"(?<![\w.+\-/@])[A-Za-z0-9][A-Za-z0-9_%+'\-]*(?:(?:\.|[ \t]*[\[({{][ \t]*dot[ \t]*[\])}}][ \t]*|[ \t]+dot[ \t]+)[A-Za-z0-9_%+'\-]+)*{_AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{_DOT}[A-Za-z0-9][A-Za-z0-9\-]*)*{_DOT}[A-Za-z][A-Za-z\-]*[A-Za-z](?![\w@])"
    r"|(?<![\w.+\-/@])[A-Za-z0-9][A-Za-z0-9_+\-]*(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9_+\-]+)*[ \t]+at[ \t]+[A-Za-z0-9][A-Za-z0-9\-]*(?:(?:\.|[ \t]+dot[ \t]+)[A-Za-z0-9\-]+)*[ \t]+dot[ \t]+[A-Za-z]{2,}(?!\w)",
    regex.I,
)
PHONE = regex.compile(
    r"(?<![\w.\-+/#])(?:"
    r"\+\d{1,3}(?:[ .\-/]?(?:\(0?\d{0,4}\))?[ .\-/]?\d){6,13}"
    r"|00\d{2}(?:[ .\-/]?\d){7,12}"
    r"|\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]?\d{3,5}"
    r"|\d{3}([.\- ])\d{3}\1\d{4}"
    r"|0\d{2,5}[ /\-]\d{3,7}(?:[ \-]\d{2,6})*"
    r"|8[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{2}"
    r"|\d{3}-\d{4}(?:[ \t]*(?:ext|x|доб)\.?[ \t]*\d{1,5})?"
    r")(?![\w\-/]|\.\d)"
)
ID_NUMBER = regex.compile(r"(?<![\w.\-+/#])(?:\d{3}([\- ])\d{2}\1\d{4}|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d]|[A-Za-z]{2}\d{7}|\d{2} \d{2} \d{6}|\d{8}[A-Za-z]|\d{6}[\-+]\d{3}[0-9A-Za-z])(?![\w\-/]|\.\d)")
#: Words that name streets (fixed values).
_STREET = "street st road rd avenue ave lane ln drive dr court ct crescent cres terrace ter way place pl square sq close row gardens grove mews boulevard blvd parkway hill rise walk alley quay wharf parade circus green"
_UNIT = r"(?:(?:flat|apt\.?|apartment|unit|suite|room)[ \t]*#?[0-9][0-9A-Za-z]*,?[ \t]*[, \n][ \t]*)?"
_PLACE = r"(?:[ \t]*[,\n][ \t]*(?:\d{4,6}[ \t]+)?\p{Lu}[\p{L}\-]+(?:,?[ \t]+\d{4,6}(?![ \t]?\d))?)?"
ADDRESS = regex.compile(
    rf"(?<![\w./\-])(?i:{_UNIT}\d{{1,5}}[a-z]?,?[ \t]+(?:[\p{{L}}'’\-]+[ \t]+){{1,3}}(?:{'|'.join(sorted(_STREET.split(), key=len, reverse=True))})(?![\w\-])\.?"
    r"|(?:p\.?[ \t]?o\.?[ \t]?box|postfach|apartado(?:[ \t]de[ \t]correos)?|а/я)[ \t]+\d[\d ]*"
    r"|\p{L}[\p{L}\-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|ufer|steig|damm)[ \t]+\d{1,4}[ \t]?[a-z]?(?!\w)"
    r"|(?:ул|улица|пр|пр-т|просп|проспект|пер|переулок|пл|площадь|наб|набережная|ш|шоссе|бул|бульвар)\.?[ \t]+[\p{L}\-]+(?:[ \t][\p{L}\-]+)?,?[ \t]*(?:д\.|дом)?[ \t]*\d+[\p{L}]?(?:,?[ \t]*(?:кв\.|квартира|к\.|корп\.|стр\.)[ \t]*\d+)*"
    r"|\d{1,4}(?:[ \t]?(?:bis|ter))?,?[ \t]+(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)[ \t]+[\p{L}'’\-]+(?:[ \t][\p{L}'’\-]+){0,3}"
    rf"|(?:calle|avenida|avda\.?|plaza|paseo|c/)[ \t]*[\p{{L}}\-]+(?:[ \t][\p{{L}}\-]+){{0,3}},?[ \t]+(?:n\.?º[ \t]*)?\d{{1,4}}){_PLACE}",
)
_STOP = frozenset(" ".join(FUNCTION_WORDS.values()).split()) | frozenset("meine mein unsere a an and are as at be by for from in is it no of on or that the this to was were with then we i you so but not und der die das de la le les el los y et".split())
_W = r"\p{Lu}(?:\p{Ll}|['’]\p{Lu})[\p{L}'’]*(?:-\p{Lu}[\p{L}'’]*)*"
_C = r"\p{Lu}[\p{Lu}'’]+(?:-[\p{Lu}'’]+)*"
_L = r"\p{Ll}[\p{Ll}'’]+(?:-[\p{Ll}'’]+)*"
_I = r"\p{Lu}\."
_GREETINGS = frozenset("thanks thank regards cheers hi hello dear hallo gruß merci gracias cordialement спасибо привет".split())
_NAME_END = r"(?!['’]?[\w@]|[.\-]\w|[ \t]?@)"


def _name(w: str, initials: str = _I) -> str:
    return rf"(?:(?:{initials}[ \t]?)+{w}|{w}[ \t]+(?:{initials}[ \t]?)*{w}|{w},[ \t]+{w}(?:[ \t]{initials})?)"


NAME = regex.compile(rf"(?<![\w@.+/\-'’])(?:{_name(_W)}|{_name(_C)})(?!\w)")
LOW_NAME = regex.compile(rf"(?<![\w@.+/\-'’]|\w\.)(?:{_name(_L, r'\p{Ll}[.]')})(?!\w)")
#: Contexts that announce a name in whatever case, and titles (fixed values).
CUE_NAME = regex.compile(r"(?:\b(?:signed-off-by|co-authored-by|from|reported-by|reviewer|author|contact|person|name|fullname|full_name|owner|recipient|customer|patient|employee|user|by)[\"']?\s*[:=]\s*[\"']?|\b(?:assigned to|regards,|thanks,|cheers,|gruß,|cordialement,)\s*|\b(?:dr|mr|mrs|ms|mx|prof|herr|frau|sr|sra|mme|m|г-н|г-жа|господин|госпожа)\.?[ \t]+)$", regex.I)
TITLE = regex.compile(r"\b(?:dr|mr|mrs|ms|mx|prof|herr|frau|sr|sra|mme|г-н|г-жа|господин|госпожа)\.?[ \t]+$", regex.I)
#: Articles in front of things, not of persons, and words for things behind their names (fixed values).
NO_NAME_BEFORE = regex.compile(r"\b(?:the|a|an|this|that|our|der|die|das|le|la|el)\s+(?:\d+\s+)?$|\d\s+$", regex.I)
NO_NAME_AFTER = regex.compile(r"^\s*(?:team|release|dashboard|project|service|parser|cache|module|build|branch|app|api|plan|package|version|queue|board|street|road|avenue|lane|ave|rd|st|drive|court|way|terrace|crescent|\d)\b", regex.I)
CUE = {
    "email": regex.compile(r"(?:mail|e-mail|cc|to|from|<|mailto:|login|contact|at|or at|an|на|write|reach)\W*(?:=|:)?\W*$", regex.I),
    "phone": regex.compile(r"(?:tel|phone|mobile|call|ring|text|whatsapp|number|nummer|ruf|номеру?|телефон|звоните|callback|fax|mobil|contact|on|me at|left|is|[|(;,]|\")\W*(?:=|:)?\W*$", regex.I),
    "id_number": regex.compile(r"(?:ssn|passport|licen[cs]e|id|card|tax|code|insurance|national|паспорт\w*|ausweis\w*|steuer\w*|pasaporte|dni|passeport|номер\w*|number|nummer|says|contractor is|no\.?|;)\W*(?:=|:)?\W*\w{0,12}\W*$", regex.I),
    "address": regex.compile(r"(?:addr\w*|street|deliver\w*|ship\w*|moved|live|find me at|to|from|at|адрес\w*|доставки|goes to|device|[,;:|(\"])\W*(?:=|:)?\W*$", regex.I),
}
TECHNICAL = regex.compile(r"\b(?:port|version|build|commit|line|epoch|range|session|part number|invoice|total|ratio|call \w+ with|row|ticket|sprint|v|exit code|bytes?|tokens?)\W*$", regex.I)

FEATURES = ("bias", "cue", "rare", "starts", "against_before", "against_after", "technical", "first_name", "dictionary", "initial", "title", "comma", "low", "form")
PRIOR = {
    "email": (3.0, 1.0, 0, 0, 0, 0, -0.5, 0, 0, 0, 0, 0, 0, 1.0),
    "phone": (1.2, 1.5, 0, 0.3, 0, 0, -3.0, 0, 0, 0, 0, 0, 0, 1.5),
    "id_number": (1.5, 1.5, 0, 0.3, 0, 0, -3.0, 0, 0, 0, 0, 0, -1.5, 1.0),
    "address": (1.5, 1.0, 0, 0.3, 0, 0, -3.0, 0, -1.0, 0, 0, 0, -0.5, 1.0),
    "name": (-1.8, 2.5, 0.5, -0.5, -2.5, -4.0, 0, 1.6, -2.2, 1.5, 2.5, -0.7, -1.5, 0),
}


@dataclass
class Mention:
    kind: str
    start: int
    end: int
    x: list[float]
    words: frozenset[str]
    telling: int = 0  # 1 and -1: the context alone decides
    context: tuple[int, ...] = ()  # slots of the words around


@dataclass
class Model:
    """Weights of the nodes by kind, of the words around a mention, and the couplings of neighbours and of mentions that share words."""

    node: dict[str, np.ndarray]
    context: np.ndarray
    near: float = NEAR
    same: float = SAME

    def unary(self, m: Mention) -> float:
        return float(np.dot(self.node[m.kind], m.x)) + (float(self.context[list(m.context)].sum()) if m.context else 0.0)


def prior_model() -> Model:
    return Model({k: np.array(v, dtype=float) for k, v in PRIOR.items()}, np.zeros(CONTEXT, dtype=np.float32))


_AROUND = regex.compile(r"\w+|[^\w\s]|\n")


def around(kind: str, left: str, right: str) -> tuple[int, ...]:
    """Slots of the words and marks next to a mention: one and two to the left, one and two to the right."""
    before, after = ([x.lower() if not x.isdigit() else "0" for x in _AROUND.findall(t)] for t in (left, right))
    before, after = ["^", "^", *before][-2:], [*after, "$", "$"][:2]
    keys = (f"l{before[1]}", f"ll{before[0]} {before[1]}", f"r{after[0]}", f"rr{after[0]} {after[1]}")
    return tuple(zlib.crc32(f"{kind} {k}".encode("utf-8", "replace")) % CONTEXT for k in keys)


def slots(word: str) -> tuple[int, int]:
    raw = word.encode("utf-8", "replace")
    return zlib.crc32(raw) % SLOTS, SLOTS + zlib.crc32(raw, 0x9E3779B9) % SLOTS


class Statistics:
    """Hashed counts of words over the corpus: in lower case, capitalised, as first word of a mention that may be a name, and of one that is announced as a name."""

    def __init__(self, table: np.ndarray | None = None) -> None:
        self.table = np.zeros((4, 2 * SLOTS), dtype=np.int64) if table is None else table
        self.memory: dict[str, tuple[float, float]] = {}

    def of(self, word: str) -> tuple[float, float]:
        """(dictionary, first_name) of a word; the memory is emptied when full."""
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            got = self.memory[word] = (self.dictionary(word), self.first_name(word))
        return got

    def counts(self, word: str, a: int, b: int) -> tuple[int, int]:
        """The word's counts of the statistics a and b."""
        i, j = slots(word)
        t = self.table
        return int(min(t[a, i], t[a, j])), int(min(t[b, i], t[b, j]))

    def dictionary(self, word: str) -> float:
        """0 for words only written with a capital, up to 1 for common words."""
        low, cap = self.counts(word.lower(), 0, 1)
        return low / (low + cap) if low + cap > 1 and low > 2 else 0.0

    def rare(self, word: str) -> float:
        """1 for words that the corpus never has in lower case."""
        return float(self.counts(word.lower(), 0, 1)[0] == 0)

    def first_name(self, word: str) -> float:
        """Log odds, from -3 to 2, that a mention that begins with the word is a name, from how often such mentions are announced as names."""
        best = -3.0
        for w in word.lower().split("-"):
            seen, told = self.counts(w, 2, 3)
            best = max(best, min(2.0, math.log((told + 0.3) / (0.06 * seen + 0.3))))
        return best


#: Words that stand free, not in an email address, path or identifier.
_FREE = regex.compile(r"(?<![\w@.+/\\\-=])\p{L}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*(?![\w@/=]|[.\-+]\w|[ \t]?@)")
#: The end of a sentence or line, behind which any word has a capital.
_START = regex.compile(r"(?:^|[.!?…:\n][\"'”»)\]]*)\s*$")
_GAP = regex.compile(r"[ \t,]*")
_TOKEN = regex.compile(r"\p{L}[\p{L}'’]*(?:-\p{L}[\p{L}'’]*)*")


def name_mentions(text: str, stats: Statistics, lower: bool = True) -> Iterator[Mention]:
    """Pairs of words, or initials and a word, that may be a full name. A common word at the front is taken off and the rest tried again."""
    spent = bytearray(len(text))  # characters of mentions that are settled; linear in the text
    for pattern, low in ((NAME, False), (LOW_NAME, True))[: 1 + lower]:
        at = 0
        while m := pattern.search(text, at):
            start, end = m.span()
            at = start + 1
            head = _TOKEN.match(text, start)
            at = head.end() if head else at
            if low:
                word = head[0] if head else ""
                if len(word) > 1 and "," not in text[start:end] and (stats.of(word)[0] > 0.3 or word in _STOP or stats.of(word)[1] <= 0.5 and text[start - 1 : start] not in ("=", '"', "'", " ", "\t", ":", "\n")):
                    continue
            if spent.find(1, start, end) >= 0:
                continue
            cut = regex.sub(r"['’]s?$", "", text[start:end])
            end = start + len(cut)
            toks = [t for t in _TOKEN.findall(cut) if len(t) > 1]
            left, right = text[max(0, start - 60) : start], text[end : end + 40]
            told = bool(CUE_NAME.search(left))
            comma = "," in cut
            if not toks:
                continue
            first = toks[-1] if comma else toks[0]
            initials = len(_TOKEN.findall(cut)) > len(toks)
            fame = stats.of(first)[1]
            common = max((stats.of(t)[0] for t in toks), default=0.0)
            if low and (common > 0.3 or any(t in _STOP for t in toks) or not (told or fame > 0.5 and len(toks) > 1)):
                continue
            if len(toks) == 1 and not initials:
                continue
            if not low and (stats.of(toks[0])[0] > 0.5 or toks[0].lower() in _STOP) and not (told and fame > 0.5):
                continue  # "Ask Ida Hall": the search goes on behind the first word
            if fame < 0.3 and not told and (m2 := pattern.match(text, _GAP.match(text, at).end())):
                rest = [t for t in _TOKEN.findall(m2[0]) if len(t) > 1]
                if rest and stats.of(rest[-1] if "," in m2[0] else rest[0])[1] > fame + 0.5:
                    continue  # "Reach Ida Hall": the first word never begins a name
            if comma and toks[0].lower() in _GREETINGS:
                continue  # "Thanks, Ida Hall"
            if comma and fame < stats.of(toks[0])[1] and len(toks) > 1:
                continue  # "Ida Hall, Ida Berg" is no surname in front of a first name
            against = bool(NO_NAME_BEFORE.search(left)) and not bool(TITLE.search(left))
            after_no = bool(NO_NAME_AFTER.search(right))
            x = [1.0, float(told), min(stats.rare(t) for t in toks), float(bool(_START.search(left))), float(against), float(after_no), 0.0, fame, common, float(initials), float(bool(TITLE.search(left))), float(comma), float(low), 0.0]
            yield Mention("name", start, end, x, frozenset(t.lower() for t in toks), 1 if told and not against and not after_no else -1 if after_no and not told else 0, around("name", left, right))
            if fame > 0 or told or initials:
                spent[start:end] = b"\x01" * (end - start)
                at = end


def number_mentions(text: str, stats: Statistics) -> Iterator[Mention]:
    for kind, pattern in (("email", EMAIL), ("phone", PHONE), ("id_number", ID_NUMBER), ("address", ADDRESS)):
        if kind == "email" and "@" not in text and "at" not in text.lower():
            continue
        for m in pattern.finditer(text):
            start, end = m.span()
            left, right = text[max(0, start - 40) : start], text[end : end + 30]
            cut = text[start:end]
            digits = sum(c.isdigit() for c in cut)
            form, common = 0.0, 0.0
            if kind == "email":
                start += len(cut) - len(cut.lstrip("'"))
                form = float("@" in cut)
            elif kind == "phone":
                form = 1.0 if cut[0] in "+(" or digits >= 10 else 0.5 if cut[0] == "0" else -0.5
            elif kind == "id_number":
                form = 1.0 if cut[-1].isalpha() or cut[0].isalpha() else 0.5
            else:
                inner = [t.lower() for t in _TOKEN.findall(cut.split("\n")[0])]
                if any(t in _STOP - {"a", "de", "la", "le", "les", "el", "los", "y"} for t in inner[:-1]) and cut[0].isdigit():
                    continue
                form = 1.0 if cut[:1].isalpha() or any(c.isupper() for c in cut) else 0.0
            low = float(kind == "id_number" and any(c.islower() for c in cut) or kind == "address" and cut == cut.lower())
            told = bool(CUE[kind].search(left))
            x = [1.0, float(told), 0.0, float(bool(regex.match(r"\s*(?:[.,;:|)\"'\n]|$)", right))), 0.0, 0.0, float(bool(TECHNICAL.search(left))), 0.0, common, 0.0, 0.0, 0.0, low, form]
            yield Mention(kind, start, end, x, frozenset([regex.sub(r"\W+", "", cut.lower())]), 1 if told and form >= 0.5 else 0)


def mentions(text: str, stats: Statistics) -> list[Mention]:
    """The nodes of a text in order. Where kinds of numbers overlap the earlier in the list of kinds stays, but an identity number beats a phone number of no clear form."""
    owner = np.zeros(len(text), dtype=np.int32)  # 1 + the number of the mention at each character
    found: list[Mention | None] = []
    for m in number_mentions(text, stats):
        over = {int(k) for k in np.unique(owner[m.start : m.end]) if k}
        if all(found[k - 1].kind == "phone" and m.kind == "id_number" and found[k - 1].x[-1] < 0.5 for k in over):
            for k in over:
                old = found[k - 1]
                owner[old.start : old.end] = 0
                found[k - 1] = None
            found.append(m)
            owner[m.start : m.end] = len(found)
    out = [m for m in found if m]
    out += [m for m in name_mentions(text, stats) if not owner[m.start : m.end].any()]
    return sorted(out, key=lambda m: (m.start, m.end))


def edges_of(nodes: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """(near, same, apart): neighbours, mentions that share a word or its first five letters, linked in one chain a word, and mentions that overlap."""
    near, apart = [], []
    for i, m in enumerate(nodes):
        j = i + 1
        while j < len(nodes) and nodes[j].start < m.end:
            apart.append((i, j))
            j += 1
        if j < len(nodes) and nodes[j].start - m.end < NEARBY:
            near.append((i, j))
    last: dict[tuple[str, str], int] = {}
    same: set[tuple[int, int]] = set()
    over = set(apart)
    for i, m in enumerate(nodes):
        keys = {(m.kind, w) for w in m.words} | {(m.kind, w[:5] + "~") for w in m.words if m.kind == "name" and len(w) > 6}
        same |= {(last[k], i) for k in keys if k in last}
        for k in keys:
            last[k] = i
    return near, sorted(e for e in same if e not in over), apart


def marginals(nodes: list[Mention], model: Model | dict[str, np.ndarray]) -> list[float]:
    """P(personal) of each node by loopy sum-product messages in log odds, damped, until they stand still."""
    if isinstance(model, dict):  # node weights alone
        model = Model(model, np.zeros(CONTEXT, dtype=np.float32))
    unary = [model.unary(m) for m in nodes]
    near, same, apart = edges_of(nodes)
    names = lambda i, j: nodes[i].kind == nodes[j].kind == "name"  # noqa: E731  (the coupling is learned from names)
    pairs = [*((i, j, model.near if names(i, j) else NEAR) for i, j in near), *((i, j, model.same) for i, j in same), *((i, j, None) for i, j in apart)]
    belief = unary
    if pairs:
        around_: dict[int, list[tuple[int, float | None]]] = {}
        for i, j, c in pairs:
            around_.setdefault(i, []).append((j, c))
            around_.setdefault(j, []).append((i, c))
        msg = {(i, j, c): 0.0 for i, js in around_.items() for j, c in js}
        for _ in range(ROUNDS):
            total = {i: unary[i] + sum(msg[j, i, c] for j, c in js) for i, js in around_.items()}
            most, new = 0.0, {}
            for (i, j, c), old in msg.items():
                h = max(-30.0, min(30.0, total[i] - msg[j, i, c]))
                to = -math.log1p(math.exp(h)) if c is None else math.log((math.exp(c + h) + math.exp(-c)) / (math.exp(h - c) + math.exp(c)))
                new[i, j, c] = 0.5 * old + 0.5 * to
                most = max(most, abs(new[i, j, c] - old))
            msg = new
            if most < STILL:
                break
        belief = [u + sum(msg[j, i, c] for j, c in around_.get(i, ())) for i, u in enumerate(unary)]
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, b)))) for b in belief]


def personal(text: str | None, stats: Statistics, model: Model) -> list[Mention]:
    """The personal items of a text; null and empty texts have none. Of overlapping ones the likeliest stays."""
    if not text:
        return []
    nodes = mentions(text, stats)
    taken = bytearray(len(text))
    out: list[Mention] = []
    for p, m in sorted(((p, m) for m, p in zip(nodes, marginals(nodes, model)) if p > 0.5), key=lambda x: (-x[0], x[1].start)):
        if taken.find(1, m.start, m.end) < 0:
            taken[m.start : m.end] = b"\x01" * (m.end - m.start)
            out.append(m)
    return sorted(out, key=lambda m: m.start)


def redact(text: str | None, items: list[Mention]) -> str | None:
    """The text with each item replaced by its kind in brackets and otherwise unchanged."""
    if text is None:
        return None
    out, at = [], 0
    for m in items:
        out += [text[at : m.start], f"[{m.kind.upper()}]"]
        at = m.end
    return "".join([*out, text[at:]])


# ---- fitting and Spark ---------------------------------------------------------------------------------------


def word_statistics(texts: DataFrame) -> Statistics:
    """Statistics over all texts: two passes of hashed counts, tables of fixed size, at most 8 * SLOTS rows to the driver."""

    def tally(known: object) -> object:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((4, 2 * SLOTS), dtype=np.int64)
            stats = Statistics(known.value) if known else None
            for b in batches:
                for t in b.column(0).to_pylist():
                    if not t:
                        continue
                    if stats is None:
                        mixed = t != t.upper() and t != t.lower()
                        for m in _FREE.finditer(t) if mixed else ():
                            w = m[0]
                            if len(w) > 1:
                                total[int(w[0].isupper()), slots(w.lower())] += 1
                        continue
                    for m in name_mentions(t, stats, lower=False):
                        if not m.x[FEATURES.index("low")]:
                            toks = [w for w in _TOKEN.findall(t[m.start : m.end]) if len(w) > 1]
                            first = toks[-1] if m.x[FEATURES.index("comma")] else toks[0]
                            for w in first.lower().split("-"):
                                total[2, slots(w)] += 1
                                total[3, slots(w)] += m.telling > 0
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total.ravel()[used], pa.int64())], names=["slot", "n"])

        rows = spread(texts.select("text")).mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros(8 * SLOTS, dtype=np.int64)
        table[rows["slot"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
        return table.reshape(4, 2 * SLOTS)

    first = tally(None)
    return Statistics(first + tally(texts.sparkSession.sparkContext.broadcast(first)))


def fit_model(texts: list[str], stats: Statistics) -> Model:
    """Weights of names, of the words around them, and the couplings, by pseudo-likelihood on a bounded sample.

    Labels: mentions whose context tells, and those whose first word is often, or common but never, announced as a
    name. What told them is hidden from half of the examples, so that the words around and the others learn too.
    From the second round on unclear mentions count as well, with the marginals of the field as their labels, and the
    labels of neighbours and of repetitions are features: their weights are the couplings. Everything is held to its
    prior. The other kinds offer too few counterexamples and keep their priors.
    """
    model = prior_model()
    docs = [n for t in texts if (n := mentions(t, stats))]
    fame, hidden = FEATURES.index("first_name"), [FEATURES.index(f) for f in ("cue", "title", "first_name")]
    names = [(d, i, m) for d, ns in enumerate(docs) for i, m in enumerate(ns) if m.kind == "name"]
    seeds = [m.telling or (1 if m.x[fame] > 1.2 else -1 if m.x[fame] < -1.2 else 0) for _, _, m in names]
    if sum(s > 0 for s in seeds) < 25 or sum(s < 0 for s in seeds) < 25:
        return model
    links = [edges_of(ns) for ns in docs]
    x = np.array([m.x for _, _, m in names])
    shown = x.copy()
    for n in range(0, len(names), 2):
        if seeds[n]:
            shown[n, hidden] = 0.0
    slots_ = np.array([m.context for _, _, m in names])
    prior = model.node["name"].copy()
    for step in range(FIT_ROUNDS):
        if step:
            beliefs = [marginals(ns, model) for ns in docs]
            y = np.array([float(s > 0) if s else beliefs[d][i] for s, (d, i, _) in zip(seeds, names)])
            weight = np.array([1.0 if s else abs(2 * beliefs[d][i] - 1) for s, (d, i, _) in zip(seeds, names)])
            side = np.zeros((len(names), 2))
            at = {(d, i): n for n, (d, i, _) in enumerate(names)}
            for d, (near, same, _) in enumerate(links):
                for k, es in ((0, near), (1, same)):
                    for i, j in es:
                        for a, b in ((i, j), (j, i)):
                            if (d, a) in at and (k or (d, b) in at):
                                side[at[d, a], k] += 2 * (2 * beliefs[d][b] - 1)
        else:
            y, weight, side = np.array([float(s > 0) for s in seeds]), np.array([float(s != 0) for s in seeds]), np.zeros((len(names), 2))
        w, c, e = model.node["name"].copy(), model.context.astype(float), np.array([model.near, model.same])
        held = np.array([NEAR, SAME])
        size, grad = max(200.0, weight.sum()), np.zeros(CONTEXT)
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(shown @ w + c[slots_].sum(axis=1) + side @ e, -30, 30)))
            r = weight * (p - y)
            grad[:] = 0.0
            np.add.at(grad, slots_, r[:, None])
            w -= 0.5 * (shown.T @ r + HOLD * (w - prior)) / size
            c -= 4.0 * (grad + HOLD_CONTEXT * c) / size
            e -= 0.2 * (side.T @ r + HOLD_EDGE * (e - held)) / size
        model.node["name"], model.context, model.near, model.same = w, c.astype(np.float32), float(max(0.0, e[0])), float(max(0.0, e[1]))
    return model


def text_fields(interactions: DataFrame, cases: DataFrame) -> DataFrame:
    """(field, row_key, text) of the three fields that hold free text."""
    key = F.col("interaction_id").cast("string")
    own = [interactions.select(F.lit(f"interactions.{c}").alias("field"), key.alias("row_key"), F.col(c).alias("text")) for c in ("prompt", "answer")]
    return own[0].unionByName(own[1]).unionByName(cases.select(F.lit("cases.followup_prompt").alias("field"), F.col("case_id").alias("row_key"), F.col("followup_prompt").alias("text"))).where("text <> ''")


def _model(texts: DataFrame) -> tuple[Statistics, Model]:
    stats = word_statistics(texts)
    sample = [r.text for r in texts.where(F.length("text") <= FIT_CHARS).select("text", F.xxhash64("field", "row_key").alias("h")).orderBy("h", "text").limit(FIT_TEXTS).collect()]
    return stats, fit_model(sample, stats)


def find(texts: DataFrame) -> DataFrame:
    """(field, row_key, kind, start_pos): each personal item of each text, start_pos in code points from 0."""
    model = texts.sparkSession.sparkContext.broadcast(_model(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, weights = model.value
        for b in batches:
            out = [(f, k, m.kind, m.start) for f, k, t in zip(*(b.column(c).to_pylist() for c in range(3))) for m in personal(t, stats, weights)]
            cols = [*zip(*out)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["field", "row_key", "kind", "start_pos"])

    return spread(texts.select("field", "row_key", "text")).mapInArrow(run, "field string, row_key string, kind string, start_pos int").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """(field, row_key, text) with typed placeholders in place of the personal items."""
    model = texts.sparkSession.sparkContext.broadcast(_model(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, weights = model.value
        for b in batches:
            new = [redact(t, personal(t, stats, weights)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["field", "row_key", "text"])

    return spread(texts.select("field", "row_key", "text")).mapInArrow(run, "field string, row_key string, text string")
