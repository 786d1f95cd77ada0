"""Shared text measures: words, sentences, prose without code, logs and tables, and the language of a text."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,200}>")
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n\s*(?=[-*•]\s|\d+[.)]\s|#)|\n\s*\n")
_LOG = re.compile(r"^\s*(?:\[?\d{4}-\d\d|\[?\d\d:\d\d:\d\d|\d+ ?ms\b|(?:TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL)\b|at [\w$.<>]+\(|Traceback\b|File \"|Caused by\b|\$ |>>> )")
_TABLE = re.compile(r"^\s*\|.*\||^[^|\n]*\|[^|\n]*\||\t\S*\t|^\s*[-+=|:]{3,}\s*$|^[^;\n]*;[^;\n]*;[^;\n]*;")
_CODE = re.compile(r"[;{}]\s*$|:=|==|!=|=>|->|\+=|&&|\|\||^\s*(?:def|class|import|from \w+ import|return|func|fn|let|const|var|if .*[:{]\s*$|for .*[:{]\s*$|else\b.*[:{]\s*$|export|public|private|select .* from|where \w+ [<>=]|group by|order by|#include)\b|^\s*\w+ = |\w+\.\w+\(|^\s*\w+\([^)]*\)\s*$|\b\w+=\S+ \w+=\S+")
_TICKS = re.compile(r"`[^`\n]*`")
_ODD = re.compile(r"[\d/\\_@=]|[a-z][A-Z]|^--\w")

#: Share of function words in running text, at which Latin function words and Cyrillic words are held against each other.
FUNCTION_SHARE = 0.4

#: Frequent function words that tell the languages apart (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is it that was for on are with as be this by not but at from or an have has had were which you can when there its they if will would all my your we do does so into than then after before what who why how only",
    "de": "der die das und ist nicht ein eine einen den dem des mit auf für von zu im auch sich es wird werden wurde war sind bei aus nach noch nur oder aber wenn dass daß wie durch ich sie wir kann hat haben keine zur zum über alle steht mehr vor bitte ob",
    "es": "el la los las de que y en un una es no se por con para su al lo como más pero sus este esta ya fue son del está porque cuando muy sin sobre también me hasta hay donde quien desde todo nos durante ni solo antes",
    "fr": "le la les des et est un une du que qui dans en pour pas sur au ce il ne se plus par avec son sont mais ou nous vous cette ces aux été dont leur sans si tout cela elle même fait donc était avant deux",
}
_LANGUAGES = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_CYRILLIC, _LATIN = re.compile("[\u0400-\u04ff]"), re.compile("[\u0000-\u024f\u1e00-\u1eff]")
_SHARED = frozenset(w for w, n in Counter(w for v in _LANGUAGES.values() for w in v).items() if n > 1)
_MARKS = {"de": re.compile(r"[äöüßÄÖÜ]"), "es": re.compile(r"[ñ¿¡áíóú]"), "fr": re.compile(r"[èêëçœàùâîôû]|\b[ldjnscm]['’]|\bqu['’]")}


def words(text: str) -> list[str]:
    return WORD.findall(text)


def is_prose(line: str) -> bool:
    """False for lines of logs, tables and code."""
    if _LOG.search(line) or _TABLE.search(line):
        return False
    return not _CODE.search(line) or line.rstrip()[-1:] in ".?!" and len(words(line)) > 8 and not re.search(r"[{}]|:=|==|=>|&&", line)


def prose(text: str | None) -> str:
    """The text without fenced blocks, lines of code, logs and tables, and markup tags."""
    if not text:
        return ""
    text = re.sub(r"\r\n?|[\u2028\u2029\x0b\x0c\x85]", "\n", text)
    lines = (FENCE.sub("\n", text) if "```" in text or "~~~" in text else text).split("\n")
    return "\n".join(TAG.sub(" ", x) if "<" in x else x for x in lines if is_prose(x))


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in SENTENCE.split(text)) if s and WORD.search(s)]


class _Tokens(dict):
    """What a token between blanks says about its text's language: (words, Cyrillic words, letters, Latin letters, and by language twice the function words and the marks). Emptied when full."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        found = () if _ODD.search(token) else WORD.findall(token)
        letters = "".join(found)
        cyrillic, latin = (0, len(letters)) if letters.isascii() else (sum(1 for w in found if _CYRILLIC.match(w)), len(_LATIN.findall(letters)))
        low = [w.lower() for w in found]
        halves = [sum(1 if w in _SHARED else 2 for w in low if w in v) for v in _LANGUAGES.values()]
        marks = [len(_MARKS[k].findall(token)) if k in _MARKS and found else 0 for k in _LANGUAGES]
        got = self[token] = (len(found), cyrillic, len(letters), latin, *halves, *marks)
        return got


_tokens = _Tokens()
_NAMES = tuple(_LANGUAGES)


def language(text: str) -> tuple[str, float]:
    """(language, evidence): en, de, es, fr, ru, ``other`` for other scripts, or ``none``; evidence counts the words that speak for it against the next one."""
    totals = [0] * (4 + 2 * len(_NAMES))
    for token, n in Counter((_TICKS.sub(" ", text) if "`" in text else text).split()).items():
        for i, x in enumerate(_tokens[token]):
            if x:
                totals[i] += n * x
    words_, cyrillic, letters, latin, *rest = totals
    if not words_:
        return "none", 0.0
    if letters != latin and not cyrillic and latin <= letters / 2:
        return "other", float(words_)
    score = {k: h / 2 + 0.7 * m for k, h, m in zip(_NAMES, rest, rest[len(_NAMES) :])}
    (best, n), (_, second) = sorted(score.items(), key=lambda x: -x[1])[:2]
    if cyrillic and FUNCTION_SHARE * cyrillic > n:  # names and addresses in Latin letters are no other language
        return "ru", cyrillic - n / FUNCTION_SHARE
    return (best, n - second) if n > second else ("none", 0.0)
