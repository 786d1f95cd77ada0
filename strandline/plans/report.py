"""Text and HTML reports over small collected frames; only aggregates go in, never texts."""

from __future__ import annotations

import contextlib
import datetime
import html
import http.server
import os
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from strandline.errors import NoticeError, UsageError

#: Words of the reports (en, ru). A key without a text stands for itself.
WORDS = {
    "en": {
        "turns": "Turns", "completed": "Completed", "sessions": "Sessions", "status": "Status", "models": "Models", "mean_tokens": "Mean tokens", "mean_seconds": "Mean seconds", "mean_tools": "Mean tool calls", "totals": "Totals", "averages": "Averages of completed turns",
        "agents": "Agents", "roles": "Roles (created, working turns)", "settings": "Models of working turns", "coverage": "What could not be told", "tokens": "Tokens of agents", "durations": "Working time", "n": "Count", "role": "Role", "model": "Model", "effort": "Effort", "source": "Source",
        "behaviour": "Follow-ups", "task_types": "Task types", "cohorts": "With and without agents", "routing": "Models by task type", "insights": "Insights", "recommendations": "Recommendations", "strength": "Strength", "weakness": "Weakness", "high": "High priority", "medium": "Medium priority", "low": "Low priority",
        "limited": "Too few observations for a statement.", "observed": "Observed", "action": "What to do", "checklist": "Check", "metrics": "Figures", "methodology": "How this was counted", "privacy": "The report holds counts only, no texts.",
        "validation_type": "A {label} step would have caught most cases: add it to the definition of done.", "steering_reason": "Most corrections are about {label}: say so in the first request.", "prompt_issue": "Requests often lack the same thing ({label}): add it to the template.", "agents_rule": "A standing rule would help ({label}): write it into the project's instructions.",
        "skill_candidate": "The same workflow recurs ({label}): make it a reusable skill.", "routing_hint": "Try {label} for this type of task: it costs less and is corrected no more.", "general": "Some follow-ups correct the course ({n}): read them before changing anything.", "task_type": "{label}: {rate} of {samples} tasks were corrected.",
        "check_scope": "Is the scope stated?", "check_done": "Is it stated when the task is done?", "check_proof": "Is it stated how that is shown?", "method_pairs": "A turn counts if a later request answers it.", "method_least": "Groups under ten turns are not compared.", "method_sources": "Recorded and estimated tokens are never added.", "notice": "Texts of {n} tasks are sent to the labeler.",
    },
    "ru": {
        "turns": "Ходы", "completed": "Завершено", "sessions": "Сессии", "status": "Состояние", "models": "Модели", "mean_tokens": "Токенов в среднем", "mean_seconds": "Секунд в среднем", "mean_tools": "Вызовов в среднем", "totals": "Всего", "averages": "Средние по завершённым",
        "agents": "Агенты", "roles": "Роли (создано, рабочих ходов)", "settings": "Модели рабочих ходов", "coverage": "Что не удалось установить", "tokens": "Токены агентов", "durations": "Время работы", "n": "Число", "role": "Роль", "model": "Модель", "effort": "Усилие", "source": "Источник",
        "behaviour": "Продолжения", "task_types": "Типы задач", "cohorts": "С агентами и без", "routing": "Модели по типам задач", "insights": "Выводы", "recommendations": "Рекомендации", "strength": "Сильная сторона", "weakness": "Слабая сторона", "high": "Важно", "medium": "Средне", "low": "Не срочно",
        "limited": "Слишком мало наблюдений.", "observed": "Наблюдение", "action": "Что сделать", "checklist": "Проверьте", "metrics": "Показатели", "methodology": "Как считали", "privacy": "В отчёте только числа, без текстов.",
        "validation_type": "Шаг {label} поймал бы большинство случаев: добавьте его в критерий готовности.", "steering_reason": "Большинство исправлений — {label}: скажите об этом в первом запросе.", "prompt_issue": "В запросах часто не хватает одного и того же ({label}): добавьте это в шаблон.", "agents_rule": "Помогло бы постоянное правило ({label}): запишите его в инструкции проекта.",
        "skill_candidate": "Один и тот же порядок действий повторяется ({label}): сделайте из него навык.", "routing_hint": "Попробуйте {label} для таких задач: дешевле, а исправляют не чаще.", "general": "Часть продолжений исправляет курс ({n}): прочтите их, прежде чем что-то менять.", "task_type": "{label}: исправлено {rate} из {samples} задач.",
        "check_scope": "Указаны ли границы?", "check_done": "Указано ли, когда задача готова?", "check_proof": "Указано ли, чем это подтвердить?", "method_pairs": "Ход считается, если на него ответил следующий запрос.", "method_least": "Группы меньше десяти ходов не сравниваются.", "method_sources": "Записанные и оценённые токены не складываются.", "notice": "Тексты {n} задач отправляются разметчику.",
    },
}
#: Columns that may appear in a report.
ALLOWED = frozenset(
    "sessions turns completed sum_tokens sum_duration_ms sum_tool_calls status model effort n mean_tokens mean_seconds mean_tools label pct task_type samples steering_n steering_rate rate uses cohort tasks complete aborted incomplete followups created nested working role source requests"
    " total_tokens input_tokens cached_input_tokens output_tokens reasoning_output_tokens duration_ms known missing invalid link reason priority kind metric expected actual verdict field route dimension name missing_ids missing_parents missing_depth disputed_agents no_instant unattributed before_creation"
    " ownership_conflict terminal_conflict terminal_mismatches malformed steering continuation user_correction question".split()
)
LEAST = 10


def language_of(environment: dict[str, str]) -> str:
    """The language of a locale's variables, the first that is set; English where there is no text for it."""
    for k in ("LC_ALL", "LC_MESSAGES", "LANG"):
        if environment.get(k):
            found = environment[k].split("_")[0].split(".")[0].lower()
            return found if found in WORDS else "en"
    return "en"


def word(key: str, language: str = "en", **values: object) -> str:
    """The text of a key with its values; the key itself where there is none."""
    text = WORDS.get(language, WORDS["en"]).get(key, WORDS["en"].get(key, key))
    return text.format(**values) if values else text


def rate_bar(rate: float | None) -> int:
    """A rate as whole percent within 0 and 100."""
    return 0 if rate is None or rate != rate else max(0, min(100, round(100 * rate)))


def _rows(df: DataFrame) -> tuple[list[str], list[tuple]]:
    if set(df.columns) - ALLOWED:
        raise ValueError(f"columns that a report may not show: {sorted(set(df.columns) - ALLOWED)}")
    return df.columns, [tuple(r) for r in df.collect()]


def _cell(v: object) -> str:
    return "n/a" if v is None else f"{v:,.1f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


def text_report(frames: dict[str, DataFrame], language: str = "en") -> str:
    """Sections of aligned columns, in the order given; sections without rows are left out."""
    out = []
    for title, df in frames.items():
        names, rows = _rows(df)
        if not rows:
            continue
        cells = [[word(n, language) for n in names], *([_cell(v) for v in r] for r in rows)]
        widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
        out += [f"== {word(title, language)}", *("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells), ""]
    return "\n".join(out)


# ---- insights and recommendations -----------------------------------------------------------------------------


@dataclass
class Recommendation:
    priority: str
    family: str
    text: str
    observed: str
    checklist: list[str] = field(default_factory=list)


def insight_lines(rows: list[tuple], language: str = "en") -> list[str]:
    """Lines of (priority, kind, label, samples, rate) insights, a heading a priority; a priority without any says so."""
    out = []
    for p in ("strength", "weakness", "high", "medium", "low"):
        out.append(f"== {word(p, language)}")
        own = [r for r in rows if r[0] == p]
        out += [f"  {word('routing_hint' if kind == 'routing' else kind, language, label=label, samples=samples, rate=f'{rate_bar(rate)}%')}" for _, kind, label, samples, rate in own] or [f"  {word('limited', language)}"]
    return out


def recommendations(tops: dict[str, tuple[str, int]], samples: int, steering: int, language: str = "en") -> list[Recommendation]:
    """At most one recommendation a label family, from (label, count) of its most frequent label; none on fewer than LEAST samples. Skills need two cases. Without any label a general one, if anything was corrected."""
    if samples < LEAST:
        return []
    checks = [word(c, language) for c in ("check_scope", "check_done", "check_proof")]
    order = (("validation_type", "high"), ("steering_reason", "high"), ("prompt_issue", "medium"), ("agents_rule", "medium"), ("skill_candidate", "low"))
    out = []
    for family, priority in order:
        label, n = tops.get(family, ("", 0))
        if label and n > 0 and (family == "steering_reason" or label != "other") and (family != "skill_candidate" or n >= 2):
            out.append(Recommendation(priority, family, word(family, language, label=label), f"{label} ({n})", checks))
    if not out and steering > 0:
        out.append(Recommendation("low", "general", word("general", language, n=steering), str(steering), checks))
    return out


def html_report(frames: dict[str, DataFrame], language: str = "en", bars: dict[str, float] | None = None, advice: list[Recommendation] = (), insights: list[str] = ()) -> str:
    """A page: figures with bars, insights, recommendations, the frames as tables and how they were counted. Everything is escaped."""
    e, w = html.escape, lambda k: html.escape(word(k, language))
    parts = [f'<!doctype html><html lang="{e(language)}"><meta charset=utf-8><body>']
    if bars:
        parts += [f"<h2>{w('metrics')}</h2>", *(f'<p>{w(k)} <meter min=0 max=100 value={rate_bar(v)}>{rate_bar(v)}%</meter></p>' for k, v in bars.items())]
    if insights:
        parts += [f"<h2>{w('insights')}</h2><pre>", e("\n".join(insights)), "</pre>"]
    if advice:
        parts.append(f"<h2>{w('recommendations')}</h2>")
        parts += [f"<section><h3>{w(a.priority)}</h3><p>{e(a.text)}</p><p>{w('observed')}: {e(a.observed)}</p><ul>{''.join(f'<li>{e(c)}</li>' for c in a.checklist)}</ul></section>" for a in advice]
    for title, df in frames.items():
        names, rows = _rows(df)
        head = "".join(f"<th>{w(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{e(_cell(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{w(title)}</h2><table><tr>{head}</tr>{body}</table>")
    parts += [f"<h2>{w('methodology')}</h2><ul>", *(f"<li>{w(k)}</li>" for k in ("method_pairs", "method_least", "method_sources", "privacy")), "</ul></body></html>"]
    return "\n".join(parts)


# ---- where reports go ------------------------------------------------------------------------------------------


def write_report(root: str, page: str, now: datetime.datetime | None = None) -> str:
    """The page in a new private folder named by the time; never into a folder that is there already."""
    stamp = (now or datetime.datetime.now(datetime.UTC)).strftime("%Y%m%dT%H%M%S")
    os.makedirs(root, mode=0o700, exist_ok=True)
    for n in range(1000):
        folder = os.path.join(root, stamp + (f"-{n}" if n else ""))
        try:
            os.mkdir(folder, 0o700)
            break
        except FileExistsError:
            continue
    else:
        raise FileExistsError(root)
    path = os.path.join(folder, "report.html")
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        f.write(page)
    return path


@contextlib.contextmanager
def serve(path: str) -> Iterator[str]:
    """The URL of a server of this one page on the loopback address; requests under another host name are refused. It ends with the block."""

    class Page(http.server.BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            own = {f"127.0.0.1:{self.server.server_port}", f"localhost:{self.server.server_port}"}
            if self.headers.get("Host") not in own or self.path not in ("/", "/report.html"):
                self.send_error(403 if self.headers.get("Host") not in own else 404)
                return
            with open(path, "rb") as f:
                body = f.read()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Page)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/"
    finally:
        server.shutdown()
        server.server_close()
        thread.join()


class Stages:
    """Seconds by stage, in the order they were entered; a stage entered again adds up."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock, self.seconds = clock, {}

    @contextlib.contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = self.clock()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + self.clock() - began

    def lines(self) -> list[str]:
        return [f"{k}: {v:.3f} s" for k, v in self.seconds.items()]


class Gate:
    """What stands between texts and a labeler: a notice before the first record that is not in the cache, none if all are; NoticeError, and nothing sent, if it cannot be written. Then progress, in steps of ten percent."""

    def __init__(self, write: Callable[[str], object], language: str = "en") -> None:
        self.write, self.language, self.shown = write, language, -1

    def open(self, pending: int) -> bool:
        if not pending:
            return False
        try:
            self.write(word("notice", self.language, n=pending))
        except OSError as e:
            raise NoticeError(str(e)) from e
        return True

    def progress(self, done: int, total: int) -> None:
        step = 10 if not total else 10 * done // total
        if step > self.shown:
            self.shown = step
            self.write(f"{10 * step} %")


@dataclass(frozen=True)
class Window:
    """A time window in nanoseconds, both ends inside; days of 0 or less have no beginning."""

    since_ns: int | None
    before_ns: int

    @classmethod
    def of(cls, days: int, before: datetime.datetime) -> Window:
        if before.tzinfo is None:
            raise UsageError("a time needs an offset")
        end = int(before.timestamp() * 1_000_000) * 1000
        return cls(end - days * 86_400 * 10**9 if days > 0 else None, end)
