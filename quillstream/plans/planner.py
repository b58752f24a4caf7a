"""Language-model planning: prompts, repair of answers, confidence, fallbacks; providers with failover."""

from __future__ import annotations

import json
import re
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable

from ..sources.config import Provider, Settings
from . import nl_rules
from .ir import Question
from .sqlpp import quote

DEFAULT_ANALYSIS = {"intent": {"type": "SELECT", "action": "find"}, "entities": [], "filters": []}
DEFAULT_SQL = "SELECT * FROM multimodal_data LIMIT 100"


class Client(ABC):
    """Anything that answers a prompt."""

    @abstractmethod
    def generate(self, prompt: str, max_tokens: int = 1000) -> str: ...

    def healthy(self) -> bool:
        try:
            return bool(self.generate("ping", 5))
        except Exception:  # any failure of a provider means it is not usable now
            return False


class MockClient(Client):
    """Fixed answers by a word of the prompt, for work without a network."""

    def __init__(self, answers: dict[str, str] | None = None, default: str = json.dumps(DEFAULT_ANALYSIS)):
        self.answers, self.default = answers or {}, default

    def generate(self, prompt: str, max_tokens: int = 1000) -> str:
        return next((a for word, a in self.answers.items() if word in prompt), self.default)


class HttpClient(Client):
    """Chat completions over HTTP; `shape` builds the request, `pick` reads the answer."""

    def __init__(self, settings: Provider, shape: Callable[[Provider, str, int], tuple[str, dict, dict]], pick: Callable[[dict], str]):
        self.settings, self.shape, self.pick = settings, shape, pick

    def generate(self, prompt: str, max_tokens: int = 1000) -> str:
        url, headers, body = self.shape(self.settings, prompt, min(max_tokens, self.settings.max_tokens))
        ask = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        for attempt in range(max(1, self.settings.retry_attempts)):
            try:
                with urllib.request.urlopen(ask, timeout=self.settings.timeout) as answer:
                    return self.pick(json.load(answer))
            except OSError:
                if attempt + 1 >= self.settings.retry_attempts:
                    raise
        raise RuntimeError("no attempt was made")


def _chat(p: Provider, prompt: str, n: int) -> tuple[str, dict, dict]:
    return f"{p.base_url or 'https://api.openai.com/v1'}/chat/completions", {"Authorization": f"Bearer {p.api_key}"}, {"model": p.model, "max_tokens": n, "temperature": p.temperature, "messages": [{"role": "user", "content": prompt}]}


def _messages(p: Provider, prompt: str, n: int) -> tuple[str, dict, dict]:
    return f"{p.base_url or 'https://api.anthropic.com/v1'}/messages", {"x-api-key": p.api_key or "", "anthropic-version": "2023-06-01"}, {"model": p.model, "max_tokens": n, "messages": [{"role": "user", "content": prompt}]}


def _generate(p: Provider, prompt: str, n: int) -> tuple[str, dict, dict]:
    return f"{p.base_url or 'http://localhost:11434'}/api/generate", {}, {"model": p.model, "prompt": prompt, "stream": False, "options": {"num_predict": n}}


MAKERS: dict[str, Callable[[Provider], Client]] = {
    "mock": lambda p: MockClient(),
    "openai": lambda p: HttpClient(p, _chat, lambda r: r["choices"][0]["message"]["content"]),
    "anthropic": lambda p: HttpClient(p, _messages, lambda r: r["content"][0]["text"]),
    "local": lambda p: HttpClient(p, _generate, lambda r: r["response"]),
}


class Providers:
    """The configured clients; asks the chosen one, then the others, then the mock."""

    def __init__(self, settings: Settings, makers: dict[str, Callable[[Provider], Client]] | None = None):
        makers = makers or MAKERS
        self.clients = {n: makers[n](p) for n, p in settings.providers.items() if n in makers}
        self.clients.setdefault("mock", MockClient())
        self.current, self.fallback = settings.provider if settings.provider in self.clients else "mock", settings.fallback

    def switch(self, name: str) -> None:
        if name not in self.clients:
            raise KeyError(name)
        self.current = name

    def health(self) -> dict[str, bool]:
        return {n: c.healthy() for n, c in self.clients.items()}

    def best(self) -> str:
        return next((n for n in self.order() if self.clients[n].healthy()), "mock")

    def order(self) -> list[str]:
        rest = [n for n in self.clients if n not in (self.current, "mock")] if self.fallback else []
        return [self.current, *rest, *(["mock"] if self.current != "mock" and self.fallback else [])]

    def generate(self, prompt: str, max_tokens: int = 1000) -> str:
        error: Exception | None = None
        for name in self.order():
            try:
                return self.clients[name].generate(prompt, max_tokens)
            except Exception as e:  # the next provider takes over; the last one's error is raised
                error = e
        raise error or RuntimeError("no provider")


def repair_json(answer: str) -> dict:
    """The answer's JSON object: as it is, in a fenced block, or between the outermost braces; else the default analysis."""
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", answer, re.DOTALL)
    braces = answer[answer.find("{") : answer.rfind("}") + 1] if "{" in answer else ""
    for candidate in (answer, fenced[1] if fenced else "", braces):
        try:
            if isinstance(held := json.loads(candidate), dict):
                return held
        except ValueError:
            continue
    return dict(DEFAULT_ANALYSIS)


def extract_sql(answer: str) -> str:
    """The SQL of an answer: a fenced block, or lines from SELECT or WITH to a semicolon or blank line; else the default."""
    if m := re.search(r"```sql\s*\n(.*?)```", answer, re.DOTALL | re.I):
        return m[1].strip()
    if m := re.search(r"(?im)^\s*((?:select|with)\b.*?)(?:;|\n\s*\n|\Z)", answer, re.DOTALL):
        return " ".join(m[1].split())
    return DEFAULT_SQL


def extract_confidence(answer: str, default: float = 0.7) -> float:
    """The first number of the answer that lies between 0 and 1."""
    return next((float(x) for x in re.findall(r"\d+(?:\.\d+)?", answer) if 0 <= float(x) <= 1), default)


def rule_confidence(analysis: dict) -> float:
    """0.5, and 0.2 for an intent, 0.1 for each entity up to 0.3, 0.1 for filters; 1 at most."""
    score = 0.5 + 0.2 * bool(analysis.get("intent", {}).get("type")) + min(0.1 * len(analysis.get("entities", [])), 0.3) + 0.1 * bool(analysis.get("filters"))
    return round(min(score, 1.0), 10)


def fallback_sql(analysis: dict, default_limit: int = 100) -> str:
    """A statement of the analysis' entities and filters; all literals escaped."""
    shapes = {("entities", "content"): "SEMANTIC_MATCH(content, {})", ("entities", "location"): "metadata->>'location' = {}", ("filters", "content"): "CAPTION_CONTAINS({})"}
    held = [shape.format(quote(str(x["value"]))) for (part, kind), shape in shapes.items() for x in analysis.get(part, []) if x.get("type") == kind]
    where = f" WHERE {' AND '.join(held)}" if held else ""
    return f"SELECT * FROM multimodal_data{where} LIMIT {int(analysis.get('limit') or default_limit)}"


def to_question(text: str, analysis: dict, default_limit: int = 100) -> Question:
    """An analysis flattened to what the executor runs."""
    entities, held = analysis.get("entities", []), analysis.get("filters", [])
    of = lambda kind, part: tuple(str(x["value"]) for x in part if x.get("type") == kind)
    filters = {k: of(k, [*entities, *held])[0] for k in ("location", "color", "object") if of(k, [*entities, *held])}
    period = analysis.get("time_range") or {}
    value = period.get("value", ())
    types = tuple(t for t in of("data_type", entities) if t in nl_rules.TYPE_WORDS) or nl_rules.data_types(text)
    return Question("natural_language", text, types, of("content", entities) + of("content", held), filters, (period["type"], () if isinstance(value, str) else tuple(value)) if period.get("type") else None, analysis.get("limit") or default_limit)


def with_context(text: str, context: dict | None) -> str:
    """The question, then time, preferences and the last three turns."""
    context = context or {}
    prefs = context.get("user_preferences", {})
    parts = [text, context.get("current_time") and f"当前时间: {context['current_time']}", prefs.get("language") and f"语言偏好: {prefs['language']}", prefs.get("domain") and f"领域: {prefs['domain']}"]
    if history := context.get("conversation_history"):
        parts.append(f"会话上下文: {'; '.join(history[-3:])}")
    return " | ".join(p for p in parts if p)


class Planner:
    """Question -> analysis, SQL, confidence. A failing model leaves a fallback of confidence 0.3."""

    def __init__(self, client, default_limit: int = 100):
        self.client, self.default_limit = client, default_limit

    def analyze(self, text: str) -> dict:
        return repair_json(self.client.generate(f"ANALYZE as JSON (intent, entities, time_range, filters, sorting, limit): {text}"))

    def sql(self, analysis: dict) -> str:
        answer = self.client.generate(f"SQL over multimodal_data for: {json.dumps(analysis, ensure_ascii=False)}")
        found = extract_sql(answer)
        return fallback_sql(analysis, self.default_limit) if found == DEFAULT_SQL else found

    def confidence(self, text: str, analysis: dict) -> float:
        try:
            answer = self.client.generate(f"CONFIDENCE from 0 to 1 for: {text}")
            return rule_confidence(analysis) if "{" in answer else extract_confidence(answer)
        except Exception:  # a model that can't judge leaves the judgement to the rules
            return rule_confidence(analysis)

    def plan(self, text: str, context: dict | None = None) -> dict:
        asked = with_context(text, context)
        try:
            analysis = self.analyze(asked)
            return {"original_query": text, "analysis": analysis, "sql": self.sql(analysis), "confidence": self.confidence(asked, analysis), "method": "model"}
        except Exception as e:  # reported in the plan, not hidden
            analysis = {"intent": {"type": "SELECT", "action": "find", "scope": "specific"}, "entities": [{"type": "content", "value": text}], "filters": [], "limit": self.default_limit}
            return {"original_query": text, "analysis": analysis, "sql": fallback_sql(analysis), "confidence": 0.3, "method": "fallback", "error": str(e)}

    def batch(self, texts: list[str]) -> list[dict]:
        return [self.plan(t) for t in texts]

    def search_advice(self, text: str, context: dict | None = None) -> dict:
        """A model's advice on how to search; {error, query} if it fails."""
        try:
            return repair_json(self.client.generate(f"SEARCH ADVICE as JSON: {with_context(text, context)}", 1500))
        except Exception as e:
            return {"error": str(e), "query": text}
