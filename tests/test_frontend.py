"""Parsers, planner, settings: text in, structures out."""

import datetime as dt
import json

import pytest

from quillstream.operators import predicates
from quillstream.plans import ir, nl_rules, planner, sqlpp
from quillstream.sources import config

NOW = dt.datetime(2024, 3, 13, 15, 30)


@pytest.mark.parametrize("text,want", [("select 1", True), ("  WITH a AS (SELECT 1) SELECT * FROM a", True), ("find a landmark for me", False), ("找出所有批量测试数据", False)])
def test_router(text, want):
    assert nl_rules.is_sql(text) is want


def test_types_terms_filters():
    q = nl_rules.parse("找出上个月在新加坡拍摄的所有包含黄色汽车的照片，5张")
    assert q.types == ("image",)
    assert q.filters == {"location": "新加坡", "color": "黄", "object": "汽车"}
    assert q.period == ("last_month", ())
    assert q.limit == 5
    assert "黄色汽车的照片" in q.terms
    assert nl_rules.parse("hello").types == ("image", "video", "audio", "text", "iot")
    assert nl_rules.parse("包含a 包含a 包含b").terms == ("a", "b")
    assert nl_rules.default("x").terms == ("x",)


@pytest.mark.parametrize("kind,groups,lo,hi", [
    ("today", (), "2024-03-13", "2024-03-14"), ("yesterday", (), "2024-03-12", "2024-03-13"), ("last_week", (), "2024-03-04", "2024-03-11"),
    ("last_month", (), "2024-02-01", "2024-03-01"), ("specific_date", ("5", "6"), "2024-05-06", "2024-05-07"), ("year_month", ("2023", "12"), "2023-12-01", "2024-01-01"),
])
def test_periods(kind, groups, lo, hi):
    got = predicates.resolve_time_range(kind, groups, NOW)
    assert [g.strftime("%Y-%m-%d") for g in got] == [lo, hi]


def test_period_that_does_not_exist():
    assert predicates.resolve_time_range("specific_date", ("13", "40"), NOW) is None


def test_rewrite():
    got = sqlpp.rewrite('SELECT * FROM t WHERE CAPTION_CONTAINS("it\'s") AND metadata->>\'k\' = "v;";')
    assert got == "SELECT * FROM t WHERE CAPTION_CONTAINS(content, 'it\\'s') AND metadata['k'] = 'v;'"
    assert sqlpp.rewrite("SELECT f(q), 'q' FROM t", {"q": [1.0, 2]}) == "SELECT f(array(1.0D, 2.0D)), 'q' FROM t"


def test_answers_are_repaired():
    assert planner.repair_json('x ```json\n{"a": 1}\n``` y') == {"a": 1}
    assert planner.repair_json('so {"a": {"b": 2}} it is') == {"a": {"b": 2}}
    assert planner.repair_json("nothing")["intent"]["type"] == "SELECT"
    assert planner.extract_sql("Here:\n```sql\nSELECT 1\n```") == "SELECT 1"
    assert planner.extract_sql("Sure.\nSELECT a\nFROM t;\nbye") == "SELECT a FROM t"
    assert planner.extract_sql("no") == planner.DEFAULT_SQL
    assert planner.extract_confidence("100 then 0.85") == 0.85
    assert planner.extract_confidence("none") == 0.7


def test_rule_confidence_and_fallback():
    analysis = {"intent": {"type": "SELECT"}, "entities": [{"type": "content", "value": "o'x"}, {"type": "location", "value": "S"}], "filters": [{"type": "content", "value": "sun"}]}
    assert planner.rule_confidence(analysis) == 1.0
    assert planner.rule_confidence({}) == 0.5
    assert planner.fallback_sql(analysis) == "SELECT * FROM multimodal_data WHERE SEMANTIC_MATCH(content, 'o\\'x') AND metadata->>'location' = 'S' AND CAPTION_CONTAINS('sun') LIMIT 100"


def test_failover_and_fallback():
    class Down(planner.Client):
        def generate(self, prompt, max_tokens=1000):
            raise OSError("down")

    settings = config.Settings(provider="local", providers={"local": config.Provider(), "openai": config.Provider()})
    held = planner.Providers(settings, {"local": lambda p: Down(), "openai": lambda p: planner.MockClient({}, "0.9")})
    assert held.generate("x") == "0.9"
    assert held.health() == {"local": False, "openai": True, "mock": True} and held.best() == "openai"
    plan = planner.Planner(Down()).plan("dogs")
    assert plan["method"] == "fallback" and plan["confidence"] == 0.3 and "dogs" in plan["sql"]
    assert planner.with_context("q", {"conversation_history": list("abcd")}).endswith("b; c; d")


def test_ir_from_dict():
    q = ir.from_dict({"type": "natural_language", "data_types": ["text"], "filters": [{"type": "color", "value": "red"}], "time_range": {"type": "today", "value": "今天"}})
    assert q.types == ("text",) and q.filters == {"color": "red"} and q.period == ("today", ())


def test_settings(tmp_path):
    env = {"QUILL_DEFAULT_LIMIT": "7", "QUILL_FALLBACK": "false", "QUILL_OPENAI_API_KEY": "k", "HOST": "h"}
    s = config.from_env(env)
    assert s.default_limit == 7 and s.fallback is False and s.providers["openai"].api_key == "k"
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps({"provider": "local", "providers": {"local": {"base_url": "http://${HOST}:${PORT:1}"}}}))
    assert config.from_file(str(path), env).providers["local"].base_url == "http://h:1"
    config.save(s, str(tmp_path / "o.json"))
    assert [s.clamp(x) for x in (None, 0, 5, 9999)] == [7, None, 5, 1000]
    with pytest.raises(ValueError):
        config.from_dict({"nope": 1})
