import json

import pytest
from pyspark.sql import functions as F

from tracesieve.operators import trajectories as tr

STEP = {
    "step_id": 7,
    "source": "Coding Agent",
    "timestamp": "2024-05-01T10:00:00Z",
    "message": "hi",
    "reasoning_content": "",
    "tool_calls": [
        {"tool_call_id": "c1", "function_name": "run", "arguments": {"cmd": ["a", 1]}},
        {"name": "look", "args": {"x": 1}},
        {},
    ],
    "observation": {"results": [{"source_call_id": "c1", "content": "ok"}, {"source_call_id": "c2"}]},
    "metrics": {"prompt_tokens": 5, "cost_usd": 0.01236},
}


def sessions(spark, *trees):
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)]
    return tr.parse_trajectory(spark.createDataFrame(rows, "id int, redacted string"))


def test_steps_of_both_forms(spark):
    df = sessions(
        spark,
        {"steps": [STEP, {"source": "user", "message": "m"}]},
        {
            "steps": [{"source": "lost"}],
            "lines": [
                {"steps": [{"step_id": 9, "source": "a"}, {"source": "b"}]},
                {"source": "user", "message": "x"},
                {"note": 1},
                {"source": "", "message": "y"},
                {"step_id": 0, "source": "c"},
                {"step_id": 4, "source": "d"},
            ],
        },
        {"lines": [], "steps": [STEP]},
        {},
    )
    rows = tr.steps(df, ["id"]).orderBy("id", "step_index").collect()
    got = [(r["id"], r["step_index"], r["step_id"], r["source"]) for r in rows]
    assert got == [
        (0, 0, 7, "Coding Agent"),
        (0, 1, None, "user"),
        (1, 0, 9, "a"),
        (1, 1, None, "b"),
        (1, 2, 2, "user"),
        (1, 3, 5, "c"),
        (1, 4, 4, "d"),
    ]


def test_calls_observations_metrics(spark):
    steps = tr.steps(
        sessions(spark, {"steps": [STEP, {"observation": {"output": "o"}}, {"observation": {}}]}), ["id"]
    )
    keys = ["id", "step_index"]
    calls = [(r["tool_call_id"], r["name"], r["arguments"]) for r in tr.tool_calls(steps, keys).collect()]
    assert calls == [("c1", "run", '{"cmd":["a",1]}'), (None, "look", '{"x":1}'), (None, "unknown", "{}")]
    seen = tr.observations(steps, keys).orderBy(*keys, "result_index").collect()
    assert [(r["source_call_id"], r["content"]) for r in seen] == [
        ("c1", "ok"),
        ("c2", '{"source_call_id":"c2"}'),
        (None, "o"),
        (None, "{}"),
    ]
    [m] = tr.step_metrics(steps, keys).collect()
    assert (m["prompt_tokens"], m["total_tokens"], m["cost_usd"], m["cost_text"]) == (5, None, 0.01236, "$0.0124")
    text = tr.step_text(steps, keys).orderBy("step_index").first()
    assert (text["message"], text["reasoning"]) == ("hi", None)


def test_odd_steps_and_results_lose_nothing(spark):
    df = sessions(
        spark,
        {"steps": [{"source": "a", "observation": {"results": [{"stdout": "hello"}, "txt", 5]}}, "junk", 3, {"source": "b", "observation": "plain text"}]},
        {"lines": ["junk", {"source": "c", "observation": {"stdout": "x"}}, {"steps": ["odd", {"source": "d", "step_id": "t", "message": "m"}]}]},
    )
    steps = tr.steps(df, ["id"])
    rows = steps.orderBy("id", "step_index").collect()
    assert [(r["id"], r["step_id"], r["source"], r["message"]) for r in rows] == [
        (0, None, "a", None), (0, None, None, None), (0, None, None, None), (0, None, "b", None),
        (1, 2, "c", None), (1, None, None, None), (1, None, "d", "m"),
    ]
    seen = tr.observations(steps, ["id", "step_index"]).orderBy("id", "step_index", "result_index").collect()
    assert [(r["id"], r["step_index"], r["result_index"], r["content"]) for r in seen] == [
        (0, 0, 0, '{"stdout":"hello"}'), (0, 0, 1, '"txt"'), (0, 0, 2, "5"), (0, 3, 0, '"plain text"'), (1, 0, 0, '{"stdout":"x"}'),
    ]


def test_session_info_and_final_metrics(spark):
    df = sessions(
        spark,
        {"schema_version": "1", "session_id": "s", "agent": {"name": "n", "version": "2", "model_name": "m"},
         "final_metrics": {"total_tokens": 9}},
        {"session_id": ""},
    )
    rows = [tuple(r) for r in tr.session_info(df, ["id"]).orderBy("id").collect()]
    assert rows == [(0, "1", "s", "n v2", "m"), (1, "—", "—", "— v", "—")]
    old = tr.session_info(df, ["id"], missing="Unknown", missing_version="Unknown")
    assert tuple(old.where("id = 1").first()) == (1, "Unknown", "Unknown", "Unknown vUnknown", "Unknown")
    final = tr.final_metrics(df, ["id"]).collect()
    assert [(r["id"], r["total_tokens"], r["cost_text"]) for r in final] == [(0, 9, None)]


@pytest.mark.parametrize(
    "source, role",
    [("User", "user"), ("sub-agent", "assistant"), ("ASSISTANT", "assistant"), ("tool", "system"),
     ("", "system"), (None, "system"), ("user-agent", "user")],
)
def test_role(spark, source, role):
    df = spark.createDataFrame([(source,)], "s string")
    assert df.select(tr.step_role(F.col("s"))).first()[0] == role


def test_time(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01T12:00:00+02:00",), ("",), ("soon",)], "t string")
    got = [r[0] for r in df.select(F.unix_seconds(tr.step_time(F.col("t")))).collect()]
    assert got == [1714557600, 1714557600, None, None]
