import json

from loomgraph.llm import chat


def turns(spark, *records):
    df = spark.createDataFrame([(k, r if r is None or isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)], "conv_id long, record string")
    out = {}
    for r in chat.chat_turns(df).orderBy("conv_id", "turn").collect():
        out.setdefault(r.conv_id, []).append((r.turn, r.role, r.content))
        out[r.conv_id, "layout"] = r.layout
    return out


TWO = [(0, "user", "q"), (1, "assistant", "a")]


def test_every_layout_becomes_the_same_turns(spark):
    layouts = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 5},
        "nested_messages": {"data": {"messages": [{"role": "human", "content": "q"}, {"role": "bot", "content": "a"}]}},
        "conversation": {"conversation": [{"role": " User ", "content": "q"}, {"role": "model", "content": "a"}]},
        "from_value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "role_value": {"conversations": [{"role": "user", "value": "q"}, {"role": "assistant", "value": "a"}]},
        "dialog": {"dialog": [{"speaker": "customer", "text": "q"}, {"speaker": "agent", "text": "a"}]},
        "turns": {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        "preferred": {"chosen": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "rejected": [{"role": "user", "content": "x"}]},
        "instruction": {"instruction": "q", "input": "", "output": "a"},
        "instruction_response": {"instruction": "q", "response": "a"},
        "prompt_completion": {"prompt": "q", "completion": "a"},
        "prompt_response": {"prompt": "q", "response": "a"},
        "question_answer": {"question": "q", "answer": "a"},
        "query_response": {"query": "q", "response": "a"},
        "inputs_targets": {"inputs": "q", "targets": "a"},
    }
    got = turns(spark, *layouts.values())
    for k, name in enumerate(layouts):
        assert (got[k, "layout"], got[k]) == (name, TWO)


def test_system_texts_inputs_history_and_parts(spark):
    got = turns(
        spark,
        {"system": "s", "instruction": "q", "input": "more", "output": "a"},
        {"system_prompt": "s", "question": "q", "response": "a"},
        {"history": [["h", "i"]], "instruction": "q", "output": "a"},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "!"}]}, {"role": "assistant", "content": None}]},
    )
    assert got[0] == [(0, "system", "s"), (1, "user", "q\n\nmore"), (2, "assistant", "a")]
    assert got[1] == [(0, "system", "s"), (1, "user", "q"), (2, "assistant", "a")]
    assert got[2] == [(0, "user", "h"), (1, "assistant", "i"), (2, "user", "q"), (3, "assistant", "a")]
    assert got[3] == [(0, "user", "q!"), (1, "assistant", None)]


def test_what_has_no_turns(spark):
    assert turns(spark, None, "", "no json", "[1]", "3", {"x": 1}, {"messages": []}, {"messages": "text"}, {}) == {}


def test_fingerprints_are_of_paths_not_of_values_or_types(spark):
    rows = [{"prompt": "p", "completion": "c", "n": 1}, {"completion": "other", "n": "1", "prompt": "longer"}, {"prompt": "p", "completion": "c"}, {"odd name: STRING": 1}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(rows)], "conv_id long, record string")
    got = sorted((r.n, r.layout) for r in chat.layouts(df).filter("layout IS NOT NULL").collect())
    assert got == [(1, "prompt_completion"), (2, "prompt_completion")]


def test_paths():
    assert chat.paths_of("OBJECT<a: STRING, b: ARRAY<OBJECT<c: DECIMAL(3,1), `d e`: VOID>>>") == {"a", "b", "b[]", "b[].c", "b[].d e"}
    assert chat.paths_of("STRING") == frozenset() and chat.paths_of("ARRAY<ARRAY<STRING>>") == {"[]", "[][]"}


def test_op4_agrees_with_its_sql(spark, small, duck):
    got = sorted(map(tuple, chat.op4_chat(spark, small).select("conv_id", "turn", "role", "content", "layout").collect()))
    assert got == sorted(duck.execute(chat.OP4_SQL).fetchall())
    assert len({g[4] for g in got}) >= 3


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a"), (None, 0, "user", "x"), (2, 0, "user", ""), (2, 1, "assistant", "é" * 50_000), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    t = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = sorted(map(tuple, chat.chat_turns(chat.as_records(t)).select("conv_id", "turn", "role", "content").collect()), key=str)
    assert got == sorted(rows[:6] + [(3, 1, "assistant", "a"), (3, 2, "assistant", "a")], key=str)
    assert chat.chat_turns(chat.as_records(t.limit(0))).count() == 0
