import json
import random

from alphaline.llm import toolcalls

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """Level and anchor of each call by walking the graph; None in or behind a cycle."""
    out = {}
    for conv, calls in conversations.items():
        first = {}
        for turn, part, call_id, needs in sorted(calls, key=lambda c: c[:2]):
            if call_id is not None:
                first.setdefault(call_id, (turn, needs))
        memo = {}

        def walk(call_id, path, first=first, memo=memo):
            if call_id in path:
                return None
            if call_id not in memo:
                turn, needs = first[call_id]
                found = [walk(n, path | {call_id}) for n in set(needs) if n in first]
                memo[call_id] = None if None in found else (max([0, *(lv + 2 for lv, _ in found)]), max([turn, *(a for _, a in found)]))
            return memo[call_id]

        for call_id in first:
            out[conv, call_id] = walk(call_id, frozenset())
            if out[conv, call_id] is None:
                memo.clear()
    return out


def frame(spark, conversations):
    rows = []
    for conv, calls in conversations.items():
        for turn in {c[0] for c in calls}:
            parts = sorted((c for c in calls if c[0] == turn), key=lambda c: c[1])
            rows.append((conv, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "t", "arguments": {}, "depends_on": needs} for _, _, i, needs in parts]})))
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def levels(spark, conversations):
    found = toolcalls.format_chats(frame(spark, conversations), {"t": {}}, exchanges=False).collect()
    assert {r.status for r in found if r.call_id is None} <= {"unidentified"}
    return {(r.conv_id, r.call_id): (r.level, r.anchor) if r.status != "cycle" else None for r in found if r.call_id is not None and r.status != "duplicate"}


def test_random_graphs_equal_a_walk(spark):
    rng = random.Random(5)
    conversations = {}
    for conv in range(40):
        n = rng.randint(1, 14)
        names = [f"c{k}" for k in range(n)]
        calls = []
        for k in range(n):
            back = names[:k] if rng.random() < 0.85 else names
            needs = [rng.choice([*back, "absent", None] if back else ["absent", None]) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            calls.append((rng.randint(0, 5), 0, rng.choice([names[k]] * 9 + [None]), needs))
        calls += [(9, 0, rng.choice(names), [rng.choice(names)])]
        conversations[conv] = [(turn, part, i, needs) for part, (turn, _, i, needs) in enumerate(calls)]
        by_turn = {}
        renumbered = []
        for turn, _, i, needs in conversations[conv]:
            renumbered.append((turn, by_turn.get(turn, 0), i, needs))
            by_turn[turn] = by_turn.get(turn, 0) + 1
        conversations[conv] = renumbered
    expected = brute(conversations)
    assert None in expected.values() and max(v[0] for v in expected.values() if v) >= 8
    assert levels(spark, conversations) == expected


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 2000, []
    real = toolcalls.cut
    monkeypatch.setattr(toolcalls, "cut", lambda df, label: rounds.append(label) or real(df, label))
    chain = {1: [(k, 0, f"c{k}", [f"c{k - 1}"] if k else []) for k in range(n)]}
    found = levels(spark, chain)
    assert found == {(1, f"c{k}"): (2 * k, k) for k in range(n)}
    assert rounds.count("op4-chain") < 15


def test_null_identifiers_link_nothing(spark):
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [{"name": "t", "arguments": {}}, {"id": None, "name": "t", "arguments": {}, "depends_on": [None]}]})),
        (1, 1, "tool", json.dumps({"tool_call_id": None, "content": 1})),
        (1, 2, "assistant", json.dumps({"tool_calls": [{"id": "None", "name": "t", "arguments": {}, "depends_on": [None, None]}]})),
        (1, 3, "tool", json.dumps({"tool_call_id": "None", "content": 1})),
        (None, 4, "tool", json.dumps({"tool_call_id": "a", "content": 1})),
    ]
    found = toolcalls.format_chats(spark.createDataFrame(rows, SCHEMA), {"t": {}}, exchanges=False).collect()
    assert {(r.turn, r.part): (r.status, r.level) for r in found} == {(0, 0): ("unidentified", 0), (0, 1): ("unidentified", 0), (1, 0): ("unidentified", 0), (2, 0): ("linked", 0), (3, 0): ("linked", 1), (4, 0): ("message", 0)}
    assert '"id":null' in next(r.line for r in found if (r.turn, r.part) == (1, 0))
