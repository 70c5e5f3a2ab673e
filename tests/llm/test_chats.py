"""Chat records against plain Python, on random conversations with calls; and the SQL's counts against both."""

import json
import random
from collections import defaultdict

import duckdb

from trovine.llm import chat_format as CF
from trovine.llm import oracles
from trovine.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, id string, result string"
TOOLS = {"search": {"query": ("string", True), "limit": ("integer", False)}, "calculate": {"expression": ("string", True)}}
KINDS = {"string": str, "integer": int, "boolean": bool, "object": dict, "array": list}


def dump(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def brute(rows, tools=TOOLS):
    """{(conv_id, record): (n_messages, counts, messages)} for records of one piece."""
    messages = {(c, -1 if t is None else t, r or "", x or "") for c, t, r, x in rows}
    calls, results, called = [], defaultdict(dict), {}
    for m in messages:
        c, turn, role, text = m
        v = loads(text)
        if role == "assistant" and '"tool_calls"' in text and isinstance(v, dict) and isinstance(v.get("tool_calls"), list) and v["tool_calls"]:
            own = []
            for idx, x in enumerate(v["tool_calls"]):
                o = x if isinstance(x, dict) else {}
                f = o.get("function") if isinstance(o.get("function"), dict) else {}
                args = o.get("arguments", f.get("arguments"))
                if isinstance(args, str):
                    try:
                        args = json.loads(args)
                    except ValueError:
                        pass
                deps = o["depends_on"] if isinstance(o.get("depends_on"), list) else []
                other = {k: y for k, y in o.items() if k not in ("id", "name", "arguments") and not (k == "depends_on" and isinstance(y, list))} if isinstance(x, dict) else x
                own.append({"m": m, "idx": idx, "id": o.get("id"), "name": o.get("name", f.get("name")), "args": args, "deps": deps, "other": other})
            ids = {y["id"] for y in own}
            level = {}
            while True:
                new = {y["idx"]: 1 + max([level[z["idx"]] for z in own if z["id"] in y["deps"]], default=-1)
                       for y in own if y["idx"] not in level and all(z["idx"] in level for z in own if z["id"] in y["deps"])}
                if not new:
                    break
                level |= new
            for y in own:
                y["level"], y["outside"] = level.get(y["idx"]), [d for d in y["deps"] if d not in ids]
            called[m] = own
            calls += own
        elif role == "tool" and isinstance(v, dict) and v.get("tool_call_id") is not None:
            content = v.get("content")
            if isinstance(content, str):
                content = loads(content) if loads(content) is not None else content
            key = (c, v["tool_call_id"])
            results[key][turn] = min(dump(content), results[key].get(turn, dump(content)))
    import hashlib

    by_id = defaultdict(lambda: defaultdict(list))
    for y in calls:
        if y["id"] is not None:
            by_id[y["m"][0], y["id"]][y["m"][1]].append(y)
    for key, turns in by_id.items():
        for turn, same in turns.items():
            first = min(same, key=lambda y: (hashlib.md5(y["m"][3].encode()).hexdigest(), y["idx"]))
            later = [t for t in (*turns, *results[key]) if t > turn]
            if turn in results[key]:
                first["result"] = results[key][turn]
            elif later and min(later) not in turns:
                first["result"] = results[key][min(later)]
    for y in calls:
        c, turn = y["m"][:2]
        y["unmet"] = sorted({d for d in y["outside"] if min(by_id[c, d], default=turn + 1) > turn})
        problems = set()
        params = tools.get(y["name"])
        if params is None:
            problems.add("unknown tool")
        if not isinstance(y["args"], dict):
            problems.add("arguments are no object")
        if params is not None:
            given = y["args"] if isinstance(y["args"], dict) else {}
            problems |= {f"missing {p}" for p, (_, must) in params.items() if must and p not in given}
            problems |= {f"unknown {p}" for p in given if p not in params}
            problems |= {f"type {p}" for p, z in given.items() if p in params and type(z) is not KINDS[params[p][0]]}
        y["problems"] = sorted(problems)
    out = {}
    for c, turn, role, text in messages:
        m = (c, turn, role, text)
        key = (c, turn // CF.TURNS_PER_RECORD)
        n, counts, shown = out.setdefault(key, (0, [0] * 5, []))
        out[key] = (n + 1, counts, shown)
        if m not in called:
            shown.append((turn, role, dump({"content": text, "role": role})))
            continue
        v, parts = json.loads(text), []
        for y in sorted(called[m], key=lambda y: (10**9 if y["level"] is None else y["level"], y["idx"])):
            for k, x in enumerate((True, "result" in y, bool(y["problems"]), y["level"] is None, bool(y["unmet"]))):
                counts[k] += x
            parts.append({
                "arguments": y["args"], "cyclic": y["level"] is None, "depends_on": y["deps"], "id": y["id"], "linked": "result" in y, "name": y["name"], "other": y["other"],
                "problems": y["problems"], "result": json.loads(y.get("result", "null")), "unmet": y["unmet"], "valid": not y["problems"],
            })
        other = {k: x for k, x in v.items() if k not in ("content", "tool_calls")}
        shown.append((turn, role, dump({"content": v.get("content"), **({"other": other} if other else {}), "role": role, "tool_calls": parts})))
    return {k: (n, *counts, "[" + ",".join(x[2] for x in sorted(shown)) + "]") for k, (n, counts, shown) in out.items()}


def random_rows(rng, conversations):
    ids = ["c0", "c1", "c2", "c3"]
    for c in range(conversations):
        conv = None if c % 17 == 0 else c
        for _ in range(rng.randrange(1, 9)):
            turn = rng.choice([None, rng.randrange(6), rng.randrange(6), rng.randrange(250, 262)])
            kind = rng.randrange(6)
            if kind == 0:
                yield conv, turn, rng.choice(["user", None]), rng.choice(["Hi \"x\"\n\u0001é", "", None, '{"tool_calls": 3}'])
            elif kind < 4:
                calls = []
                for _ in range(rng.randrange(1, 5)):
                    x = {"id": rng.choice(ids), "name": rng.choice(["search", "calculate", "nothing"]), "depends_on": rng.sample(ids, rng.choice([0, 0, 1, 2]))}
                    args = rng.choice([{"query": "q", "limit": 3}, {"limit": "3", "b.c": [1, {"z": 1, "a": None}]}, {"expression": "1+1"}, {"query": 1.5}, "no json", 7])
                    x["arguments"] = json.dumps(args) if isinstance(args, dict) and rng.random() < 0.5 else args
                    if rng.random() < 0.2:
                        x = {"type": "function", "function": {"name": x["name"], "arguments": x["arguments"]}, "id": x["id"]}
                    for k in ("id", "depends_on"):
                        if rng.random() < 0.2:
                            x.pop(k, None)
                    calls.append(x if rng.random() < 0.95 else rng.choice(["text", 5]))
                whole = {"content": rng.choice(["See.", None, ["part", {"b": 1, "a": 2}]]), "tool_calls": calls} | ({"refusal": {"y": 1, "x": 2}} if rng.random() < 0.3 else {})
                yield conv, turn, "assistant", rng.choice([json.dumps(whole), json.dumps(whole), json.dumps(whole)[:-1], '{"tool_calls": []}'])
            else:
                yield conv, turn, "tool", json.dumps({"tool_call_id": rng.choice(ids), "content": rng.choice(["plain", '{"b": 1, "a": 2}', {"k": [1]}])})


def test_records_equal_brute_force_and_sql(spark):
    rows = list(random_rows(random.Random(4), 240))
    rows += rows[:40]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = {(r.conv_id, r.record): (r.n_messages, r.n_calls, r.n_linked, r.n_invalid, r.n_cyclic, r.n_unmet, r.json) for r in CF.format_chats(df, spark.sql(Q.SCHEMAS)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    assert all(sum(x[n] for x in want.values()) > 20 for n in range(1, 6)), "every count is exercised"
    with duckdb.connect() as con:
        con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
        sql = {(r[0], r[1]): r[2:] for r in con.execute(f"SELECT conv_id, record, n_messages, n_calls, n_linked, n_invalid, n_cyclic, n_unmet FROM ({oracles.CHATS}) x").fetchall()}
    assert sql == {k: x[:6] for k, x in want.items()}


def test_a_chain_of_calls_and_a_crowded_record(spark):
    chain = [{"id": f"n{k}", "name": "x", "arguments": {}, "depends_on": [f"n{k - 1}"] if k else []} for k in range(60)]
    random.Random(1).shuffle(chain)
    rows = [(1, 0, "assistant", json.dumps({"content": "", "tool_calls": chain})), (1, 1, "user", "long " * 200_000)]
    rows += [(None, None, "user", f"message {k}") for k in range(3000)]
    got = CF.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    first = next(r for r in got if r.conv_id == 1)
    assert [c["id"] for c in json.loads(first.json)[0]["tool_calls"]] == [f"n{k}" for k in range(60)] and first.n_invalid == first.n_cyclic == first.n_unmet == 0
    crowd = [r for r in got if r.conv_id is None]
    assert len(crowd) == 3 and sum(r.n_messages for r in crowd) == 3000 and max(r.n_messages for r in crowd) < 2 * CF.MESSAGES_PER_RECORD
    assert sorted(m["content"] for r in crowd for m in json.loads(r.json)) == sorted(f"message {k}" for k in range(3000))


def test_an_empty_table_and_no_calls(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    assert CF.format_chats(df.where("false")).count() == 0
    assert [r.json for r in CF.format_chats(df, spark.sql(Q.SCHEMAS)).collect()] == ['[{"content":"hi","role":"user"}]']
