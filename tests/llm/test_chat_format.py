import json
import re
from collections import Counter

from merklake.llm import queries
from merklake.llm.chat_format import MESSAGES, Parameter, format_chats

SCHEMAS = {"f": {"n": Parameter("integer", least=0, most=9), "s": Parameter(required=False, most=3)}, "g": {}}
FORM = {"integer": r"-?(0|[1-9]\d*)", "number": r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", "boolean": "true|false"}


def faults(name, arguments, schemas):
    if name not in schemas:
        return [f"tool:{name or ''}"]
    out = [f"unknown:{k}" for k in arguments if k not in schemas[name]]
    for k, p in schemas[name].items():
        v = arguments.get(k)
        if v is None:
            out += [f"missing:{k}"] * p.required
        elif p.kind != "string" and not re.fullmatch(FORM[p.kind], v):
            out.append(f"type:{k}")
        else:
            size = len(v) if p.kind == "string" else float(v) if p.kind != "boolean" else 0
            if p.least is not None and size < p.least or p.most is not None and size > p.most:
                out.append(f"range:{k}")
    return sorted(out)


def dumped(**fields):
    return json.dumps({k: v for k, v in fields.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def plain(name, arguments, schemas):
    def value(k, v):
        p = schemas.get(name, {}).get(k)
        return json.loads(v) if p and p.kind in FORM and re.fullmatch(FORM[p.kind], v) else v

    return {k: value(k, v) for k, v in arguments.items() if v is not None}


def brute(messages, schemas):
    calls = {}
    for conv, turn, _, _, made, _ in sorted((m for m in messages if m[0] is not None and m[1] is not None), key=lambda m: m[:2]):
        for place, c in enumerate(made or [], 1):
            if c[0] is not None:
                calls.setdefault((conv, c[0]), (turn, place, c[3]))
    answered = {}
    for m in sorted((m for m in messages if m[2] == "tool"), key=lambda m: m[1]):
        answered.setdefault((m[0], m[5]), []).append(m[1])

    def chain(key):
        """Turns by which what a call hangs on is done, nearest first; None for a cycle."""
        done, seen, key = [], {key}, (key[0], calls[key][2])
        while key in calls:
            if key in seen:
                return None
            seen.add(key)
            done.append(max([calls[key][0], *answered.get(key, [])[:1]]))
            key = (key[0], calls[key][2])
        return done

    out = []
    for conv, turn, role, text, made, call_id in messages:
        if role == "tool":
            key = (conv, call_id)
            above = chain(key) if key in calls else []
            keys = (None, None) if above is None else (max([turn, *above, *([calls[key][0]] if key in calls else [])]), 2 * len(above) + (key in calls))
            out.append((conv, *keys, turn, 0, "result", call_id, "ok" if key in calls else "no_call", dumped(call=call_id, content=text, role=role)))
        else:
            out.append((conv, turn, 0, turn, 0, "message", None, "ok", dumped(content=text, role=role)))
        for place, (i, name, arguments, _) in enumerate(made or [], 1):
            own, above = calls.get((conv, i)), chain((conv, i)) if (conv, i) in calls else []
            wrong = faults(name, arguments or {}, schemas)
            status = (
                "duplicate" if own and own[:2] != (turn, place) else "cycle" if own and above is None else "invalid " + " ".join(wrong) if wrong
                else "ok" if (conv, i) in answered else "no_result"
            )
            keys = (None, None) if above is None else (max([turn, *above, *([own[0]] if own else [])]), 2 * len(above))
            text = dumped(arguments=plain(name, arguments or {}, schemas), call=i, name=name, role=role)
            out.append((conv, *keys, turn, place, "call", i, status, text))
    return out


ROWS = [
    (1, 0, "user", "hi \"x\" \\ \n\t\x01é日", None, None),
    (1, 1, "assistant", None, [("a", "f", {"n": "3", "s": "abc"}, None), ("b", "f", {"n": "10"}, "a"), ("c", "f", {"n": "03", "zz": "1"}, "b")], None),
    (1, 2, "tool", "result a", None, "a"),
    (1, 9, "assistant", "", [("d", "g", {}, None), ("e", "g", None, "f"), ("f", "g", {"q": None}, "e"), ("a", "h", {"n": "1"}, None)], None),
    (1, 3, "assistant", "late", [("x", "f", {"s": "long"}, "d")], None),
    (1, 4, "tool", "early result", None, "d"),
    (1, 5, "tool", "nobody asked", None, "zzz"),
    (2, 0, "tool", "other conversation", None, "a"),
    (2, 1, "user", None, None, None),
    (2, 1, "user", None, None, None),
    (None, None, "user", "lost", None, None),
    (3, 1, "assistant", "no id", [(None, "f", {"n": "-1"}, None), ("s", None, {"n": "1"}, "s")], None),
]


def shown(rows, free):
    return Counter((*(None if r[5 + 2] == free else x for x in r[1:3]), r[0], *r[3:]) for r in rows)


def test_against_brute_force(spark):
    got = [tuple(r) for r in format_chats(spark.createDataFrame(ROWS, MESSAGES), SCHEMAS).collect()]
    hung = {i for conv, *_, i, s, _ in got if s == "cycle"}
    assert hung == {"e", "f", "s"}
    assert shown(got, "cycle") == shown(brute(ROWS, SCHEMAS), "cycle")
    order = [(r[6], r[5]) for r in sorted((r for r in got if r[0] == 1), key=lambda r: r[1:5])]
    assert order.index(("d", "call")) < order.index(("d", "result")) < order.index(("x", "call"))  # though turns say otherwise
    assert format_chats(spark.createDataFrame([], MESSAGES), SCHEMAS).count() == 0


def test_long_chain(spark):
    rows = [(7, 1000 - i, "assistant", None, [(str(i), "g", {}, str(i - 1))], None) for i in range(300)]
    got = {r.id: (r.latest, r.depth) for r in format_chats(spark.createDataFrame(rows, MESSAGES), SCHEMAS).where("kind = 'call'").collect()}
    assert got == {str(i): (1000, 2 * i) for i in range(300)}


def test_query(spark, sf_dir):
    messages = queries.tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")).collect()
    rows = [(m.conv_id, m.turn, m.role, m.text, [tuple(c) for c in m.calls] if m.calls else None, m.call_id) for m in messages]
    got = [tuple(r) for r in queries.op2_chat_format(spark, sf_dir).collect()]
    assert Counter(got) == Counter(brute(rows, queries.TOOLS))
    assert {r[7].split()[0] for r in got} >= {"ok", "invalid"}
