"""Tokens against the library, and chat linking against plain Python."""

import json
import random
import re

import public_tokenizers as P
import pytest
import tiktoken

from canvass.llm import byte_bpe, chat_format

PATHS = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@pytest.mark.parametrize("name", PATHS)
def test_encoding_equals_the_library(docs, rows, name):
    path = P.path(name)
    with open(path, "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.encode(docs, path, P.PATTERN, decoded=True, keep=("lang",)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert list(r["ids"]) == library.encode_ordinary(text), r["doc_id"]
        assert bytes(r["decoded"]) == text.encode()
    back = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert all(bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") for r in back)


def test_pieces_equal_plain_merging():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    with open(P.path(PATHS[0]), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    codec = byte_bpe.Codec(ranks, P.PATTERN)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(st.binary(min_size=1, max_size=40), st.text("aeinorst éü", min_size=1, max_size=40).map(str.encode)))
    def same(piece):
        whole = ranks.get(piece)
        assert list(codec.encode_piece(piece)) == ([whole] if whole is not None else byte_bpe.merge(piece, ranks))

    same()
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for text in ("ab" * 20_000, "x" * 100_000, "".join(r.choice("aeinorst") for _ in range(300_000)), "日本語" * 30_000):
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_empty_table(no_docs):
    assert byte_bpe.encode(no_docs, P.path(PATHS[0]), P.PATTERN).count() == 0


SCHEMA = "conv_id long, position long, kind string, call_id string, name string, arguments string, content string, parent_id string, depth string"
TOOLS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}}, "c": {"enum": ["x", "y"]}}}}


def message(conv, pos, kind, call, arguments=None, content=None, parent=None, name="add"):
    return (conv, pos, kind, call, name if kind == "call" else None, arguments, content, parent, "clash")


def test_linking(spark):
    rows = [
        message(1, 0, "call", "a", '{"b":["é"],"a":1}'), message(1, 1, "result", "a", content="r1"), message(1, 2, "result", "a", content="r0"),
        message(1, 3, "call", "b", '{"a":2}', parent="a"), message(1, 4, "call", "c", '{"a":-1,"z":0}', parent="b"), message(1, 5, "result", "gone", content="lost"),
        message(2, 0, "call", "p", '{"a":1}', parent="q"), message(2, 1, "call", "q", '{"a":1}', parent="p"), message(2, 2, "call", "s", "{bad", parent="nowhere"),
        message(2, 3, "call", None, None), message(2, 4, "result", None, content="?"), message(3, 0, "call", "t", '{"a":true}'), message(3, 1, "call", "u", '{"a":1,"b":["abc"],"c":"w"}', name="add"), message(3, 2, "call", "v", "{}", name="unknown"),
        message(None, 0, "call", "n", "{}"),
    ]
    rows.append(rows[0])
    d = spark.createDataFrame(rows, SCHEMA)
    got = {(r["conv_id"], r["position"]): r for r in chat_format.link(d, TOOLS).collect()}
    assert len(got) == 12
    assert (got[1, 0]["status"], got[1, 0]["depth"], got[1, 0]["n_results"]) == ("ok", 0, 2)
    assert got[1, 0]["json"] == '{"arguments":{"a":1,"b":["é"]},"call_id":"a","conv_id":1,"depth":0,"name":"add","result":"r1"}'
    assert (got[1, 3]["status"], got[1, 3]["depth"]) == ("no_result", 1)
    assert (got[1, 4]["status"], got[1, 4]["depth"], list(got[1, 4]["errors"])) == ("invalid_arguments", 2, ["$.a: too small", "$: z unknown"])
    assert got[1, 5]["status"] == "orphan_result"
    assert got[2, 0]["status"] == got[2, 1]["status"] == "cycle"
    assert (got[2, 2]["status"], got[2, 2]["depth"]) == ("invalid_arguments", 0)
    assert got[2, 4]["status"] == "orphan_result"
    assert list(got[3, 0]["errors"]) == ["$.a: not integer"]
    assert list(got[3, 1]["errors"]) == ["$.b[0]: too long", "$.c: not in enum"]
    assert list(got[3, 2]["errors"]) == ["$: no schema"]


def test_arguments_that_are_hard_to_write(spark):
    """Surrogates, nesting, numbers that JSON lacks, types in lists."""
    tools = {"add": {"type": ["object", "null"], "properties": {"a": {"type": ["string", "number"]}, "b": {"type": "widget"}}}}
    hard = ['{"a":"\\ud800"}', "[" * 200_000 + "]" * 200_000, '{"a":NaN}', '{"a":1e999}', "null", "3", '{"a":[]}', '{"b":1}', '{"a":"x","a":1.50}', "", '{"a":-Infinity}', '{"\\udc00":1}', '{"a":"' + "y" * 300_000 + '"}']
    d = spark.createDataFrame([message(1, i, "call", f"c{i}", a) for i, a in enumerate(hard)], SCHEMA)
    got = {r["position"]: r for r in chat_format.link(d, tools).collect()}
    found = {i: (r["status"], list(r["errors"])) for i, r in got.items()}
    ok, bad = ("no_result", []), lambda e: ("invalid_arguments", [e])
    assert found == {0: ok, 1: bad("$: nested too deeply"), 2: bad("$: not JSON"), 3: bad("$: not JSON"), 4: ok, 5: bad("$: not object or null"), 6: bad("$.a: not string or number"), 7: bad("$.b: not widget"), 8: ok, 9: bad("$: not JSON"), 10: bad("$: not JSON"), 11: ok, 12: ok}
    assert json.loads(got[0]["json"])["arguments"] == {"a": "\ud800"}
    assert json.loads(got[1]["json"])["arguments"] == hard[1]
    assert json.loads(got[8]["json"])["arguments"] == {"a": 1.5}
    assert all(chat_format.canonical(json.loads(r["json"])) == r["json"] for r in got.values())


def plain_order(rows):
    """conv_id -> its calls' ids in the order of depth and position."""
    calls = {(r[0], r[3]): r for r in rows if r[2] == "call"}
    depth = lambda r: 1 + depth(calls[r[0], r[7]]) if (r[0], r[7]) in calls else 0
    out = {}
    for r in sorted(calls.values(), key=lambda r: (r[0], depth(r), r[1])):
        out.setdefault(r[0], []).append(r[3])
    return out


@pytest.mark.parametrize("per_task", [1_000_000, 30])
def test_order(spark, monkeypatch, per_task):
    """One conversation of many calls that fills several partitions, and small ones."""
    monkeypatch.setattr(chat_format, "ROWS_PER_TASK", per_task)
    r = random.Random(3)
    rows = [message(c, i, "call", f"c{i}", '{"a":1}', parent=f"c{r.randrange(i)}" if i and r.random() < 0.8 else None) for c, n in ((1, 300), (2, 1), (3, 7), (9, 40)) for i in range(n)]
    r.shuffle(rows)
    placed = chat_format.ordered(chat_format.link(spark.createDataFrame(rows, SCHEMA), TOOLS)).cache()
    got = {}
    for x in sorted(placed.collect(), key=lambda x: (x["conv_id"], x["place"])):
        got.setdefault(x["conv_id"], []).append(x["call_id"])
        assert x["place"] == len(got[x["conv_id"]])
    assert got == plain_order(rows)
    pages = {(x["conv_id"], x["page"]): json.loads(x["json"]) for x in chat_format.conversations(placed, 100).collect()}
    assert {k: len(v) for k, v in pages.items()} == {(1, 0): 100, (1, 1): 100, (1, 2): 100, (2, 0): 1, (3, 0): 7, (9, 0): 40}
    assert [x["call_id"] for p in range(3) for x in pages[1, p]] == got[1]
    assert chat_format.ordered(chat_format.link(spark.createDataFrame([], SCHEMA), TOOLS)).count() == 0


def test_many_null_identifiers_and_results(spark):
    rows = [message(1, i, "call", None, '{"a":1}') for i in range(50)] + [message(1, 100 + i, "result", None, content=str(i)) for i in range(50)] + [message(1, 200, "call", "x", '{"a":1}')] + [message(1, 201 + i, "result", "x", content=str(i)) for i in range(50)]
    got = chat_format.link(spark.createDataFrame(rows, SCHEMA), TOOLS).collect()
    count = {}
    for x in got:
        count[x["status"]] = count.get(x["status"], 0) + 1
    assert count == {"no_result": 50, "orphan_result": 50, "ok": 1}
    assert next(x["n_results"] for x in got if x["status"] == "ok") == 50


def test_joins_by_hash(spark):
    plan = chat_format.link(spark.createDataFrame([message(1, 0, "call", "a", "{}")], SCHEMA), TOOLS)._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_long_chain(spark):
    n = 300
    d = spark.createDataFrame([message(1, i, "call", f"c{i}", '{"a":1}', parent=f"c{i - 1}" if i else None) for i in range(n)], SCHEMA)
    assert {r["position"]: r["depth"] for r in chat_format.link(d, TOOLS).collect()} == {i: i for i in range(n)}


def test_turns_of_a_conversation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "assistant", None), (1, 5, "user", ""), (2, 0, "assistant", "x"), (2, 1, "user", None), (None, 0, "user", "y")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = {(r["conv_id"], r["position"]): r for r in chat_format.link(chat_format.turns_as_messages(d), chat_format.REPLY).collect()}
    assert (got[1, 1]["status"], got[1, 1]["depth"]) == ("ok", 0)
    assert (got[1, 3]["status"], got[1, 3]["depth"]) == ("ok", 1)
    assert (got[1, 5]["status"], got[1, 5]["depth"]) == ("invalid_arguments", 2)
    assert got[2, 0]["status"] == "orphan_result"
    assert json.loads(got[2, 1]["json"])["arguments"] == {"text": None, "turn": 1}
    assert got[2, 1]["status"] == "invalid_arguments"
    assert chat_format.link(chat_format.turns_as_messages(d.limit(0)), chat_format.REPLY).count() == 0


def test_turns_of_other_roles(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, None, "n"), (2, 0, "system", None), (2, 1, "call", "c"), (2, 2, "result", "r"), (2, 2, "result", "r"), (3, 0, "assistant", "x")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["position"]): r for r in chat_format.link(chat_format.turns_as_messages(d), chat_format.REPLY).collect()}
    others = {(c, t): (role, text) for c, t, role, text in rows if role not in ("user", "assistant")}
    assert {k: r["status"] for k, r in got.items()} == {k: "other" for k in others} | {(1, 1): "ok", (3, 0): "orphan_result"}
    for k, (role, text) in others.items():
        told = json.loads(got[k]["json"])
        assert (told["kind"], told["name"], told["result"], got[k]["call_id"], got[k]["depth"], got[k]["n_results"]) == ("turn", role, text, None, None, 0)
    d = spark.createDataFrame([message(1, 0, "note", "a", "{", "c"), message(1, 1, None, None)], SCHEMA)
    assert sorted((r["position"], r["status"]) for r in chat_format.link(d, TOOLS).collect()) == [(0, "other"), (1, "other")]


VALUES = [
    ({"additionalProperties": {}}, {"a": 1}, []),
    ({"additionalProperties": {"type": "string"}}, {"a": 1, "b": "x"}, ["$.a: not string"]),
    ({"additionalProperties": False, "properties": {"b": True}}, {"a": 1, "b": 2}, ["$: a unknown"]),
    ({"items": True}, [1], []), ({"items": False}, [1], ["$[0]: not allowed"]), ({"properties": {"a": True}}, {"a": 1}, []), ({"properties": {"a": False}}, {"a": 1}, ["$.a: not allowed"]),
    ({"enum": [1]}, True, ["$: not in enum"]), ({"enum": [1]}, 1.0, []), ({"enum": [[True]]}, [1], ["$: not in enum"]), ({"const": {"a": 0}}, {"a": False}, ["$: not the constant"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 2, ["$: none of anyOf"]), ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, 2, ["$: not one of oneOf"]), ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, 5, []),
    ({"allOf": [{"minimum": 3}]}, 2, ["$: too small"]), ({"not": {"type": "null"}}, None, ["$: excluded by not"]), ({"pattern": "^a+$"}, "ab", ["$: pattern"]), ({"minItems": 2}, [1], ["$: too few"]),
    ({"uniqueItems": True}, [1, 1.0], ["$: repeated"]), ({"uniqueItems": True}, [1, True], []), ({"exclusiveMinimum": 3}, 3, ["$: too small"]), ({"multipleOf": 0.1}, 0.3, []), ({"multipleOf": 0.1}, 0.35, ["$: no multiple"]),
    ({"$defs": {"n": {"type": "integer"}}, "properties": {"a": {"$ref": "#/$defs/n"}}}, {"a": "x"}, ["$.a: not integer"]), ({"properties": {"next": {"$ref": "#"}}, "required": ["v"]}, {"v": 1, "next": {}}, ["$.next: v missing"]),
    (True, 1, []), (False, 1, ["$: not allowed"]),
]


@pytest.mark.parametrize(("schema", "value", "errors"), VALUES)
def test_schemas(schema, value, errors):
    chat_format.check_schema(schema)
    assert chat_format.validate(value, schema) == errors


@pytest.mark.parametrize("schema", [{"minContains": 1}, {"properties": {"a": {"unknown": 1}}}, {"anyOf": [3]}, {"$ref": "other.json#/a"}, {"pattern": "("}])
def test_schemas_that_are_not_followed(spark, schema):
    with pytest.raises((ValueError, re.error)):
        chat_format.check_schema(schema)


def test_one_form_of_numbers():
    forms = {chat_format.canonical(json.loads(t)) for t in ('{"a":[1.0,-0.0,100.0,2.5]}', '{"a":[1,0,1e2,2.50]}')}
    assert forms == {'{"a":[1,0,100,2.5]}'}
