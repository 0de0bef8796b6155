"""Decoding on hand-made logs: odd values, cut data, other layouts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from blockloom.catalog import read_abi
from blockloom.functions import words as w
from blockloom.operators import decode, nested

TRANSFER = read_abi([{"type": "event", "name": "Transfer", "inputs": [{"name": "from", "type": "address", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]}], "token")[0]


def word(n):
    return (n % (1 << 256)).to_bytes(32)


def logs(spark, rows):
    data = [(1, h, 0, bytearray(b"h"), bytearray(b"a"), [bytearray(t) for t in topics], bytearray(body), bytearray(b"t"), 0, None) for h, (topics, body) in enumerate(rows)]
    return spark.createDataFrame(data, decode.RAW)


def test_transfer_and_other_layout(spark):
    topics = [TRANSFER.key, bytes(12) + b"\x11" * 20, bytes(12) + b"\x22" * 20]
    raw = logs(spark, [(topics, word(100)), ([*topics, word(5)], b""), ([b"\xab" * 32], word(1)), ([b"\x01" * 8], b""), ([], b""), (topics, word(100)[:20])])
    rows = decode.decode_events(raw, TRANSFER).select("height", "from", "to", w.uint256_text(F.col("value")).alias("v")).collect()
    assert [(r["height"], bytes(r["from"]), bytes(r["to"]), r["v"]) for r in rows] == [(0, b"\x11" * 20, b"\x22" * 20, "100")]
    assert {(r["height"], r["reason"]) for r in decode.quarantine(raw, TRANSFER).collect()} == {(1, "topic count"), (5, "data")}
    assert {r["height"] for r in decode.unrouted_logs(raw, [TRANSFER]).collect()} == {2, 3, 4}
    with pytest.raises(Exception, match="does not fit"):
        decode.decode_events(raw, TRANSFER, on_error="fail").collect()


def test_signed_and_empty_and_nested(spark):
    inputs = [{"name": "a", "type": "int256"}, {"name": "b", "type": "int8"}, {"name": "xs", "type": "int256[]"}, {"name": "fixed", "type": "uint256[2]"}, {"name": "n", "type": "tuple[]", "components": [{"name": "s", "type": "string"}, {"name": "ok", "type": "bool"}]}, {"name": "body", "type": "bytes"}]
    entry = read_abi([{"type": "event", "name": "Odd", "inputs": inputs}], "x")[0]
    head = 7 * 32

    def body(xs, texts, last):
        tail_xs = word(len(xs)) + b"".join(map(word, xs))
        items = [word(64) + word(1) + word(len(t)) + t + bytes(-len(t) % 32) for t in texts]
        at, offsets = 32 * len(items), b""
        for i in items:
            offsets, at = offsets + word(at), at + len(i)
        tail_n = word(len(texts)) + offsets + b"".join(items)
        tail_b = word(len(last)) + last + bytes(-len(last) % 32)
        return word(-(1 << 255)) + word(-1) + word(head) + word(7) + word(8) + word(head + len(tail_xs)) + word(head + len(tail_xs) + len(tail_n)) + tail_xs + tail_n + tail_b

    good = body([-1, 5], [b"one", "zwölf".encode()], b"\x01\x02")
    raw = logs(spark, [([entry.key], good), ([entry.key], body([], [], b"")), ([entry.key], good[:-32]), ([entry.key], good[:64] + word(1 << 200) + good[96:])])
    rows = {r["height"]: r for r in decode.decode_events(raw, entry).withColumn("a", w.int256_text(w.sort_key(F.col("a"), True))).collect()}
    assert set(rows) == {0, 1}
    assert (rows[0]["a"], rows[0]["b"], json.loads(rows[0]["xs"]), json.loads(rows[0]["fixed"])) == (str(-(1 << 255)), -1, ["-1", "5"], ["7", "8"])
    assert json.loads(rows[0]["n"]) == [["one", True], ["zwölf", True]]
    assert bytes(rows[0]["body"]) == b"\x01\x02" and rows[1]["xs"] == "[]" and rows[1]["n"] == "[]"
    assert {r["height"] for r in decode.quarantine(raw, entry).collect()} == {2, 3}


def test_static_events_stay_on_the_jvm(spark):
    raw = logs(spark, [([TRANSFER.key], b"")])
    plan = decode.decode_events(raw, TRANSFER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    plan = decode.route_events(raw, [TRANSFER])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def brute_json(data, at, p):
    """A value from data in plain Python. Raises where data is cut short."""

    def word(k):
        if k < 0 or k + 32 > len(data):
            raise ValueError("out of data")
        return data[k : k + 32]

    def sequence(kinds, start):
        out, k = [], start
        for c in kinds:
            out.append(brute_json(data, start + int.from_bytes(word(k)) if nested.is_dynamic(c) else k, c))
            k += 32 * nested.head_words(c)
        return out

    if p.type.endswith("]"):
        inner = decode.Param("", p.type[: p.type.rindex("[")], components=p.components)
        held = p.type[p.type.rindex("[") + 1 : -1]
        n = int(held) if held else int.from_bytes(word(at))
        if n > len(data) or n * 32 > len(data) and nested.head_words(inner):
            raise ValueError("out of data")
        return sequence([inner] * n, at if held else at + 32)
    if p.type.startswith("("):
        return sequence(list(p.components), at)
    if p.type in ("string", "bytes"):
        n = int.from_bytes(word(at))
        if at + 32 + n > len(data):
            raise ValueError("out of data")
        body = data[at + 32 : at + 32 + n]
        return body.decode("utf-8", "replace") if p.type == "string" else "0x" + body.hex()
    x = word(at)
    if p.type.startswith("uint"):
        return str(int.from_bytes(x))
    if p.type.startswith("int"):
        return str(int.from_bytes(x, signed=True))
    if p.type == "bool":
        return x[-1] != 0
    return "0x" + (x[12:] if p.type == "address" else x[: int(p.type[5:])]).hex()


LEAVES = ["uint256", "uint8", "int64", "int256", "bool", "address", "bytes32", "bytes3", "string", "bytes"]


def random_type(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return {"type": rng.choice(LEAVES)}
    if kind < 0.65:
        inner = random_type(rng, depth - 1)
        return {**inner, "type": inner["type"] + rng.choice(["[]", "[]", "[2]"])}
    return {"type": "tuple", "components": [{"name": f"c{k}", **random_type(rng, depth - 1)} for k in range(rng.randint(1, 3))]}


def abi_encode(p, rng):
    """Random bytes of a value, as (in place, behind)."""
    if p.type.endswith("]"):
        inner, held = decode.Param("", p.type[: p.type.rindex("[")], components=p.components), p.type[p.type.rindex("[") + 1 : -1]
        n = int(held) if held else rng.randint(0, 3)
        return (b"" if held else word(n)) + abi_sequence([inner] * n, rng)
    if p.type.startswith("("):
        return abi_sequence(p.components, rng)
    if p.type in ("string", "bytes"):
        body = rng.choice(["", "a", '"q"\\\n', "zwölf 漢字", "x" * 40]).encode() if p.type == "string" else rng.randbytes(rng.randint(0, 40))
        return word(len(body)) + body + bytes(-len(body) % 32)
    return word(rng.choice([0, 1, 1 << 255, (1 << 256) - 1, rng.getrandbits(256)]))


def abi_sequence(kinds, rng):
    held = [abi_encode(k, rng) for k in kinds]
    at, head = 32 * sum(nested.head_words(k) for k in kinds), b""
    for k, body in zip(kinds, held, strict=True):
        head += word(at) if nested.is_dynamic(k) else body
        at += len(body) if nested.is_dynamic(k) else 0
    return head + b"".join(body for k, body in zip(kinds, held, strict=True) if nested.is_dynamic(k))


@pytest.mark.parametrize("seed", range(6))
def test_nested_values_are_those_of_plain_python(spark, seed, monkeypatch):
    """Random types and values, whole, cut short, and with words that point elsewhere."""
    rng = random.Random(seed)
    while True:
        entry = read_abi([{"type": "event", "name": "Nest", "inputs": [{"name": "before", "type": "uint256"}, {"name": "v", **random_type(rng, 3)}]}], "x")[0]
        if entry.params[1].logical == "json" and not decode._is_flat_array(entry.params[1]):
            break
    p, rows = entry.params[1], []
    for _ in range(60):
        data = bytearray(abi_sequence(entry.params, rng))
        if rng.random() < 0.3:
            del data[rng.randint(0, len(data)) :]
        for _ in range(rng.choice([0, 0, 1, 3])):
            k = 32 * rng.randint(0, max(0, len(data) // 32 - 1))
            data[k : k + 32] = word(rng.choice([0, 1, 2, 32, 64, 1 << 31, 1 << 200, rng.randint(0, 400)]))
        rows.append(bytes(data))
    frame = spark.createDataFrame([(k, bytearray(d)) for k, d in enumerate(rows)], "k long, data binary")
    found = {r["k"]: r["v"] for r in frame.select("k", nested.json_udf(p, 1)(F.col("data")).alias("v")).collect()}
    # The same in parts, beside rows without data.
    monkeypatch.setattr(nested, "MOST_VALUES", 400)
    assert nested.decode_rows([None, *rows, None], p, 1) == [None, *(found[k] for k in range(len(rows))), None]
    good = 0
    for k, data in enumerate(rows):
        try:
            if len(data) < 64:
                raise ValueError
            wanted = brute_json(data, int.from_bytes(data[32:64]) if nested.is_dynamic(p) else 32, p)
        except (ValueError, OverflowError):
            assert found[k] is None, (p.type, data.hex())
            continue
        good += 1
        assert json.loads(found[k]) == wanted, p.type
    assert good > 10
