"""Words, names and codecs on the cases that a query does not reach."""

import random

import pytest
from pyspark.sql import functions as F

from blockloom.catalog import Param, keccak256, read_abi, snake, spark_type
from blockloom.functions import words as w
from blockloom.operators import reads


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_uint_and_int_text_are_exact(spark):
    rng = random.Random(3)
    unsigned = [0, 1, 10**9, (1 << 64) - 1, 1 << 64, (1 << 120) - 1, 1 << 120, 10**36, 10**54 - 1, 10**72, (1 << 256) - 1, 1 << 255, *(rng.getrandbits(rng.randint(1, 256)) for _ in range(60))]
    rows = column(spark, [bytearray(n.to_bytes(32)) for n in unsigned], "binary").select(w.uint256_text(F.col("x")), w.bit_length(F.col("x"))).collect()
    assert [r[0] for r in rows] == [str(n) for n in unsigned]
    assert [r[1] for r in rows] == [n.bit_length() for n in unsigned]
    signed = [0, -1, -(1 << 64), -(1 << 64) - 1, 1 - (1 << 64), -(1 << 255), (1 << 255) - 1, *(rng.getrandbits(255) - (1 << 254) for _ in range(60))]
    rows = column(spark, [bytearray(n.to_bytes(32, signed=True)) for n in signed], "binary").select(w.int256_text(F.col("x")), w.sort_key(F.col("x"), True)).collect()
    assert [r[0] for r in rows] == [str(n) for n in signed]
    assert sorted(signed) == [n for _, n in sorted((bytes(r[1]), n) for r, n in zip(rows, signed))]


def test_sum_of_wide_integers(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(256) for _ in range(500)] + [(1 << 256) - 1] * 20
    sums = column(spark, [bytearray(n.to_bytes(32)) for n in values], "binary").agg(*w.limb_sums(F.col("x")))
    assert sums.select(w.sum_text(*(F.col(f"limb_{k}") for k in range(8)))).first()[0] == str(sum(values))


@pytest.mark.parametrize("name, wanted", [("actionTreeRoot", "action_tree_root"), ("actionID", "action_id"), ("URLValue", "url_value"), ("already_snake", "already_snake"), ("amount0", "amount0"), ("_odd--name", "odd_name")])
def test_snake_case(spark, name, wanted):
    assert snake(name) == wanted
    assert column(spark, [name], "string").select(w.snake_case(F.col("x"))).first()[0] == wanted


def test_identifiers(spark):
    good, bad = ["evt_token_transfer", "a1", "_x"], ["", "1abc", "evt-token", "Transfer", "drop table", "x" * 64, "a\n"]
    rows = column(spark, good + bad, "string").select(w.valid_ident(F.col("x"))).collect()
    assert [r[0] for r in rows] == [True] * len(good) + [False] * len(bad)


def test_hex(spark):
    rows = column(spark, ["deadbeef", "0xdeadbeef", "abc", "zz", "", "0x"], "string").select(w.hex_decode(F.col("x"))).collect()
    assert [r[0] if r[0] is None else bytes(r[0]).hex() for r in rows] == ["deadbeef", "deadbeef", None, None, "", ""]


def test_selector_frames(spark):
    blobs = [b"", bytes([3]) + b"abc" + bytes([1]) + b"z", bytes([3]) + b"abc" + bytes([5]) + b"z", bytes([0])]
    rows = column(spark, [bytearray(b) for b in blobs], "binary").select(w.unframe_selectors(F.col("x"))).collect()
    assert [[bytes(x) for x in r[0]] for r in rows] == [[], [b"abc", b"z"], [b"abc"], [b""]]


def test_keccak():
    assert keccak256(b"Transfer(address,address,uint256)").hex() == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert keccak256(b"transfer(address,uint256)")[:4].hex() == "a9059cbb"


def test_catalog_names_and_types():
    event = read_abi([{"type": "event", "name": "E", "inputs": [{"name": "label", "type": "string", "indexed": True}, {"name": "", "type": "uint"}, {"name": "t", "type": "tuple", "indexed": True, "components": [{"name": "a", "type": "uint"}]}]}], "ERC20Token")[0]
    assert event.table == "evt_erc20_token_e"
    assert event.signature == "E(string,uint256,(uint256))"
    assert [p.column for p in event.params] == ["label_hash", "arg1", "t_hash"]
    assert [p.logical for p in event.params] == ["bytes", "uint:256", "bytes"]
    assert [Param("x", t).logical for t in ("uint256[]", "address[3]", "(uint256,address)", "bytes32", "int8", "bool")] == ["json", "json", "json", "bytes", "int:8", "bool"]
    assert [spark_type(t).simpleString() for t in ("uint:63", "uint:64", "uint:120", "uint:128", "int:64")] == ["bigint", "decimal(38,0)", "decimal(38,0)", "binary", "bigint"]


def test_cursors_and_pages():
    assert reads.parse_cursor("123:45") == (123, 45, None) and reads.parse_cursor("123:45:7") == (123, 45, 7)
    for bad in ("123", "abc:45", "123:xy", "", "1:2:x", "1:2:3:4", "9" * 20 + ":1"):
        with pytest.raises(reads.BadQuery):
            reads.parse_cursor(bad)
    assert [reads.clamp_first(n) for n in (0, 5000, 50, None)] == [1, 1000, 50, 100]


@pytest.mark.parametrize("value, logical", [("notint", "uint:256"), ("maybe", "bool"), ("0xZZ", "bytes"), ("[]", "json"), ("-1", "uint:256"), ("9" * 30, "int64"), ("yesterday", "timestamp"), ("2024-13-01", "timestamp")])
def test_bad_literals_are_refused(spark, value, logical):
    with pytest.raises(reads.BadQuery):
        reads.literal(value, logical)
