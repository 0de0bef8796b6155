"""Lexical search, prefix BPE and conversation repair against brute force, the tiktoken library and exact round trips."""

import base64
import collections
import hashlib
import heapq
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import conversation_repair as repair
from blockloom.llm import lexical_search as lexical
from blockloom.llm import prefix_bpe as bpe

DOCS = "doc_id long, text string, item_id string, rank string, term string, n string, score string, doc string"
WORDS = "the of and to in house river green stone walks under seven quiet light fields".split()


def documents(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, *("x" * 6)) for d, t in rows], DOCS)


# 11 --------------------------------------------------------------------------


def brute_search(docs, items, top=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, collections.Counter(ts), len(ts)) for d, ts in held if ts]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item_id, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def searched(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_ranks_as_brute_force_does(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 40)))) for k in range(300)]
    rows += [(1000 + k, "Green stone, green river") for k in range(40)]  # ties
    rows += [(7, None), (8, ""), (9, " .,-"), (None, "green stone"), (None, "river"), (1000, "Green stone, green river"), (2000, " ".join(["stone"] * 30000)), (2001, "é É 漢字 naïve")]
    items = [(k, " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(12))) for k in range(20)]
    items += [(50, "green stone green"), (50, "green stone green"), (51, None), (52, "?"), (None, "river é 漢字"), (53, "nowhere")]
    docs, asked = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    wanted = brute_search(rows, items)
    assert searched(lexical.search(docs.repartition(5), asked)) == wanted
    # Several passes, item tiles, column cuts and document tiles.
    monkeypatch.setattr(lexical, "DOCS", 64)
    monkeypatch.setattr(lexical, "make_block", lambda items, of=lexical.make_block: of(items, 3))
    monkeypatch.setattr(lexical, "column_cuts", lambda w, t, of=lexical.column_cuts: of(w, t, 5))
    assert searched(lexical.search(docs, asked, block_terms=60)) == wanted
    assert searched(lexical.search(docs, asked, top=2)) == brute_search(rows, items, 2)


def test_search_of_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "green"), (2, None)])
    asked = spark.createDataFrame([(1, "green")], "item_id long, text string")
    assert lexical.search(none, asked).count() == 0 == lexical.search(some, asked.limit(0)).count()
    assert lexical.search(documents(spark, [(1, None), (2, "!")]), asked).count() == 0
    assert [tuple(r) for r in lexical.search(some, asked).collect()] == brute_search([(1, "green"), (2, None)], [(1, "green")])


def test_partial_sums_stay_exact():
    """Columns are cut where float64 would round; what a single column would round is multiplied as integers."""
    rng = np.random.default_rng(1)
    times = np.array([1, 10**6, 3, 10**5, 7, 10**8, 1, 2], np.int64)
    tile = lexical.Tile(np.arange(1), np.arange(8), np.zeros(8, np.int64), np.arange(8), times)
    weight = rng.integers(20_000, 44_000, 8)
    cuts = lexical.column_cuts(weight, tile)
    assert not all(e for _, _, e in cuts) and all(e for lo, hi, e in cuts if hi - lo > 1)
    for lo, hi, exact in cuts:
        assert not exact or int((times * weight)[lo:hi].sum()) * lexical.MOST_IMPACT < lexical.EXACT
    impact = rng.integers(900_000, 10**6, 8)
    found = lexical.tile_scores(tile, cuts, weight, 1, np.zeros(8, np.int64), np.arange(8), impact)
    assert found[0, 0] == sum(int(t) * int(w) * int(i) for t, w, i in zip(times, weight, impact, strict=True))
    assert lexical.lengths(np.array([1 << 50]), 1 << 20, 1 << 60).tolist() == [25 + 75 * (1 << 70) // (1 << 60)]


# 12 --------------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = st.text(st.one_of(st.sampled_from("abcdefgh' \n\t0123.,!?-éü漢字ñ😀ाक  \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bpe.TextEncoder(RANKS, public_tokenizers.PATTERN)


def ids_of(encoder, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_ids_are_those_of_the_library(library, own, texts):
    assert ids_of(own, texts) == [library.encode_ordinary(t) for t in texts]
    assert [own.decode(x).decode() for x in own.encode(texts)] == texts


def test_every_token_and_pair_of_tokens(library, own):
    """Tokens that are no encoding of themselves, and pairs across which merging goes."""
    rng, tokens = random.Random(2), sorted(own.vocabulary.rank)
    texts = [b"".join(rng.choice(tokens) for _ in range(n)).decode("utf-8", "replace") for n in (1, 2, 3) for _ in range(4000)]
    assert ids_of(own, texts) == [library.encode_ordinary(t) for t in texts]
    assert all(bpe.encode_piece(own.vocabulary, t) == [r] for t, r in own.vocabulary.rank.items())


def test_tables_side_by_side_are_those_of_single_pieces(own):
    """Pairs are told apart without merging, and new words cost a fraction of what single tables do."""
    v, pairs, rng = own.vocabulary, own.pairs, random.Random(8)
    left, right = (np.array([rng.choice((rng.randrange(600), rng.randrange(len(pairs.ids)))) for _ in range(6000)]) for _ in "xy")
    for _ in range(2):  # as found, and as remembered
        assert pairs.apart(left, right).tolist() == [v.apart(a, b) for a, b in zip(pairs.ids[left].tolist(), pairs.ids[right].tolist(), strict=True)]
    assert pairs.ordered and pairs.begins(np.arange(500)).tolist() == [v.apart(-1, t) for t in pairs.ids[:500].tolist()]
    pieces = list({"".join(rng.choice(("tion", "the", "é", "ß", "o", "x", "ch", "漢")) for _ in range(rng.randint(1, 12))).encode() for _ in range(20_000)}) + [b"", b"ab" * 3000]
    began = time.process_time()
    found = bpe.encode_pieces(pairs, pieces)
    middle = time.process_time()
    v.known.clear()
    assert found == [np.array(bpe.encode_piece(v, p), "<u4").tobytes() for p in pieces]
    assert 2 * (middle - began) < time.process_time() - middle


@pytest.mark.parametrize("ordered", [True, False])
def test_rank_files_in_any_order(tmp_path, ordered):
    """Tokens that no merges make, and tokens of a lower rank than their parts: ids are those of the library's rule."""
    rng = random.Random(5)
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"abcd", b"bc", b"xyzx", b"aa", b"aaa", b"bab"]
    tokens += [] if ordered else [b"dabcd", b"da", b"cabcda", b"ca"]
    if not ordered:
        tokens = tokens[:256] + rng.sample(tokens[256:], len(tokens) - 256)
        tokens.remove(b"aaa")
        tokens.insert(0, b"aaa")
        tokens.remove(b"dabcd")
        tokens.insert(0, b"dabcd")
        tokens.remove(b"abcd")
        tokens.insert(0, b"abcd")
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    v = bpe.Vocabulary(str(path))
    pairs = bpe.Pairs(v)
    assert pairs.ordered == ordered
    pieces = [bytes(rng.choice(b"abcdxyz") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + [b"xyzx", b"xyzxab"]
    held = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_pieces(pairs, pieces)]
    assert held == [[v.rank[p]] if p in v.rank else v.merge(p) for p in pieces]


def test_prefixes_have_one_last_token(own):
    v, rng = own.vocabulary, random.Random(4)
    for _ in range(60):
        data = b"".join(rng.choice(sorted(v.rank)[::97]) for _ in range(3))
        table = bpe.PieceTable(v, data)
        for end in range(1, len(data) + 1):
            fits = [t for start in range(end) if (t := v.rank.get(data[start:end])) is not None and v.apart(table.last[start - 1] if start else -1, t)]
            assert fits == [table.last[end - 1]] == v.merge(data[:end])[-1:]


def test_pieces_split_as_the_library_splits(own):
    """Each character of Unicode is a letter, a digit, white space or none of them, as tiktoken sees it."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lead in "a1!\n":
        ranks = {bytes([b]): b for b in range(256)}
        for c in points:
            ranks.setdefault((lead + c).encode(), len(ranks))
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert not [c for c in points if (len(probe.encode_ordinary(lead + c)) == 1) != (len(own.splitter.split(lead + c)) == 1)]


def test_long_pieces_take_linear_time(library, own):
    text = "ab" * 30_000 + "漢字" * 5_000 + "é " * 10 + " " * 5_000
    assert ids_of(own, [text]) == [library.encode_ordinary(text)]


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 6), TEXTS.map(lambda t: t[:6])), max_size=8))
def test_edits_and_appends_keep_ids_exact(library, own, text, edits):
    held = bpe.EditedText(own.vocabulary, own.splitter, text)
    for lo, size, new in edits:
        lo = min(lo, len(held.text))
        held.replace(lo, min(len(held.text), lo + size), new)
        assert held.ids() == library.encode_ordinary(held.text)
        held.append(new)
        assert held.ids() == library.encode_ordinary(held.text)


def test_an_edit_touches_its_surroundings_only(own):
    rng = random.Random(6)
    held = bpe.EditedText(own.vocabulary, own.splitter, " ".join(rng.choice(WORDS) for _ in range(5000)))
    work = held.work
    held.replace(12_000, 12_002, "xy")
    held.append("s and more")
    assert held.work - work < 60
    piece = bpe.PieceTable(own.vocabulary, b"a" * 1000)
    before = piece.last[:]
    piece.extend(b"b")
    assert piece.last[:1000] == before and piece.ids() == own.vocabulary.merge(b"a" * 1000 + b"b")


def test_encode_and_decode_tables(spark, library, own):
    rows = [(1, "The house's  river\n\n x"), (1, "The house's  river\n\n x"), (None, None), (2, ""), (3, "<|endoftext|> ࢏\U00011de0 🙂"), (4, "word " * 40_000)]
    docs = documents(spark, rows).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit("x"))
    coded = bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN)
    found = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in coded.collect()), key=repr)
    assert found == sorted(((d, library.encode_ordinary(t or "")) for d, t in rows), key=repr)
    back = sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in bpe.bpe_decode(coded, RANKS).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t in rows), key=repr)
    assert bpe.bpe_encode(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        own.decode(np.array([1 << 20], "<u4").tobytes())


# 13 --------------------------------------------------------------------------


def brute_repair(rows, costs=repair.Costs()):
    """Cost and letters by a search over edits in order of (cost, letters): no numbers that stand for letters."""
    heap = [(0, "", 0, "")]
    seen = set()
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            return cost, audit
        if (audit, at, out[-1:], len(out) > 0) in seen or not re.fullmatch("(s?(ua)*u?)?", out):
            continue
        seen.add((audit, at, out[-1:], len(out) > 0))
        moves = [(costs.insert, "I", at, r) for r in "ua"] if audit.count("I") <= len(rows) else []
        if at < len(rows):
            initial, must_go, cut_off = rows[at]
            moves.append((costs.delete, "D", at + 1, ""))
            if not must_go:
                extra = costs.truncated if cut_off else 0
                moves += [(extra, "K", at + 1, initial)] + [(extra + costs.rerole, "R", at + 1, r) for r in "ua"]
        for more, letter, then, role in moves:
            heapq.heappush(heap, (cost + more, audit + letter, then, out + role))


def codes_of(rows):
    return bytes("sua".find(i) % 4 + 4 * go + 8 * (cut and not go) for i, go, cut in rows)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=5), st.sampled_from([repair.Costs(), repair.Costs(3, 4, 1, 2), repair.Costs(0, 1, 1, 0), repair.Costs(2, 7, 2, 1)]))
def test_cheapest_edits_are_those_of_a_search(rows, costs):
    assert repair.cheapest(codes_of(rows), costs) == brute_repair(rows, costs)


def brute_conversations(table):
    """Everything of the contract in plain Python."""
    out = []
    say = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted((r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, say(r[2]), hashlib.sha256(say(r[3]).encode()).digest())):
            h = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
            role, text = say(role), say(text)
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            rows += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, coded, counts = set(), [], collections.Counter()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            coded.append((role[:1] if role[:1] in tuple("sua") else "x", fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit = brute_repair(coded)
        lines, at = [], 0
        for letter in audit:
            wanted = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter == "I":
                lines.append(f"{wanted}:")
                continue
            if letter != "D":
                lines.append(f"{rows[at][1] if letter == 'K' else wanted}:{rows[at][2]}")
            at += 1
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def test_conversations_are_repaired_as_by_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Well.", "Well", " \t", "", "Yes!", "Why?\n", "é. ", "a.b", None, "One ", "x" * 3000 + "."]
    table = []
    for conv in range(400):
        turns = sorted(rng.sample(range(12), rng.randint(1, 7)))
        table += [(conv, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant"]) if rng.random() < 0.8 else rng.choice(["system", "tool", "", None, "u"]), rng.choice(texts)) for t in turns]
    table += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hi."), (500, 3, "user", "Hi."), (500, 3, "user", "Hi."), (501, None, "user", "Hi."), (2**62 + 1, 2**40, "user", "Hi."), (2**62 + 1, 2**40 + 9, "assistant", "Hi.")]
    given_rows = spark.createDataFrame(table, CONVERSATIONS)
    for clash in ("audit", "digest", "code", "fault", "dropped", "place", "cost", "copy", "_h"):
        given_rows = given_rows.withColumn(clash, F.lit("x"))
    given_rows.write.parquet(f"{tmp_path}/conversations.parquet")
    found = repair.op13_conversation_repair(spark, str(tmp_path))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    assert got == brute_conversations(table)
    assert any(len(r[7]) == 0 for r in got) and {"D", "K", "R"} <= set("".join(r[7] for r in got))
    empty = tmp_path / "empty"
    empty.mkdir()
    given_rows.limit(0).write.parquet(f"{empty}/conversations.parquet")
    assert repair.op13_conversation_repair(spark, str(empty)).count() == 0


def test_repaired_rows_and_inserts(spark):
    """Where inserting is cheap, empty rows close the gaps; the rows that come out have the roles that the letters say."""
    table = [(1, 0, "system", "s."), (1, 1, "user", "a."), (1, 2, "user", "b."), (1, 3, "assistant", "c"), (2, 0, "assistant", "d."), (3, 0, "user", " ")]
    rows = repair.undamaged(spark.createDataFrame(table, CONVERSATIONS))
    decisions, out = repair.repair(rows, repair.Costs(rerole=9, delete=9, insert=1, truncated=0))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in decisions.collect()} == {1: (1, "KKIKK"), 2: (1, "IK"), 3: (9, "D")}
    got = [tuple(r)[:1] + tuple(r)[2:] for r in out.orderBy("conv_id", "place").collect()]
    assert got == [(1, "system", "s."), (1, "user", "a."), (1, "assistant", ""), (1, "user", "b."), (1, "assistant", "c"), (2, "user", ""), (2, "assistant", "d.")]


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(3, 4, 1, 2), repair.Costs(0, 1, 1, 0), repair.Costs(2, 7, 2, 1), repair.Costs(1, 1, 1, 1)])
def test_long_conversations_by_parts(monkeypatch, costs):
    """Short parts with common ends put aside give what one whole number for each state gives; time grows with the rows."""
    rng = random.Random(9)
    for kinds in ((1, 2, 1, 2, 0, 9, 6), (1,), (3, 2), (1, 9), (1, 2)):
        codes = bytes(rng.choice(kinds) for _ in range(rng.randint(150, 250)))
        found = {}
        for layers in (3, 64, 1000):
            monkeypatch.setattr(repair, "_LAYERS", layers)
            found[layers] = repair._long(codes, costs)
        assert found[3] == found[64] == found[1000]
        assert len(found[3][1]) >= len(codes)


def test_very_long_conversations():
    rng = random.Random(10)
    codes = bytes(rng.choice((1, 2, 1, 2, 0, 9, 6)) for _ in range(60_000))
    began = time.time()
    cost, audit = repair.cheapest(codes)
    assert len(audit) >= 60_000 and cost > 0 and time.time() - began < 60
    assert repair.cheapest(bytes([1, 2] * 2000)) == (0, "KK" * 2000)
