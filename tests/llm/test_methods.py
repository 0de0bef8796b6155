"""The text operators' methods: exact ids, brute force, plans and SQL."""

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from blockloom.llm import components, decontamination, exact_dedup, jaccard_join, language_id, license_scan, packing, registry, secret_scan, skew, token_file, tokens, url_filter, warc_archive
from blockloom.llm.components import connected_components
from blockloom.scratch import Scratch
from tests.llm.test_operators import brute_components, brute_verdict, documents, prose

WIDE = [2**53 + 1, 2**53, 2**62 + 3, -(2**62) - 1, None]


# ids ---------------------------------------------------------------------------


def test_ids_stay_exact_beside_a_null(spark):
    """Ids above 2**53 in one batch with a null: pandas would round them."""
    rng = random.Random(1)
    texts = [prose(rng, 30) + " Released under the MIT License." for _ in WIDE]
    docs = documents(spark, [(d, t, "en") for d, t in zip(WIDE, texts)]).coalesce(1)
    bench = spark.createDataFrame([(d, t) for d, t in zip(WIDE, texts)], "item_id long, text string").coalesce(1)
    ids = lambda df, c="doc_id": sorted((r[0] for r in df.select(c).collect()), key=str)
    wanted = sorted(WIDE, key=str)
    assert ids(language_id.identify(docs, language_id.train(docs))) == wanted
    pages = spark.createDataFrame([(d, "http://a.org/") for d in WIDE], "page_id long, url string").coalesce(1)
    assert ids(url_filter.url_filter(pages), "page_id") == wanted
    groups = jaccard_join.near_duplicates(docs, 85, 4).collect()
    assert sorted((r["doc_id"] for r in groups), key=str) == wanted and all(r["doc_id"] == r["component_id"] for r in groups)
    folder = Scratch(spark, "tokens").path("wide")
    token_file.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder)
    assert ids(token_file.read_tokens(spark, folder)) == wanted
    found = decontamination.contaminated(docs, bench)
    assert ids(found) == wanted and ids(found, "item_id") == wanted and found.where("doc_id <=> item_id").count() == len(WIDE)
    assert ids(license_scan.license_scan(docs)) == wanted
    assert ids(packing.best_fit_packing(docs, packing.tokenizer_path())) == wanted


def test_the_session_keeps_its_settings(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    jaccard_join.near_duplicates(documents(spark, [(1, "a b c", None)]), 80, 5).collect()
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_warc_archive", "op6_exact_dedup"])
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = registry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())


# 1 ---------------------------------------------------------------------------


def test_language_scores_by_brute_force(spark, sf_dir):
    """Counts, back-off and softmax again, in plain Python, for a model that keeps all words and n-grams."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    words = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, k: [w[i : i + k] for i in range(len(w) - k + 1)]
    learn = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    langs = sorted({r["lang"] for r in learn})
    counts = {k: collections.defaultdict(lambda: [0] * len(langs)) for k in range(5)}
    for r in learn:
        for w, n in collections.Counter(words(r["text"])).items():
            counts[0][w][langs.index(r["lang"])] += n
            for k in (1, 2, 3, 4):
                for g in grams(w if k == 1 else f"^{w}$", k):
                    counts[k][g][langs.index(r["lang"])] += n
    totals = {k: [sum(c[j] for c in t.values()) + 0.5 * (len(t) + 1) for j in range(len(langs))] for k, t in counts.items()}
    share = lambda k, g, j: math.log((counts[k][g][j] + 0.5) / totals[k][j])

    def scored(word):
        if word in counts[0]:
            return [share(0, word, j) for j in range(len(langs))]
        for k in (4, 3, 2, 1):
            known = [g for g in grams(word if k == 1 else f"^{word}$", k) if g in counts[k]]
            if known:
                return [sum(share(k, g, j) for g in known) / len(known) for j in range(len(langs))]
        return [0.0] * len(langs)

    model = language_id.train(docs, most_words=10**7, most_grams=10**7)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    held_out = [r for r in rows if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and words(r["text"])]
    for r in held_out[:60]:
        each = [scored(w) for w in words(r["text"])]
        total = [sum(s[j] for s in each) for j in range(len(langs))]
        best = max(range(len(langs)), key=lambda j: total[j])
        lang, score = found[r["doc_id"]]
        assert lang == langs[best] and score == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total), abs=2e-3)
    # The bounds of the model do not move held-out accuracy.
    bounded = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, language_id.train(docs)).collect()}
    right = lambda of: sum(of(r["doc_id"]) == r["lang"] for r in held_out)
    assert abs(right(bounded.get) - right(lambda d: found[d][0])) <= max(1, len(held_out) // 200)


def test_language_of_small_samples_and_rejections(spark):
    rows = [(k, "the river and the house " * 5, "en") for k in range(400)] + [(1000 + k, "der fluss und das haus " * 5, "de") for k in range(8)]
    docs = documents(spark, rows)
    assert language_id.train(docs, rows=60).langs == ["de", "en"]
    model = language_id.train(docs)
    odd = documents(spark, [(1, "qqq", None), (2, "12 !", None), (3, None, None), (4, "the river", None)])
    assert sorted(r["doc_id"] for r in language_id.reject_unknown(odd, model).collect()) == [1, 4]
    nothing = language_id.train(documents(spark, []))
    assert sorted(r["doc_id"] for r in language_id.reject_unknown(odd, nothing).collect()) == [1, 4]


# 2 ---------------------------------------------------------------------------


def test_url_vocabulary_is_large_and_a_parameter(spark, tmp_path):
    terms = url_filter.soft_vocabulary()
    assert len(terms) > 1500
    # No single soft term rejects, nor one stem in all its forms.
    alone = [(k, f"http://a.org/{t}") for k, t in enumerate(t for t in terms if t not in url_filter.STRICT_TERMS)] + [(-1, "http://a.org/poker/pokers?poker")]
    assert url_filter.url_filter(spark.createDataFrame(alone, "page_id long, url string")).where("verdict = 'block'").count() == 0
    with pytest.raises(ValueError):
        url_filter.soft_vocabulary({"heavy": 1.5})
    urls = ["http://a.org/freepoker", "http://a.org/cheap-loans", "http://a.org/free/win", "http://a.org/pornxxx/", "http://a.org/" + "x-" * 300_000 + "casino", "http://a.org/track", "http://a.org/cheap-loan/", "http://a.org/free-poker", "http://a.org/freepoker/bet", "http://a.org/free-chat"]
    rows = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert rows == {k: brute_verdict(u) for k, u in enumerate(urls)}
    assert [rows[k][1] for k in range(10)] == ["allow", "allow", "allow", "block", "block", "allow", "allow", "block", "block", "allow"]
    (tmp_path / "v.csv").write_text("bad\nworse,1.0\nWorst,0.5\n")
    strict, soft = url_filter.read_vocabulary(spark, f"file://{tmp_path}/v.csv")
    assert strict == ("bad",) and soft == {"worse": 1.0, "worst": 0.5}
    judged = url_filter.url_filter(spark.createDataFrame([(1, "http://a/bad"), (2, "http://a/worse"), (3, "http://a/worse/worst"), (4, "http://a/casino")], "page_id long, url string"), strict=strict, soft=soft)
    assert {r["page_id"] for r in judged.where("verdict = 'block'").collect()} == {1, 3}


# 3 ---------------------------------------------------------------------------


def test_secret_scan_of_a_long_text_with_many_spans(spark):
    rng = random.Random(3)
    body = " ".join(f"password={''.join(rng.choice('0123456789abcdef') for _ in range(14))} {''.join(rng.choice('0123456789abcdef') for _ in range(24))}" for _ in range(3000))
    text = body + " é " + "x" * 300
    r = secret_scan.secret_scan(documents(spark, [(1, text, None)])).collect()[0]
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"password=[0-9a-f]+", text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    assert (r["n_assign"], r["n_hex"], r["n_random"]) == (3000, 3000, 0)
    assert r["spans"] == ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_recall_of_the_battery_by_encoding_and_length(spark):
    rng = random.Random(4)
    rows, of = [], {}
    for name, _, alphabet in secret_scan.ENCODINGS[1:]:  # hex runs are spans of a pattern
        for length in (20, 24, 40, 64, 200):
            for _ in range(60):
                of[len(rows)] = name, length
                rows.append((len(rows), f"key {''.join(rng.choice(alphabet) for _ in range(length))} end", None))
    rows += [(10_000 + k, " ".join("".join(rng.choice(("ing", "ver", "con", "ten", "gra", "low")) for _ in range(8)) for _ in range(3)), None) for k in range(200)]
    caught, wrong = collections.Counter(), 0
    for r in secret_scan.secret_scan(documents(spark, rows)).collect():
        if r["doc_id"] in of:
            caught[of[r["doc_id"]]] += r["n_random"] > 0
        else:
            wrong += r["n_random"]
    assert min(caught[c] / 60 for c in set(of.values())) >= 0.9, caught
    assert wrong <= 30


# 4 ---------------------------------------------------------------------------


@pytest.mark.parametrize("percent, width, boundary", [(85, 4, None), (60, 3, 6), (70, 3, 9), (85, 4, 13), (80, 5, 8)])
def test_links_from_common_subsets(spark, percent, width, boundary):
    """Short texts with common rare shingles, so that lists are long and subsets are cheaper; against all pairs."""
    rng = random.Random(percent)
    stems = [prose(rng, rng.randint(3, 14)).split() for _ in range(12)]
    rows = [(5000, None), (5001, " "), (5002, "a"), (5003, "A")]
    for k in range(220):
        words = list(rng.choice(stems))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [f"n{rng.randint(0, 3)}"]
        rows.append((k, " ".join(words)))
    tails = [prose(rng, 11) for _ in range(3)]
    rows += [(3000 + k, f"{tails[k % 3]} tail{k if k > 5 else ''}") for k in range(150)] + [(3500 + k, t) for k, t in enumerate(tails)]
    rows += [(6000 + k, prose(rng, 60)) for k in range(20)] + [(7, prose(rng, 9))]  # one id, two texts
    join = jaccard_join.JaccardJoin(documents(spark, [(d, t, None) for d, t in rows]), percent, width, boundary)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in join.components().collect()}
    renamed = [(d if k < len(rows) - 1 else 999_999, t) for k, (d, t) in enumerate(rows)]
    brute = brute_components(renamed, percent, width)
    assert {d: c for (d, n), c in got.items() if d != 7} == {d: c for d, (n, c) in brute.items() if d not in (7, 999_999)}
    assert join.boundary and join.light_links() > 0


def test_boundary_follows_the_cost():
    cheap = {n: (100, 100 * jaccard_join.prefix_length(n, 85)) for n in range(1, 40)}
    costly = {n: (100, 100 * 500 * jaccard_join.prefix_length(n, 85)) for n in range(1, 40)}
    assert jaccard_join.choose_boundary(cheap, 85) < jaccard_join.choose_boundary(costly, 85) >= 13
    assert jaccard_join.choose_boundary({}, 85) == 0


def test_long_lists_are_dealt_to_many_tasks(spark, monkeypatch):
    """Dissimilar texts that share their rarest shingles: blocks and bands lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rng = random.Random(6)
    shared = prose(rng, 6)
    rows = [(k, f"{shared} {prose(rng, rng.randint(10, 60))}") for k in range(150)]
    rows += [(1000 + k, t + " end") for k, t in rows[:40]]
    got = jaccard_join.near_duplicates(documents(spark, [(d, t, None) for d, t in rows]), 80, 5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 80, 5)


def test_lookup_and_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "FEW", 10)
    monkeypatch.setattr(components, "FEW", 10)
    monkeypatch.setattr(skew, "LEAST", 5)
    scratch = Scratch(spark, "hub")
    rows = scratch.keep(spark.range(300).select(F.when(F.col("id") < 200, 1).when(F.col("id") < 220, None).otherwise(F.col("id")).cast("long").alias("k"), "id"), "rows")
    table = spark.createDataFrame([(1, "one"), (250, "x"), (7, "never")], "k long, v string")
    found = skew.lookup(rows, table, "k", "id")
    assert found.count() == 300 and collections.Counter(r["v"] for r in found.collect()) == {"one": 200, "x": 1, None: 99}
    edges = [(0, k) for k in range(1, 80)] + [(k, k + 1) for k in range(100, 140)] + [(50, 139), (200, 201)]
    labels = connected_components(spark.createDataFrame(edges, "a long, b long"), scratch, "cc")
    assert {r["id"]: r["comp"] for r in labels.collect()} == {**{k: 0 for k in [*range(80), *range(100, 141)]}, 200: 200, 201: 200}


# 5 ---------------------------------------------------------------------------


def test_warc_records_parse_back(spark):
    pages = spark.createDataFrame([(2, "http://a/", "x\r\n\r\ny"), (1, "http://é/", "x\r\n\r\ny"), (None, None, "é"), (3, "u", None)], "page_id long, url string, html string")
    path = Scratch(spark, "warc").path("p")
    warc_archive.write_archive(pages, path)
    records = warc_archive.record_bytes(warc_archive.read_archive(spark, path)).drop("page_id")
    parsed = sorted(((r["page_id"], r["record_type"], r["refers_to"], bytes(r["block"]).decode()) for r in warc_archive.parse_records(records).collect()), key=str)
    assert parsed == sorted([(1, "response", None, "x\r\n\r\ny"), (2, "revisit", 1, ""), (None, "response", None, "é"), (3, "response", None, "")], key=str)
    with pytest.raises(Exception, match="not a whole WARC record"):
        warc_archive.parse_records(records.withColumn("record", F.expr("substring(record, 1, length(record) - 1)"))).collect()
    empty = Scratch(spark, "warc").path("e")
    warc_archive.write_archive(pages.limit(0), empty)
    assert warc_archive.parse_records(warc_archive.record_bytes(warc_archive.read_archive(spark, empty))).count() == 0


# 6 ---------------------------------------------------------------------------


def test_the_index_is_joined_as_it_lies(spark):
    index = exact_dedup.DigestIndex(spark, "digest_index_plan", buckets=4)
    index.ingest(documents(spark, [(1, "a", None), (2, "b", None)]), "one")
    new = exact_dedup.digests(documents(spark, [(3, "a", None), (4, "c", None)])).select("digest").withColumn("keep_id", F.lit(1))
    unseen = index.unseen(new)
    assert unseen.count() == 1
    plan = unseen._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin") :]
    assert "LeftAnti" in join.splitlines()[0]
    scan = next(k for k, line in enumerate(join.splitlines()) if "digest_index_plan" in line)
    index_side = join.splitlines()[:scan]
    start = max(k for k, line in enumerate(index_side) if re.search(r"^\s*:?\s*\+- .*Sort \[digest", line))
    assert not any("Exchange" in line for line in index_side[start:]), plan
    index.drop()


def test_a_whole_table_goes_through_the_index_in_batches(spark, monkeypatch):
    added = []
    held = exact_dedup.DigestIndex.add
    monkeypatch.setattr(exact_dedup.DigestIndex, "add", lambda self, rows, batch: (held(self, rows, batch), added.append(self.read().groupBy("batch").count().collect())))
    before = {t.name for t in spark.catalog.listTables()}
    rows = [(k, f"t{k % 30}", None) for k in range(100)] + [(None, "t1", None), (None, "alone", None), (5, "t5", None)]
    got = exact_dedup.exact_dedup(documents(spark, rows)).collect()
    assert len(added) == exact_dedup.INGESTS == len(added[-1]) and {t.name for t in spark.catalog.listTables()} == before
    sizes = collections.Counter(t for _, t, _ in rows)
    top = {t: max((d for d, u, _ in rows if u == t and d is not None), default=None) for t in sizes}
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(sizes)
    assert collections.Counter((r["keep_id"], r["group_size"]) for r in got) == collections.Counter((top[t], sizes[t]) for _, t, _ in rows)


# 7, 10 -----------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_are_as_in_the_plain_call(name):
    texts = ["a <|endoftext|> b", "a<|endoftext|>b <|EndOfText|>", "x <| y", "<|startoftext|> q", "plain text", "", "tag <b> bold"]
    t = Tokenizer.from_file(public_tokenizers.path(name))
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(public_tokenizers.path(name)).encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_pieces_and_ids_are_the_tokenizers(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.choice([0, 1, 5, 40, 200])) or None, None) for k in range(60)]
    t = Tokenizer.from_file(packing.tokenizer_path())
    wanted = {}
    for d, text, _ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(ids)
        head = n if n <= 64 else n % 64 or 64
        starts = [0, *range(head, n, 64)]
        for k, (a, b) in enumerate(itertools.pairwise([*starts, n])):
            wanted[d, k] = (a, b - a, zlib.crc32(ids[a:b].tobytes()))
    for most in (packing.BROADCAST_ROWS, 0):  # with the counts broadcast, and dealt
        monkeypatch.setattr(packing, "BROADCAST_ROWS", most)
        got = packing.best_fit_packing(documents(spark, rows).repartition(3), packing.tokenizer_path(), size=64).collect()
        assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == wanted
        by_sequence = collections.defaultdict(list)
        for r in got:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in by_sequence.values():
            assert [o for o, _ in sorted(held)] == [0, *itertools.accumulate(n for _, n in sorted(held))][:-1] and sum(n for _, n in held) <= 64
        assert len(by_sequence) <= -(-sum(n for _, n, _ in wanted.values()) // 64) + 2


# 8 ---------------------------------------------------------------------------


def brute_contaminated(docs, items, window=20, share=0.8):
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    found = set()
    for d, text in docs:
        words = split(text)
        for i, item in items:
            wanted = split(item)
            size = min(window, len(wanted))
            least = len(wanted) if len(wanted) < 8 else math.ceil(share * size - 1e-9)
            for shift in range(-len(wanted), len(words)):
                same = [words[k + shift] == wanted[k] for k in range(max(0, -shift), min(len(wanted), len(words) - shift))]
                if any(sum(same[k : k + size]) >= least for k in range(len(same) - size + 1)):
                    found.add((d, i))
                    break
    return found


def test_decontamination_by_brute_force(spark):
    rng = random.Random(13)
    items = [(k, prose(rng, n)) for k, n in enumerate([2, 5, 7, 8, 9, 12, 20, 25, 40, 90])] + [(20, "w " * 60), (21, "a b " * 30)]
    docs = []
    for k in range(160):
        words = rng.choice(items)[1].split()
        a = rng.randrange(len(words))
        part = words[a : a + rng.randint(1, 60)] if rng.random() < 0.6 else list(words)
        for _ in range(rng.randint(0, max(1, len(part) // 4))):
            part[rng.randrange(len(part))] = rng.choice(["swap", "other", "w"])
        docs.append((k, " ".join([*prose(rng, rng.randint(0, 30)).split(), *part, *prose(rng, rng.randint(0, 30)).split()])))
    docs += [(500, "w " * 400), (501, "b a " * 90), (502, "w x " * 100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(documents(spark, [(d, t, None) for d, t in docs]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_contaminated(docs, items) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_a_text_that_meets_many_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS", 8)
    rng = random.Random(14)
    common = prose(rng, 10)
    items = [(k, f"{common} {prose(rng, 4)}") for k in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(documents(spark, [(1, " ".join(t for _, t in items), None)]), bench)
    assert sorted(r["item_id"] for r in got.collect()) == list(range(50))


# 9 ---------------------------------------------------------------------------


def test_license_scan_by_brute_force():
    """Every block of every template's length at every place, ranked over all templates: looking at pieces only loses nothing."""
    rng = random.Random(15)
    names = ("MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "ISC", "0BSD", "0BSD OR ISC", "CC-BY-4.0", "CC-BY-SA-4.0")
    some = {n: tuple(t for t in license_scan.TEMPLATES[n] if len(t) < 700) for n in names}
    scanner = license_scan.Scanner(some)
    flat = [t for ts in some.values() for t in ts if len(t) < 320]
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(flat).split()
            for _ in range(rng.randint(0, 1 + len(words) // 7)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["nice"], [words[at], "very"], ["3"]])
            parts += [prose(rng, rng.randint(0, 12)), " ".join(words)]
        text = "\n".join(parts)
        words, rows = license_scan.words_of(text), []
        lines = [text.count("\n", 0, m.start()) for m in license_scan._WORD.finditer(text)]
        windows = {scanner.window(k, at, at, len(words)) for k, (_, wanted, _, _) in enumerate(scanner.each) for at in range(-license_scan.most_edits(wanted), len(words)) if len(wanted) < 60}
        for lo, hi in windows:
            rows.append(scanner.judge(words, lo, hi, lines))
        assert {r[0] for r in scanner.scan(text)} == {r[4] for r in scanner.settle(r for r in rows if r)}, text


def test_licenses_with_common_sentences_are_told_apart():
    scanner = license_scan.Scanner()
    t = license_scan.TEMPLATES
    full = {"MIT": t["MIT"][3], "MIT-0": t["MIT-0"][0], "BSD-2-Clause": t["BSD-2-Clause"][1], "BSD-3-Clause": t["BSD-3-Clause"][1], "ISC": t["ISC"][0], "0BSD": t["0BSD"][0]}
    rng = random.Random(5)
    for name, text in full.items():
        assert [(r[0], r[6]) for r in scanner.scan(f"{prose(rng, 50)}\nCopyright (c) 2020 A. Body\n{text}\n{prose(rng, 50)}")] == [(name, True)]
        assert [(r[0], r[6]) for r in scanner.scan(text.replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- "))] == [(name, True)]
        words = text.split()
        del words[-4], words[-12]
        words.insert(-20, "quite")
        assert [(r[0], r[4] + r[5]) for r in scanner.scan(" ".join(words))] == [(name, 3)]
    # Only a sentence that two have in common.
    assert [r[0] for r in scanner.scan(f"x\n{t['0BSD OR ISC'][0]}.\ny")] == ["0BSD OR ISC"]
    assert [r[0] for r in scanner.scan(t["BSD-2-Clause OR BSD-3-Clause"][0])] == ["BSD-2-Clause OR BSD-3-Clause"]
    both = scanner.scan(f"{full['ISC']}\n{prose(rng, 30)}\n{full['0BSD']}")
    assert [(r[0], r[6]) for r in both] == [("ISC", True), ("0BSD", True)]


def test_the_ranking_decides(monkeypatch):
    """With the same reduction for all templates a whole text that was changed a little is taken for its opening sentence."""
    text = "\n".join(license_scan.TEMPLATES["MIT"][3].replace("AUTHORS", "WRITERS").replace("sublicense, ", "").split())
    found = license_scan.Scanner().scan(text)
    assert [r[0] for r in found] == ["MIT"] and found[0][2] > 150
    monkeypatch.setattr(license_scan.Scanner, "reductions", lambda self, block: [0.5] * len(self.each))
    assert license_scan.Scanner().scan(text) != found


def test_identifiers_and_headings():
    scanner = license_scan.Scanner()
    ids = lambda text: [(r[0], r[1]) for r in scanner.scan(text)]
    assert ids("// SPDX-License-Identifier: MIT\ncode") == [("MIT", 0)] and ids("# SPDX-License-Identifier: GPL-2.0") == [("GPL-2.0", 0)]
    assert ids("SPDX-License-Identifier: BSD-3-Clause\nSPDX-License-Identifier: 0BSD") == [("BSD-3-Clause", 0), ("0BSD", 1)]
    assert ids("Title\n\n  MIT License\n\nCopyright") == [("MIT", 2)] and ids("# BSD 2-Clause License") == [("BSD-2-Clause", 0)]
    assert ids("we like the MIT License a lot") == [] == ids("MIT License text")


# pipeline ---------------------------------------------------------------------


def test_pipeline_ends_with_token_ids(spark, sf_dir):
    import corpus_pipeline

    last = corpus_pipeline.STAGES[-1][1]
    docs = documents(spark, [(1, "one two three", "en"), (None, None, None), (2, "", None), (2, "", None), (3, "word " * 30_000, "en")]).withColumn("ids", F.lit("x"))
    rows = last(spark, docs, sf_dir).collect()
    assert sorted({r["doc_id"] for r in rows}, key=str) == [1, 2, 3, None]
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    assert last(spark, documents(spark, []), sf_dir).count() == 0


def test_pipeline_keeps_what_plain_python_keeps(spark, sf_dir, tmp_path):
    """The five stages on 200 documents and some with benchmark passages, step by step in plain Python: the documents that end up in sequences."""
    import corpus_pipeline

    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    english = [r["text"] for r in docs.where("lang = 'en' AND n_chars BETWEEN 200 AND 2000").orderBy("doc_id").limit(6).collect()]
    passages = [r["text"] for r in bench.orderBy("item_id").collect() if r["text"].isascii() and len(r["text"].split()) > 20][:6]
    planted = [(10**6 + k, f"{a[:150]} {p} {a[150:].replace('th', 'dr')}", "en", "planted", None) for k, (a, p) in enumerate(zip(english, passages, strict=False))]
    docs.select("doc_id", "text", "lang", "source", "n_chars").union(documents(spark, [(d, t, lang) for d, t, lang, *_ in planted])).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    scorer = language_id.Scorer(language_id.train(docs))

    def is_language(text):
        lang, score = scorer.predict(text)
        return lang != "und" and (score >= language_id.LEAST_SCORE or len(language_id.words_of(text)) < language_id.LEAST_WORDS)

    rows = [(d, t) for d, t in rows if is_language(t)]
    last = {}
    for d, t in sorted(rows):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in t)] = d
    rows = [(d, t) for d, t in rows if d in set(last.values())]
    groups = brute_components(rows, 80, 5)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    # Items in ASCII only, so words are those of the brute force; the others' documents are left to the operator's own tests.
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    plain = [(d, t) for d, t in rows if t.isascii()]
    dirty = {d for d, _ in brute_contaminated(plain, [i for i in items if i[1].isascii()])}
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert {d for d, _ in plain} - dirty == kept & {d for d, _ in plain} and len(kept) > 50
    assert kept <= {d for d, _ in rows} and len(dirty) > 0
