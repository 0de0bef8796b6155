"""Secrets in text: three plain patterns, and a battery of randomness tests.

Everything is DataFrame work on the JVM. Patterns find assignments to password
words, access keys and runs of hex digits. Beside them, all long runs of encoding
characters are tested for randomness under the encoding that
their characters suggest (hex, base32, base62, base64, base64url): chi-squared
uniformity over the alphabet, a runs test about its middle, and the correlation
of neighbours, combined by Fisher's method. Runs that lie within a span of a
pattern count in what follows, but are not found twice.

A run counts as a secret if randomness cannot be rejected, and how much that
means depends on its class: encoding, length, and whether it has a digit (words
and names have none). So the level is set by class over the whole corpus:
p-values of random runs are uniform, hence twice those above one half (and a
standard deviation for chance) tells how many there are, and the least level is
taken at which the runs beyond that number are at most ``FALSE_SHARE`` of what
passes; at one half that always holds. A class of fewer than ``ENOUGH`` runs that
may be random (p of ``FALLBACK`` at least) borrows those of the next lengths of
its encoding, then of all encodings; where all are too few the level is
``FALLBACK``. No class is without a level.

Positions are code points, ends exclusive. Null and empty texts have no spans;
rows keep doc_id, null or repeated, as it is; ties are ordered by start, then
kind as listed. Whole texts of any length are read, in time that grows with the text
and its matches; other columns are not. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Kind, pattern, the group whose length counts, its least length.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Runs that are tested: 20 encoding characters or more.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = (*(k for k, *_ in PATTERNS), "random")
#: Encodings by the first pattern that fits, and their alphabets in order.
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Lengths from which a new level is set.
LENGTHS = (20, 24, 32, 48, 64, 128)
#: Levels that may be set.
LEVELS = (0.001, 0.01, 0.02, *(k / 20 for k in range(1, 11)))
FALSE_SHARE, FALLBACK, ENOUGH = 0.1, 0.05, 100


#: Matches that are placed together: appending to an array costs as much as it is long, so a long list goes by parts.
PART = 256
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def found_spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end), failing ones dropped.

    The text between matches comes from ``split``; lengths add up to positions.
    Parts of ``PART`` matches have their lengths summed first, so that each can
    be placed by itself and no array grows with all matches of a text.
    """
    none = F.array().cast(_SPANS)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    each = F.zip_with(F.zip_with(lengths, counted, lambda n, c: F.struct(n.alias("length"), c.alias("counted"))), gaps, lambda x, g: F.struct(x["length"].alias("length"), x["counted"].alias("counted"), g.alias("gap")))
    # The last gap follows the last match and has no length.
    each = F.filter(each, lambda x: x["length"].isNotNull())

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["length"]).alias("end"))
        return F.struct((start + x["length"]).alias("at"), F.when(x["counted"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), place)["out"]

    def by_parts(every: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PART).cast("int")), lambda k: F.slice(every, k * PART + 1, F.lit(PART)))
        widths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["length"]))
        ends = F.aggregate(widths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(ends, F.lit(1), F.size(parts)), placed))

    held = lambda every: F.when(F.size(every) <= PART, placed(every, F.lit(0))).otherwise(by_parts(every))
    # A lambda of one value gives the list a name, so it is made once.
    spans = F.element_at(F.transform(F.array(each), held), 1)
    return F.when(text.rlike(pattern), spans).otherwise(none)


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|), by a logistic approximation (error below 0.0002)."""
    a = F.least(F.abs(z), F.lit(8.0))
    return 2 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def upper_tail(z: Column) -> Column:
    """P(Z > z)."""
    a = F.greatest(F.lit(-8.0), F.least(z, F.lit(8.0)))
    return 1 / (1 + F.exp(1.5976 * a + 0.07056 * a * a * a))


def encoding_of(run: Column) -> Column:
    out = F.lit("other")
    for k, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(run.rlike(pattern), F.lit(ENCODINGS[k][0])).otherwise(out)
    return out


def _by_encoding(encoding: Column, value) -> Column:
    out = None
    for name, _, alphabet in reversed(ENCODINGS):
        out = F.lit(value(alphabet)) if out is None else F.when(encoding == name, F.lit(value(alphabet))).otherwise(out)
    return out


def random_p(runs: DataFrame) -> DataFrame:
    """Adds encoding, n and p to a table of runs: the probability that random characters look less random."""
    alphabet = _by_encoding(F.col("encoding"), lambda a: a)
    runs = runs.withColumn("encoding", encoding_of(F.col("run"))).withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet"))
    runs = runs.withColumn("body", F.when(F.col("encoding") == "hex", F.lower("run")).otherwise(F.col("run"))).withColumn("n", F.length("body").cast("double"))
    # Squared counts by what is left when a character is taken out: no table of pairs, however long the run.
    squares = F.aggregate(F.split("alphabet", ""), F.lit(0.0), lambda t, c: t + F.pow(F.col("n") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2.0)))
    runs = runs.withColumn("chi", squares * F.col("k") / F.col("n") - F.col("n"))
    # Places in the alphabet, folded from left to right.
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("s", "ss", "sp", "high", "turns")), F.lit(-1.0).alias("last"))

    def step(acc: Column, c: Column) -> Column:
        x = (F.instr(F.col("alphabet"), c) - 1).cast("double")
        first, high = acc["last"] < 0, x >= F.col("k") / 2
        turned = ~first & (high != (acc["last"] >= F.col("k") / 2))
        return F.struct(
            (acc["s"] + x).alias("s"), (acc["ss"] + x * x).alias("ss"), (acc["sp"] + F.when(first, 0.0).otherwise(x * acc["last"])).alias("sp"),
            (acc["high"] + F.when(high, 1.0).otherwise(0.0)).alias("high"), (acc["turns"] + F.when(turned, 1.0).otherwise(0.0)).alias("turns"), x.alias("last"),
        )

    runs = runs.withColumn("m", F.aggregate(F.split("body", ""), start, step))
    n, m = F.col("n"), F.col("m")
    df = (F.col("k") - 1).cast("double")
    chi_p = upper_tail((F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))  # Wilson-Hilferty
    low = n - m["high"]
    mean = 2 * m["high"] * low / n
    runs_p = F.when((m["high"] == 0) | (low == 0), F.lit(1e-9)).otherwise(normal_tail((m["turns"] - mean) / F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(1e-9)))))
    average = m["s"] / n
    spread = m["ss"] / n - average * average
    serial_p = F.when(spread <= 0, F.lit(1e-9)).otherwise(normal_tail((m["sp"] / (n - 1) - average * average) / spread * F.sqrt(n)))
    half = -(F.log(F.greatest(chi_p, F.lit(1e-9))) + F.log(F.greatest(runs_p, F.lit(1e-9))) + F.log(F.greatest(serial_p, F.lit(1e-9))))
    return runs.withColumn("p", F.exp(-half) * (1 + half + half * half / 2)).drop("alphabet", "k", "body", "chi", "m")


def length_class(n: Column) -> Column:
    out = F.lit(LENGTHS[0])
    for least in LENGTHS[1:]:
        out = F.when(n >= least, F.lit(least)).otherwise(out)
    return out


def level_of(counts: list[int]) -> float:
    """The least level that keeps the share of false runs; counts[k] runs have p from LEVELS[k - 1] on and below LEVELS[k]."""
    random = 2 * counts[-1]
    random = min(sum(counts), random + random**0.5)
    for k, level in enumerate(LEVELS[:-1]):
        passing = sum(counts[k + 1 :])
        if passing - random * (1 - level) <= FALSE_SHARE * passing:
            return level
    return LEVELS[-1]


def class_levels(counts: dict[tuple[str, bool, int], list[int]]) -> dict[tuple[str, bool, int], float]:
    """A level for each class (encoding, with a digit, length) of ``counts``."""
    possible = LEVELS.index(FALLBACK) + 1
    out = {}
    for encoding, digit, length in counts:
        like = {c: v for c, v in counts.items() if c[1] == digit}
        apart = lambda c: abs(LENGTHS.index(c[2]) - LENGTHS.index(length))  # noqa: B023, E731
        pools = [[v for c, v in like.items() if c[0] == encoding and apart(c) <= k] for k in range(len(LENGTHS))] + [list(like.values())]
        sums = ([sum(bins) for bins in zip(*pool, strict=True)] for pool in pools)
        out[encoding, digit, length] = next((level_of(held) for held in sums if sum(held[possible:]) >= ENOUGH), FALLBACK)
    return out


def levels(tested: DataFrame) -> Column:
    """The level of a run's class; random runs have p of at least the level. Null for other encodings, which are not tested."""
    at = sum((F.when(F.col("p") >= level, 1).otherwise(0) for level in LEVELS), F.lit(0))
    grouped = tested.where("encoding <> 'other'").groupBy("encoding", "digit", length_class(F.col("n")).alias("length"), at.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    counts: dict[tuple[str, bool, int], list[int]] = {}
    for r in grouped.collect():  # a row per class and bin: 840 at most
        counts.setdefault((r["encoding"], r["digit"], r["length"]), [0] * (len(LEVELS) + 1))[r["bin"]] = r["c"]
    out = F.lit(None).cast("double")
    for (encoding, digit, length), level in class_levels(counts).items():
        out = F.when((F.col("encoding") == encoding) & (F.col("digit") == digit) & (F.col("length") == length), level).otherwise(out)
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def outside(found: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with inside: whether a run lies within a span of a pattern of its text.

    Such runs count for the levels only; those that reach beyond a span may be
    secrets of their own. Spans and runs of a text are merged in order of start,
    with the furthest end of a span so far: one pass, however many there are.
    """
    spans = found.where((F.size("runs") > 0) & (F.size("base") > 0)).select("row_key", F.explode("base").alias("span")).select("row_key", "span", F.lit(None).cast("string").alias("run"))
    so_far = Window.partitionBy("row_key").orderBy("span.start", F.col("run").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("run").isNull(), F.col("span.end"))).over(so_far)
    return spans.unionByName(runs).withColumn("inside", F.coalesce(reach >= F.col("span.end"), F.lit(False))).where("run IS NOT NULL")


def secret_scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, counts by pattern, base_sha256, spans and secrets (array of kind, start, end, p)."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = text.select(
        "doc_id",
        *(found_spans(F.col("text"), k, pattern, group, least).alias(kind) for k, (kind, pattern, group, least) in enumerate(PATTERNS)),
        found_spans(F.col("text"), len(PATTERNS), CANDIDATE, 0, 0).alias("runs"),
        F.when(F.col("text").rlike(CANDIDATE), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("strings"),
    )
    base = F.array_sort(F.concat(*(F.col(kind) for kind, *_ in PATTERNS)))
    found = found.select("doc_id", *(F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in PATTERNS), base.alias("base"), F.arrays_zip("runs", F.col("strings")).alias("runs"))
    found = scratch.keep(found.withColumn("row_key", F.monotonically_increasing_id()), "found")

    runs = found.where(F.size("runs") > 0).select("row_key", F.explode("runs").alias("r")).select("row_key", F.col("r.runs").alias("span"), F.col("r.strings").alias("run"))
    tested = scratch.keep(random_p(outside(found, runs).withColumn("digit", F.col("run").rlike("[0-9]"))).drop("run"), "tested")
    tested = tested.withColumn("length", length_class(F.col("n"))).withColumn("level", levels(tested)).where("p >= level AND NOT inside")
    added = tested.groupBy("row_key").agg(F.collect_list(F.struct("span.start", "span.kind", "span.end", "p")).alias("added"))  # of one document
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,p:double>>")
    out = found.drop("runs").join(added, "row_key", "left").withColumn("added", F.coalesce("added", nothing))
    every = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("double").alias("p"))), "added"))
    return out.select("doc_id", *(f"n_{kind}" for kind, *_ in PATTERNS), F.size("added").cast("long").alias("n_random"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"), every.alias("secrets"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("secrets")
