"""Secrets in texts: known shapes, and strings that a battery of randomness tests finds random.

Three shapes are searched by pattern, leftmost and not overlapping per kind: assignments of
passwords and the like, access keys, and long hexadecimal runs. The battery adds strings of at
least ``LEAST`` characters of an encoding's alphabet. For each string an encoding is inferred, the
smallest alphabet that holds it, and three tests ask whether it could be uniform over that alphabet:
chi-squared of its letters, runs above and below the middle, and correlation of neighbours.

Strings that pass are then tested against language: of n letters drawn as the words of all documents
draw them, how likely is it that so few pairs are equal? Words are whole runs of one case, shorter
than any string under test and outside the known shapes, so secrets, however many, are no part of
what they are held against; a thousand letters of English stand in where there are few words. The
moments of that count are exact. The probabilities go through false-discovery control (Benjamini-Hochberg at
``ALPHA``) within each encoding and doubling of length, so short strings, of which there are many
and which prove little, raise the bar for themselves only. Letter counts, test counts and
thresholds are made over all documents.

SQL functions only. Offsets are in code points, ends exclusive. A document's matches become rows
whose positions are running sums, so the work is linear in the matches. Strings that overlap a
span of a known shape are not added.

Defined cases: null texts are empty; documents without finds have empty spans; repeated rows are
searched each; null ids are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import documents, store

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# the shortest lengths stand in these two patterns: a run too short has no longer part
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
LEAST, ALPHA, UNIFORM_P = 20, 0.01, 0.001
RANDOM = r"[A-Za-z0-9+/_-]{20,}"
# whole runs of the letters above that are words: of one case or capitalised, shorter than LEAST
WORD = r"(?<![A-Za-z0-9+/_-])(?:[A-Z]?[a-z]{1,18}+|[A-Z]{1,19}+)(?![A-Za-z0-9+/_-])"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
LETTERS = UPPER + LOWER
#: letters a to z in a thousand of English
ENGLISH = [82, 15, 28, 43, 126, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 18, 1]
#: name, pattern and alphabet, the smallest first
ENCODINGS = [
    ("digits", "^[0-9]+$", DIGITS),
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("lower36", "^[a-z0-9]+$", LOWER + DIGITS),
    ("upper36", "^[A-Z0-9]+$", UPPER + DIGITS),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", "", UPPER + LOWER + DIGITS + "+/_-"),
]


def matches(text: str, pattern: str) -> Column:
    """Array of (gap, value): every match, and the characters between it and the match before."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.zip_with(values, F.slice(pieces, 1, F.size(values)), lambda v, p: F.struct(F.length(p).cast("long").alias("gap"), v.alias("value")))
    return F.when(F.rlike(text, F.lit(pattern)), both)


def word_letters(text: str) -> Column:
    """How often each of ``LETTERS`` stands in the words of a text, known shapes left out."""
    for pattern in (ASSIGN, ACCESS):
        text = F.regexp_replace(text, F.lit(pattern), F.lit(" "))
    words = F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "")
    # an array of one, so that the words are cut once and not for every letter
    count = lambda w: F.transform(F.split(F.lit(LETTERS), ""), lambda c: F.length(w) - F.length(F.replace(w, c, F.lit(""))))
    return F.transform(F.array(words), count)[0]


def spans_of(found: DataFrame, column: str) -> DataFrame:
    """rid, start, end, value of every match in an array of ``matches``."""
    rows = found.select("rid", F.posexplode(column).alias("k", "m")).select("rid", "k", "m.gap", "m.value")
    rows = rows.withColumn("n", F.length("value").cast("long"))
    upto = Window.partitionBy("rid").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto))
    return rows.select("rid", (F.col("end") - F.col("n")).alias("start"), "end", "value")


def upper_tail(z: Column) -> Column:
    """Probability that a normal variable exceeds z, by a rational approximation good to 1e-7 (relative to its tail, in the exponent)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(strings: DataFrame) -> DataFrame:
    """``strings(value)`` with encoding, letter counts, pairs of equal letters and the uniformity probability."""
    encoding = F.lit(ENCODINGS[-1][0])
    for name, pattern, _ in reversed(ENCODINGS[:-1]):
        encoding = F.when(F.rlike("value", F.lit(pattern)), name).otherwise(encoding)
    alphabet = F.lit("")
    for name, _, letters in ENCODINGS:
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    rows = strings.withColumn("encoding", encoding).withColumn("alphabet", alphabet)
    rows = rows.withColumn("n", F.length("value").cast("double")).withColumn("a", F.length("alphabet").cast("double"))
    rows = rows.withColumn("counts", F.expr("transform(split(alphabet, ''), c -> length(value) - length(replace(value, c, '')))"))
    rows = rows.withColumn("x", F.expr("transform(split(value, ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    rows = rows.withColumn("squares", F.expr("aggregate(counts, 0D, (s, c) -> s + cast(c as double) * c)"))
    rows = rows.withColumn("mean", F.expr("aggregate(x, 0D, (s, v) -> s + v) / n"))
    rows = rows.withColumn("spread", F.expr("aggregate(x, 0D, (s, v) -> s + (v - mean) * (v - mean))"))
    rows = rows.withColumn("steps", F.expr("zip_with(slice(x, 1, size(x) - 1), slice(x, 2, size(x) - 1), (u, v) -> struct(u, v))"))
    rows = rows.withColumn("serial", F.expr("aggregate(steps, 0D, (s, p) -> s + (p.u - mean) * (p.v - mean)) / greatest(spread, 1e-9)"))
    rows = rows.withColumn("high", F.expr("cast(size(filter(x, v -> 2 * v >= a - 1)) as double)"))
    rows = rows.withColumn("runs", F.expr("1D + size(filter(steps, p -> (2 * p.u >= a - 1) <> (2 * p.v >= a - 1)))"))
    chi = (F.col("squares") * F.col("a") / F.col("n") - F.col("n")) / (F.col("a") - 1)
    part = 2 / (9 * (F.col("a") - 1))
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)), F.lit(1 / 3)) - (1 - part)) / F.sqrt(part)
    share = 2 * F.col("high") * (F.col("n") - F.col("high"))
    spread_runs = share * (share - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    z_runs = (F.col("runs") - 1 - share / F.col("n")) / F.sqrt(F.greatest(spread_runs, F.lit(1e-9)))
    z_serial = F.col("serial") * F.sqrt("n")
    least = F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))
    return rows.withColumn("p_uniform", F.least(3 * least, F.lit(1.0))).withColumn("pairs", (F.col("squares") - F.col("n")) / 2).drop("x", "steps")


def random_strings(strings: DataFrame, letters: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The rows of ``strings(.., value)`` that the battery and the false-discovery control call random.

    ``letters(letters)`` has the counts of ``word_letters``, of any number of texts a row.
    """
    keys = [c for c in strings.columns if c != "value"]
    rows = store(tested(strings).select(*keys, "encoding", "alphabet", "n", "pairs", "p_uniform"), "tested")
    sums = letters.select(F.posexplode("letters").alias("k", "c")).groupBy("k").agg(F.sum("c").alias("c"))
    counts = dict(zip(LETTERS, [0] * len(UPPER) + ENGLISH))
    for r in sums.collect():  # one row a letter
        counts[LETTERS[r.k]] += r.c
    # how often two, and three, letters drawn from the documents' words are equal
    t, t2, t3 = (float(sum(c**k for c in counts.values())) for k in (1, 2, 3))
    n, q, s = F.col("n"), F.lit(t2 / t**2), F.lit(t3 / t**3)
    variance = n * (n - 1) / 2 * (q - q * q) + n * (n - 1) * (n - 2) * (s - q * q)
    z = (n * (n - 1) / 2 * q - F.col("pairs")) / F.sqrt(F.greatest(variance, F.lit(1e-9)))
    rows = rows.withColumn("bin", F.floor(-10 * F.log10(F.greatest(upper_tail(z), F.lit(1e-40)))))
    rows = rows.withColumn("stratum", F.concat_ws(":", "encoding", F.floor(F.log2("n")).cast("string")))
    rows = rows.withColumn("uniform", F.col("p_uniform") >= UNIFORM_P)
    # Benjamini-Hochberg on bins of a tenth of a power of ten; a bin stands for its largest probability
    bins = rows.groupBy("stratum", "bin").agg(F.count("*").alias("k"))
    down = Window.partitionBy("stratum").orderBy(F.col("bin").desc())
    bins = bins.withColumn("rank", F.sum("k").over(down)).withColumn("m", F.sum("k").over(Window.partitionBy("stratum")))
    passed = bins.filter(F.pow(F.lit(10.0), -F.col("bin") / 10) <= F.col("rank") * alpha / F.col("m"))
    bar = passed.groupBy("stratum").agg(F.min("bin").alias("bar"))
    return rows.join(bar, "stratum").filter("bin >= bar and uniform").select(*keys, "encoding")


def secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ``found``: the array of (start, kind number, end) of all secrets, sorted."""
    rows = documents(docs, id_column, text_column).toDF("doc_id", "text")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RANDOM}
    found = rows.select("rid", "doc_id", *[matches("text", p).alias(k) for k, p in patterns.items()], word_letters("text").alias("letters"))
    found = store(found, "matches")
    base = None
    for number, kind in enumerate(KINDS[:3]):
        spans = spans_of(found.filter(F.col(kind).isNotNull()), kind)
        if kind == "assign":
            spans = spans.filter(F.length(F.regexp_extract("value", ASSIGN, 1)) >= 8)
        spans = spans.select("rid", F.struct("start", F.lit(number).alias("kind"), "end").alias("span"))
        base = spans if base is None else base.union(spans)
    base = store(base.groupBy("rid").agg(F.collect_list("span").alias("base")), "base")
    strings = spans_of(found.filter("random is not null"), "random")
    more = random_strings(strings, found.select("letters")).select("rid", F.struct("start", F.lit(3).alias("kind"), "end").alias("span"))
    more = more.groupBy("rid").agg(F.collect_list("span").alias("more"))
    out = found.select("rid", "doc_id").join(base, "rid", "left").join(more, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = out.withColumn("base", F.array_sort(F.coalesce("base", none))).withColumn("more", F.coalesce("more", none))
    apart = F.expr("filter(more, m -> not exists(base, b -> b.start < m.end and m.start < b.end))")
    return out.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("found"))


def written(column: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = "array('" + "', '".join(KINDS) + "')"
    return F.expr(f"array_join(transform({column}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("found").alias("spans"))
