"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import anchor_simhash, burst_trie, curve_ann, decontaminate, language_id, merkle, mixing, odd_sketch, quality, secret_scan, suffix_dedup, token_scan, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, encode(coalesce(text, '')) AS raw FROM documents),
h AS (SELECT rid, doc_id, text, raw, octet_length(raw) AS n, lower(hex(raw)) AS x FROM d),
w AS (SELECT rid, unnest(range(0, n - 399)) AS p, x FROM h WHERE n >= 400),
k AS (SELECT rid, p, md5_number(substr(x, 2 * p + 1, 800)) AS g FROM w),
t AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM k) WHERE c > 1),
s AS (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 OR lag(p) OVER (PARTITION BY rid ORDER BY p) IS NULL THEN 1 ELSE 0 END AS new FROM t),
r AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM s),
c AS (SELECT rid, run, min(p) AS a, max(p) + 400 AS b FROM r GROUP BY ALL),
o AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM c GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(starts) + 1), lambda i:
        substr(x, CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END, 2 * (CASE WHEN i = len(starts) THEN n ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE ends[i] END))), '') END)) AS kept_sha256
FROM h LEFT JOIN o USING (rid)
"""
)
def op1_suffix_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that repeat as part of a string of 400 bytes."""
    found = suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents"), 400)
    spans = F.size("span_starts").cast("long").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", spans, "kept_sha256")


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""


@query(
    f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * k >= 85 * (nu.n + nv.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
)
def op4_odd_sketch_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` on 3-word shingles at a similarity of 0.85."""
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query()
def op3_segmentation_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and summed up per document."""
    return token_store.round_trip(table(spark, sf_dir, "documents"))


@query()
def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat files without an index."""
    return token_scan.count_documents(table(spark, sf_dir, "documents"))


def _keys_sql(seed: str, size: str) -> str:
    one = f"(({seed} + r * 1299709) % {mixing.PRIME})"
    high = f"(({one} * {one} + 12345) % {mixing.PRIME})"
    low = f"(({high} * {high} + 67891) % {mixing.PRIME})"
    return f"list_transform(range(0, {mixing.ROUNDS}), lambda r: ({high} * 2147483648 + {low}) % greatest({size}, 1))"


def _permuted_sql(x: str, keys: str, size: str) -> str:
    mirror = f"((k + {size} - a) % {size})"
    point = f"((greatest(a, {mirror}) % {mixing.PRIME} + k % {mixing.PRIME}) % {mixing.PRIME})"
    bit = f"((({point} * {point} + 99991) % {mixing.PRIME} * 48271 % {mixing.PRIME}) // 65536) % 2"
    return f"list_reduce({keys}, lambda a, k: CASE WHEN {bit} = 1 THEN {mirror} ELSE a END, {x})"


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][(source_no % 3 + 1)::INT]::BIGINT AS w, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s0),
s2 AS (SELECT *, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_before,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w_left FROM s1 WINDOW o AS (ORDER BY source_size / w, source_no)),
s3 AS (SELECT *, 2 * source_size * w_left <= (total - full_before) * w AS filled FROM s2),
s4 AS (SELECT *, sum(CASE WHEN filled THEN 2 * source_size ELSE 0 END) OVER ()::BIGINT AS full_size, sum(CASE WHEN filled THEN 0 ELSE w END) OVER ()::BIGINT AS w_open FROM s3),
s5 AS (SELECT *, CASE WHEN filled THEN (2 * source_size)::DOUBLE ELSE w * ((total - full_size) / w_open) END AS target, (source_size + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks FROM s4),
s6 AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2 * blocks, floor(target * blocks / source_size + 0.5)::BIGINT) END AS slots,
    (n + {mixing.BUCKET_ROWS - 1}) // {mixing.BUCKET_ROWS} AS buckets FROM s5),
k AS (SELECT *, {_keys_sql("(42 + source_no * 7919)", "blocks")} AS keys0, {_keys_sql("(42 + source_no * 7919 + 104729)", "blocks")} AS keys1 FROM s6),
j AS (SELECT source_no, blocks, keys0, keys1, unnest(range(0, slots)) AS j FROM k),
t AS (SELECT source_no, CASE WHEN j < blocks THEN {_permuted_sql("j", "keys0", "blocks")} ELSE {_permuted_sql("j - blocks", "keys1", "blocks")} END AS block FROM j),
times AS (SELECT source_no, block, count(*) AS times FROM t GROUP BY ALL),
p AS (SELECT d.doc_id, d.size, s6.source_no, s6.source_size, s6.target, row_number() OVER () AS rid,
    coalesce(sum(d.size) OVER (PARTITION BY s6.source_no ORDER BY (coalesce(d.doc_id, 0) + d.size) % s6.buckets, d.doc_id NULLS FIRST, d.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
b AS (SELECT rid, source_no, start, size, unnest(range(start // {mixing.BLOCK}, (start + size - 1) // {mixing.BLOCK} + 1)) AS block FROM p WHERE size > 0),
g AS (SELECT rid, sum(times * (least(start + size, (b.block + 1) * {mixing.BLOCK}) - greatest(start, b.block * {mixing.BLOCK})))::BIGINT AS taken
    FROM b JOIN times USING (source_no, block) GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN g USING (rid)
"""


@query(MIX_SQL)
def op6_multinomial_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at source weights 3, 1, 2, repeating."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query()
def op5_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in a document, with the overlaps that prove it."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the known shapes and what the randomness tests add."""
    return secret_scan.report(table(spark, sf_dir, "documents"))


@query()
def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of two thirds of them."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, among all."""
    return curve_ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    shift = "list_reduce(list_concat([xor(c, b)], range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {shift}), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({f})) || ':' || {f}, '-')" for f in fields) + "))"


def _merkle_sql(levels: int = 13, top: int = 8) -> str:
    """The manifest with so many levels unrolled: 3 to that power leaves a source, and sources."""
    steps = []

    def tree(name: str, count: int) -> None:
        for k in range(count):
            siblings = "OVER (PARTITION BY t, i // 3 ORDER BY i ROWS BETWEEN {} AND {})"
            left = siblings.format("UNBOUNDED PRECEDING", "1 PRECEDING")
            right = siblings.format("1 FOLLOWING", "UNBOUNDED FOLLOWING")
            steps.append(
                f"{name}s{k} AS MATERIALIZED (SELECT t, i, n, coalesce(string_agg(d, '') {left}, '') AS l, coalesce(string_agg(d, '') {right}, '') AS r FROM {name}{k}),\n"
                f"{name}{k + 1} AS MATERIALIZED (SELECT t, i // 3 AS i, (n + 2) // 3 AS n, CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d FROM {name}{k} GROUP BY t, i // 3, n)"
            )

    tree("a", levels)
    steps.append(f"b0 AS MATERIALIZED (SELECT 0 AS t, t AS i, count(*) OVER () AS n, d FROM a{levels})")
    tree("b", top)
    folds = [("f0", "SELECT rid, t, i, folded AS acc, '' AS proof FROM leaves")]
    fold = "CASE WHEN s.n > 1 THEN sha256(concat(s.l, f.acc, s.r)) ELSE f.acc END AS acc, CASE WHEN s.n > 1 THEN concat(f.proof, s.l, s.r) ELSE f.proof END AS proof"
    for k in range(levels):
        folds.append((f"f{k + 1}", f"SELECT f.rid, f.t, f.i // 3 AS i, {fold} FROM f{k} f JOIN as{k} s USING (t, i)"))
    folds.append(("g0", f"SELECT rid, 0 AS t, t AS i, acc, proof FROM f{levels}"))
    for k in range(top):
        folds.append((f"g{k + 1}", f"SELECT f.rid, f.t, f.i // 3 AS i, {fold} FROM g{k} f JOIN bs{k} s USING (t, i)"))
    steps += [f"{name} AS MATERIALIZED ({sql})" for name, sql in folds]
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, *, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS changed,
    coalesce({_crc32_sql("doc_id::VARCHAR")} % 2 = 0, false) AS hit FROM documents),
leaves AS MATERIALIZED (SELECT rid, doc_id, leaf, CASE WHEN hit THEN changed ELSE leaf END AS folded,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
a0 AS MATERIALIZED (SELECT t, i, n, leaf AS d FROM leaves),
{", ".join(steps)}
SELECT l.doc_id, l.leaf, a.d AS subroot, b.d AS root, sha256(g.proof) AS proof_sha256, g.acc AS folded_root, g.acc = b.d AS verified
FROM leaves l JOIN g{top} g USING (rid) JOIN a{levels} a ON a.t = l.t JOIN b{top} b ON true
"""


@query(_merkle_sql())
def op13_pointer_jumping_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document against the root of all."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query()
def op11_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` by 64-bit fingerprints of 3-word shingles at 3 bits or fewer."""
    return anchor_simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=3)


@query(
    rf"""
WITH t AS (SELECT conv_id AS c, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list(s ORDER BY p) AS own, {_crc32_sql("c::VARCHAR")} % 4 AS h, c - c % 20 AS base FROM t GROUP BY c),
r AS MATERIALIZED (SELECT l.c, list_concat(list_slice(coalesce(b.own, []), 1, l.h), list_slice(l.own, l.h + 1, len(l.own))) AS seq FROM l LEFT JOIN l b ON b.c = l.base),
e AS (SELECT c, len(seq) AS n, seq, unnest(range(0, len(seq) + 1)) AS d FROM r),
n AS MATERIALIZED (SELECT d, list_slice(seq, 1, d) AS path, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM e GROUP BY d, path),
k AS MATERIALIZED (SELECT n.*, coalesce(x.n_children, 0) AS n_children FROM n LEFT JOIN
    (SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) x USING (d, path)),
u AS (SELECT unnest(range(0, d + 1)) AS k, path AS whole, n_children,
    CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM k),
s AS (SELECT k AS d, list_slice(whole, 1, k) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM u GROUP BY ALL)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (d, path) LEFT JOIN n p ON p.d = k.d - 1 AND p.path = list_slice(k.path, 1, k.d - 1)
"""
)
def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return burst_trie.conversation_trie(table(spark, sf_dir, "conversations"))
