"""Sources mixed to target weights, in blocks of words; SQL functions only.

The words of each source form one stream, cut into blocks of ``BLOCK`` words. Sources in code
point order, null last, weigh 3, 1, 2, repeating; together they get 150 % of all words. A target
stops at twice its source's words and what is over is shared out again by weight, which is one
water level found by running sums over the sources.

A source gets as many slots as its target has blocks. All slots together are dealt to output
shards by one pseudorandom permutation, so a shard's counts per source are a multinomial draw,
taken without replacement so that the totals are met. A source's slots go through its blocks in
passes, each pass by a pseudorandom permutation of its own of the block indexes (swap-or-not
rounds, a bijection on any range). Slots then join blocks by index. At most two passes begin, so
no document is taken more than twice.

Positions in a stream are sums in two levels: documents are dealt to buckets of about
``BUCKET_ROWS`` by id, summed within the bucket and then over the buckets, so that no source is
summed by one task. Everything follows from ids and sizes, and reruns agree.

Defined cases: null and empty texts have size 0 and are returned with 0 words taken; a source
without words has target 0; null ids sort first; repeated rows are documents of their own;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import documents, store

BLOCK, SHARD_SLOTS, BUCKET_ROWS, ROUNDS, RUN = 64, 1024, 4096, 16, 4096
#: runs of slots in one task
TASK_RUNS = 8
PRIME = 2147483647
WORD = r"[^\x20\x09-\x0D]+"


def round_keys(seed: str, size: str) -> str:
    """SQL: one key below ``size`` for each round, from the integer ``seed``."""
    one = f"(({seed} + r * 1299709) % {PRIME})"
    high = f"(({one} * {one} + 12345) % {PRIME})"
    low = f"(({high} * {high} + 67891) % {PRIME})"
    return f"transform(sequence(0L, {ROUNDS - 1}L), r -> ({high} * 2147483648 + {low}) % greatest({size}, 1L))"


def permuted(x: str, keys: str, size: str) -> str:
    """SQL: swap-or-not rounds over [0, size): x and its mirror image change places on a hashed bit."""
    mirror = f"((k + {size} - a) % {size})"
    point = f"((greatest(a, {mirror}) % {PRIME} + k % {PRIME}) % {PRIME})"
    bit = f"((({point} * {point} + 99991) % {PRIME} * 48271 % {PRIME}) div 65536) % 2"
    return f"aggregate({keys}, {x}, (a, k) -> if({bit} = 1, {mirror}, a))"


def source_targets(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """One row per source: number, words, blocks, target, slots and where its slots begin."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    found = found.withColumn("source_no", F.row_number().over(order).cast("long") - 1)
    found = found.withColumn("w", F.expr("element_at(array(3L, 1L, 2L), cast(source_no % 3 as int) + 1)"))
    rising = Window.orderBy(F.expr("source_size / w"), "source_no")
    everything = Window.partitionBy(F.lit(0))
    found = (
        found.withColumn("total", 1.5 * F.sum("source_size").over(everything))
        .withColumn("full_before", F.coalesce(F.sum(2 * F.col("source_size")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.expr("2 * source_size * w_left <= (total - full_before) * w"))
        .withColumn("full_size", F.coalesce(F.sum(F.expr("if(full, 2 * source_size, 0L)")).over(everything), F.lit(0)))
        .withColumn("w_open", F.sum(F.expr("if(full, 0L, w)")).over(everything))
        .withColumn("target", F.expr("if(full, cast(2 * source_size as double), w * ((total - full_size) / w_open))"))
        .withColumn("blocks", F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}"))
        .withColumn("slots", F.expr("if(source_size = 0, 0L, least(2 * blocks, cast(floor(target * blocks / source_size + 0.5) as bigint)))"))
        .withColumn("slot_begin", F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        .withColumn("all_slots", F.sum("slots").over(everything))
        .withColumn("buckets", F.expr(f"(n_docs + {BUCKET_ROWS - 1}) div {BUCKET_ROWS}"))
    )
    return found.select(
        "source", "source_no", "source_size", "target", "blocks", "slots", "slot_begin", "all_slots", "buckets", F.lit(seed).cast("long").alias("seed")
    )


def slot_plan(targets: DataFrame) -> DataFrame:
    """shard, slot, source_no, block: which block each slot of each output shard holds."""
    runs = targets.filter("slots > 0").withColumn("run", F.explode(F.expr(f"sequence(0L, slots - 1, {RUN}L)")))
    # a stated number of partitions, which adaptive execution leaves as it is: the rows are few, the work is not
    count = targets.agg(F.sum(F.expr(f"(slots + {RUN - 1}) div {RUN}"))).first()[0] or 0
    runs = runs.repartition(max(1, -(-count // TASK_RUNS)), "source_no", "run")
    runs = (
        runs.withColumn("keys0", F.expr(round_keys("(seed + source_no * 7919)", "blocks")))
        .withColumn("keys1", F.expr(round_keys("(seed + source_no * 7919 + 104729)", "blocks")))
        .withColumn("keys_out", F.expr(round_keys("(seed + 15485863)", "all_slots")))
    )
    slots = runs.withColumn("j", F.explode(F.expr(f"sequence(run, least(run + {RUN - 1}, slots - 1))")))
    slots = slots.withColumn("block", F.expr(f"if(j < blocks, {permuted('j', 'keys0', 'blocks')}, {permuted('j - blocks', 'keys1', 'blocks')})"))
    slots = slots.withColumn("place", F.expr(permuted("slot_begin + j", "keys_out", "all_slots")))
    return slots.select(F.expr(f"place div {SHARD_SLOTS}").alias("shard"), F.expr(f"place % {SHARD_SLOTS}").alias("slot"), "source_no", "block")


def document_sizes(docs: DataFrame, *also: str) -> DataFrame:
    """Every document's words, with a row number of its own; stored."""
    rows = documents(docs, "doc_id", "source", "text", *also)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), *also)
    return store(rows, "sizes")


def stream_positions(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with its source's number and the position of its first word in the source's stream."""
    of_source = targets.select(F.col("source").alias("s"), "source_no", "buckets")
    rows = sizes.join(of_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.expr("pmod(coalesce(doc_id, 0L) + size, buckets)"))
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), zero))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), zero).alias("begin"))
    return rows.join(begins, ["source_no", "bucket"]).withColumn("start", F.col("begin") + F.col("within"))


def document_blocks(placed: DataFrame) -> DataFrame:
    """A row for each block a document reaches into: rid, source_no, block, words of it in the block, and from which word."""
    reach = F.expr(f"if(size > 0, sequence(start div {BLOCK}, (start + size - 1) div {BLOCK}), null)")
    rows = placed.withColumn("block", F.explode(reach))
    return rows.select(
        "rid",
        "source_no",
        "block",
        F.expr(f"greatest(start, block * {BLOCK}) - start").alias("first_word"),
        F.expr(f"least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})").alias("words"),
    )


def taken_blocks(placed: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents' blocks that the mix takes, with ``times``, by joining slots to blocks by index."""
    times = slot_plan(targets).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    return document_blocks(placed).join(times.hint("merge"), ["source_no", "block"])  # both grow with the data


def mix(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target (the source's), taken (words the mix takes, repeats counted)."""
    sizes = document_sizes(docs)
    targets = store(source_targets(sizes, seed), "targets")
    placed = store(stream_positions(sizes, targets), "placed")
    taken = taken_blocks(placed, targets).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    rows = placed.join(taken, "rid", "left").join(targets.select("source_no", "source_size", "target"), "source_no")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42) -> DataFrame:
    """The mix as documents: a row for each pass over a document that takes some of it.

    A pass that takes all of a document keeps its text as it is; else the text is the taken words,
    joined by spaces, and ``n_chars``, where there is such a column, counts it anew.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("text").alias("text"))
    sizes = document_sizes(packed, "row")
    targets = store(source_targets(sizes.drop("row"), seed), "targets")
    placed = store(stream_positions(sizes.drop("row"), targets), "placed")
    parts = taken_blocks(placed, targets)
    parts = parts.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("first_word", "words", "times"))).alias("spans"), F.sum("words").alias("once"), F.sum(F.expr("if(times > 1, words, 0L)")).alias("twice")
    )
    passes = sizes.select("rid", "size", "row").join(parts.hint("merge"), "rid").withColumn("pass", F.explode(F.expr("if(twice > 0, array(1, 2), array(1))")))
    passes = passes.withColumn("spans", F.expr("filter(spans, s -> s.times >= pass)"))
    passes = passes.withColumn("whole", F.expr("if(pass = 1, once, twice) = size"))
    # the words are a lambda's argument, so that they are cut once a row and not once a span
    words = F.array(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)))

    def joined(found):
        return F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(found, s["first_word"].cast("int") + 1, s["words"].cast("int")))), " ")

    cut = F.get(F.transform(words, joined), F.lit(0))
    passes = passes.withColumn("new_text", F.when(F.col("whole"), F.col("row.text")).otherwise(cut))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("new_text").cast(docs.schema["n_chars"].dataType))
    return passes.select(*[e.alias(c) for c, e in out.items()])
