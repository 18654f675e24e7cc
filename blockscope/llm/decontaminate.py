"""Benchmark decontamination with DataFrame functions only.

Windows of each item's size are cut from the documents, SimHashed, and looked up among the
items' fingerprints through Hamming blocks that miss none within the radius; candidates are
then compared exactly by their weighted word shingles.

Only windows that can pass are cut.  Two texts of n shingles that are ``similarity`` alike share
at least 2 s / (1 + s) of them, so of any larger remainder of an item's shingles (its anchors,
spread over the item) at least one is in every such window.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import stored, without_ids

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Replacing as much of an item as the similarity allows turns ten bits on average, with a deviation of three.
RADIUS = 23
BLOCKS = 6
BITS = 64
#: Anchor rows broadcast at most; beyond that they are joined by a shuffle.
MOST_ANCHORS = 500_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, lower case, as an array; null text has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(parts, "")


def _shingle_key(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def _shingles(words: str, length: Column, *carried: str):
    """Row per shingle: its words joined by blanks."""
    last = F.size(words) - length
    each = F.transform(
        F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
        lambda at: F.concat_ws(" ", F.slice(F.col(words), at + 1, length)),
    )
    return [*carried, F.explode(each).alias("shingle")]


def items_of(benchmark: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(item, words, size, length): distinct items with a word; ``length`` is their shingle length."""
    words = benchmark.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    size = F.size("words")
    return words.where(size > 0).distinct().select(
        "item", "words", size.alias("size"), F.least(size, F.lit(shingle)).alias("length")
    )


def anchors_of(items: DataFrame, similarity: float) -> DataFrame:
    """(length, key, offset, size): enough shingles per item that a similar window holds one."""
    n = F.col("size") - F.col("length") + 1
    # shared >= 2 s / (1 + s) * n, so n - shared + 1 shingles cannot all be missing
    spare = F.floor(n * ((1 - similarity) / (1 + similarity)) + F.lit(1e-9)).cast("int") + 1
    count = F.least(n, spare)
    offset = F.floor(F.col("k") * n / count).cast("int")
    rows = items.select(
        "words", "size", "length", n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("k")
    ).withColumn("offset", offset)
    lengths = sorted(r.length for r in items.select("length").distinct().collect())  # one to ``shingle``
    keyed = [
        rows.where(F.col("length") == length).select(
            "length", _shingle_key(F.col("words"), F.col("offset"), length).alias("key"), "offset", "size"
        )
        for length in lengths
    ]
    return reduce(DataFrame.union, keyed).distinct() if keyed else None


def _keyed(words: DataFrame, lengths: list[int], *carried: str) -> DataFrame:
    """Row per place and shingle length: what is carried, ``n`` (words), ``at``, ``length``, ``key``.

    The words are read once for all lengths; a shingle that would leave the document is no row.
    """
    n = F.size("words")
    least = lengths[0]
    at = words.where(n >= least).select(
        *words.columns, n.alias("n"), F.explode(F.sequence(F.lit(0), n - least)).alias("at")
    )
    each = [
        F.struct(F.lit(k).alias("length"), _shingle_key(F.col("words"), F.col("at"), k).alias("key")) for k in lengths
    ]
    if len(lengths) == 1:
        return at.select(*carried, "n", "at", each[0].alias("shingle")).select(*carried, "n", "at", "shingle.*")
    rows = at.select(*carried, "n", "at", F.inline(F.array(*each)))
    return rows.where(F.col("at") + F.col("length") <= F.col("n"))


def windows_of(
    docs: DataFrame,
    anchors: DataFrame,
    lengths: list[int],
    id_col: str,
    text_col: str,
    most_anchors: int = MOST_ANCHORS,
) -> DataFrame:
    """(doc, start, size, window): item-sized windows around the anchors a document holds.

    A window that would leave the document is moved inside it; a shorter document is one window.
    ``lengths`` are ascending.  Up to ``most_anchors`` anchors go to the words; beyond that the shingles
    are shuffled without them, and only rows with a hit are met with their words again.
    """
    words = docs.select(F.col(id_col).alias("doc"), words_of(F.col(text_col)).alias("words"))
    few = anchors.limit(most_anchors + 1).count() <= most_anchors
    if few:
        anchors, carried = F.broadcast(anchors), ["doc", "words"]
    else:
        # a number that is written with the words, as ids may be null or repeated
        words = stored(words.withColumn("row", F.monotonically_increasing_id()), "words")
        carried = ["row"]
    hits = _keyed(words, lengths, *carried).join(anchors, ["length", "key"])
    inside = F.least(F.col("at") - F.col("offset"), F.col("n") - F.col("size"))
    hits = hits.select(*carried, F.greatest(F.lit(0), inside).alias("start"), "size")
    if not few:
        hits = hits.distinct().join(words, "row")
    window = F.concat_ws(" ", F.slice("words", F.col("start") + 1, F.col("size")))
    return hits.select("doc", "start", "size", window.alias("window")).distinct()


def simhash(texts: DataFrame, words: str, *keys: str) -> DataFrame:
    """(keys, fingerprint): bits set in more than half of the words' hashes, repeats counted.

    Two 32-bit lanes of a long count two bits at a time.
    """
    lanes = F.lit(0x0000000100000001)
    each = texts.select(*keys, F.explode(words).alias("word")).select(
        *keys, F.xxhash64("word").alias("h")
    )
    sums = [
        F.sum(F.shiftrightunsigned("h", s).bitwiseAND(lanes)).alias(f"s{s}") for s in range(BITS // 2)
    ]
    counted = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    bits = []
    for s in range(BITS // 2):
        low = F.col(f"s{s}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{s}", BITS // 2)
        bits.append(F.when(2 * low > F.col("n"), F.lit(1 << s)).otherwise(F.lit(0)))
        top = 1 << (s + 32) if s < 31 else -(1 << 63)
        bits.append(F.when(2 * high > F.col("n"), F.lit(top)).otherwise(F.lit(0)))
    set_bits = reduce(lambda a, b: a.bitwiseOR(b), [b.cast("long") for b in bits])
    return counted.select(*keys, set_bits.alias("fingerprint"))


def _block_values(blocks: int) -> Column:
    """The fingerprint's blocks, as an array of longs."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    return F.array(
        *[
            F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << (high - low)) - 1))
            for low, high in zip(edges, edges[1:])
        ]
    )


def _flips(width: int, most: int) -> list[int]:
    return [x for x in range(1 << width) if x.bit_count() <= most]


def within_radius(windows: DataFrame, items: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(window, size, item): all pairs of one size whose fingerprints differ in ``radius`` bits or fewer.

    Such a pair differs in at most radius / blocks bits of some block; the items are listed
    under every value of each block that is so near their own.
    """
    near = radius // blocks
    widest = -(-BITS // blocks)
    flips = F.array(*[F.lit(x).cast("long") for x in _flips(widest, near)])
    index = items.select("item", "size", "fingerprint", F.posexplode(_block_values(blocks)).alias("block", "own"))
    index = index.select(
        "item", "size", "block", F.col("fingerprint").alias("theirs"), F.explode(flips).alias("flip"), "own"
    ).withColumn("value", F.col("own").bitwiseXOR(F.col("flip")))
    probes = windows.select("window", "size", "fingerprint", F.posexplode(_block_values(blocks)).alias("block", "value"))
    index = index.drop("own", "flip")
    differ = F.bit_count(F.col("p.fingerprint").bitwiseXOR(F.col("i.theirs")))
    same = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in ("size", "block", "value")]
    return (
        probes.alias("p")
        .join(index.alias("i"), reduce(lambda a, b: a & b, same) & (differ <= radius))
        .select("p.window", "p.size", "i.item")
        .distinct()
    )


def similarities(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(window, size, item, similarity): sum of the smaller over sum of the larger shingle counts."""
    both = pairs.join(items.select("item", "words", "length"), "item")
    keys = ("window", "size", "item")
    both = both.withColumn("mine", F.split("window", " "))
    # a window of fewer words than a shingle is one shingle
    own_length = F.least(F.col("length"), F.size("mine"))
    mine = both.select(*_shingles("mine", own_length, *keys)).withColumn("w", F.lit(1)).withColumn("i", F.lit(0))
    its = both.select(*_shingles("words", F.col("length"), *keys)).withColumn("w", F.lit(0)).withColumn("i", F.lit(1))
    counts = mine.union(its).groupBy(*keys, "shingle").agg(F.sum("w").alias("w"), F.sum("i").alias("i"))
    shared, total = F.sum(F.least("w", "i")), F.sum(F.greatest("w", "i"))
    return counts.groupBy(*keys).agg((shared / total).alias("similarity"))


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = SHINGLE_WORDS,
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(id, item, ``start_word``, ``similarity``): documents that hold a benchmark item, and where best.

    One row per document id and item, at its most similar aligned window, the first among equals.
    Words are runs of letters and digits, so case, punctuation and white space do not
    hide a copy.  Items of fewer words than a shingle are one shingle.  Null and empty
    texts and items match nothing; repeated rows count once; ids may be null.
    """
    items = stored(items_of(benchmark, item_col, item_text_col, shingle), "items")
    none = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {item_col} " \
        f"{benchmark.schema[item_col].dataType.simpleString()}, start_word int, similarity double"
    anchors = anchors_of(items, similarity)
    if anchors is None:
        return docs.sparkSession.createDataFrame([], none)
    anchors = stored(anchors, "anchors")
    lengths = sorted(r.length for r in anchors.select("length").distinct().collect())
    windows = stored(windows_of(docs, anchors, lengths, id_col, text_col), "windows")
    texts = windows.select("window", "size").distinct()
    texts = simhash(texts.withColumn("words", F.split("window", " ")), "words", "window", "size")
    prints = simhash(items, "words", "item", "size")
    pairs = within_radius(texts, prints, radius, blocks)
    alike = similarities(pairs, items).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    return (
        windows.join(alike, ["window", "size"])
        .groupBy("doc", "item")
        .agg(best)
        .select(
            F.col("doc").alias(id_col),
            F.col("item").alias(item_col),
            (-F.col("best.back")).alias("start_word"),
            F.col("best.similarity").alias("similarity"),
        )
    )


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    judge_null_ids: bool = False,
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows with a null id stay, or are judged by their text with ``judge_null_ids``.
    """
    if not judge_null_ids:
        found = stored(leaks(docs, benchmark, id_col, text_col), "leaks")
        return without_ids(docs, id_col, found.select(id_col))
    key = "_key"
    while key in docs.columns:
        key += "_"
    by_id = F.concat(F.lit("i"), F.col(id_col).cast("string"))
    by_text = F.concat(F.lit("t"), F.sha2(F.col(text_col).cast("binary"), 256))
    keyed = docs.withColumn(key, F.coalesce(by_id, by_text))
    found = stored(leaks(keyed, benchmark, key, text_col), "leaks")
    return without_ids(keyed, key, found.select(key)).drop(key)
