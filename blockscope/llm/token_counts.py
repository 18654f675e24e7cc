"""Token counts from pre-token counts: pieces are counted once per distinct pre-token.

Documents are cut into blocks.  A block's pre-tokens that are one token of the vocabulary are
counted where they are; the others go, with the documents that hold them and how often, to the
task of their bucket, which counts each distinct pre-token once and sends every document's
sum back to its block.  No token id is ever made into a row.
"""

import json
import os
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockscope.llm.common import utf8

# The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: UTF-8 bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Distinct pre-tokens a task remembers before it starts anew.
REMEMBERED = 200_000
#: Buckets at least; more shuffle partitions have as many, and there is one for so many bytes of text.
LEAST_BUCKETS = 32
BUCKET_BYTES = 32 << 20


class PieceCounter:
    """Pieces of single pre-tokens by a byte-level vocabulary file."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        file = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t["content"] for t in file["added_tokens"]]
        self.known: dict[str, int] = {}

    def counts(self, pre_tokens: list[str]) -> np.ndarray:
        new = [p for p in pre_tokens if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, pre_tokens
        found = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update(zip(new, map(len, found)))
        return np.array([self.known[p] for p in pre_tokens], dtype=np.int64)


def single_pieces(vocabulary: str) -> set[str]:
    """The pre-tokens that are one piece: a table as large as the vocabulary, whatever the corpus."""
    counter = PieceCounter(vocabulary)
    whole = [t for t in counter.tokenizer.get_vocab() if t not in counter.special]
    texts = [counter.tokenizer.decode([counter.tokenizer.token_to_id(t)]) for t in whole]
    pattern = regex.compile(PRE_TOKEN)
    texts = list({t for t in texts if "�" not in t and pattern.fullmatch(t)})
    found = counter.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return {t for t, f in zip(texts, found) if len(f) == 1}


# --- blocks ------------------------------------------------------------------------------------
def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, each array in the narrowest type that holds it."""
    out = b""
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max(initial=0))))
        out += struct.pack("<BQ", a.itemsize, len(a)) + a.tobytes()
    return zlib.compress(out, 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, at, out = zlib.decompress(data), 0, []
    while at < len(data):
        width, n = struct.unpack_from("<BQ", data, at)
        out.append(np.frombuffer(data, f"<u{width}", n, at + 9).astype(np.int64))
        at += 9 + width * n
    return out


class Block:
    """Documents of which some pre-tokens are counted and the others wait for their buckets."""

    def __init__(self, single: set[str], special: list[str]):
        self.single = single
        marks = "|".join(regex.escape(t) for t in special)
        self.marks = regex.compile(marks) if marks else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.sums = [], [], []
        self.words: dict[str, int] = {}
        self.word, self.often, self.held = [], [], []
        self.bytes = 0

    def add(self, doc_id, data: bytes | None) -> None:
        text = (data or b"").decode("utf-8", "replace")
        parts = self.marks.split(text) if self.marks else [text]
        counted = Counter(p for part in parts for p in self.pattern.findall(part))
        total, before, words, single = len(parts) - 1, len(self.word), self.words, self.single
        for p, n in counted.items():
            if p in single:
                total += n
            else:
                self.word.append(words.setdefault(p, len(words)))
                self.often.append(n)
        self.held.append(len(self.word) - before)
        self.ids.append(doc_id)
        self.sizes.append(len(data or b""))
        self.sums.append(total)
        self.bytes += len(data or b"")

    def rows(self, block: int, buckets: int) -> Iterator[dict]:
        """The block's own row, and one for each bucket that has some of its pre-tokens."""
        yield {"bucket": -1, "block": block, "ids": self.ids, "sizes": self.sizes, "sums": self.sums}
        texts = [w.encode("utf-8", "surrogatepass") for w in self.words]
        bucket = np.array([zlib.crc32(t) % buckets for t in texts], dtype=np.int64)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        by_bucket = sorted(range(len(texts)), key=lambda k: (bucket[k], texts[k]))
        rank = np.empty(len(texts), dtype=np.int64)
        rank[by_bucket] = np.arange(len(texts))
        owner = np.repeat(np.arange(len(self.held)), self.held)
        word = rank[np.array(self.word, dtype=np.int64)]
        order = np.argsort(word, kind="stable")
        word, owner, often = word[order], owner[order], np.array(self.often, dtype=np.int64)[order]
        ends = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(ends)).tolist():
            low, high = ends[b], ends[b + 1]
            mine = by_bucket[low:high]
            at, to = np.searchsorted(word, [low, high])
            yield {
                "bucket": b,
                "block": block,
                "words": zlib.compress(b"".join([texts[k] for k in mine]), 1),
                "postings": _packed(
                    lengths[mine], np.bincount(word[at:to] - low, minlength=high - low), owner[at:to], often[at:to]
                ),
            }


def document_sums(row: dict, counter: PieceCounter) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents in their block, and the pieces of a bucket's pre-tokens in each."""
    lengths, held, owner, often = _unpacked(row["postings"])
    word = np.repeat(np.arange(len(lengths)), held)
    data, ends = zlib.decompress(row["words"]), np.cumsum(lengths).tolist()
    words = [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip([0, *ends], ends)]
    sums = np.bincount(owner, weights=often * counter.counts(words)[word]).astype(np.int64)
    places = np.flatnonzero(sums)
    return places, sums[places]


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row: id, ``n_bytes`` (UTF-8), ``n_tokens``.

    ``vocabulary`` is the content of a byte-level vocabulary file.  Special strings count
    as one token each.  Null and empty texts have none; repeated rows and ids are counted by
    themselves.  A pre-token that very many documents hold still reaches its bucket once per
    block.  An empty table gives no rows.
    """
    single = docs.sparkSession.sparkContext.broadcast(single_pieces(vocabulary))  # at most the vocabulary
    special = [t["content"] for t in json.loads(vocabulary)["added_tokens"]]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, partitions, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cut_kind = (
        "bucket int, block long, words binary, postings binary, "
        f"ids array<{kind}>, sizes array<long>, sums array<long>"
    )
    sent_kind = f"block long, ids array<{kind}>, sizes array<long>, places array<long>, sums array<long>"

    def as_batch(found: list[dict], names: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(found, schema=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, n, names = Block(single.value, special), 0, None
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            names = pa.schema(
                [
                    ("bucket", pa.int32()), ("block", pa.int64()), ("words", pa.binary()),
                    ("postings", pa.binary()), ("ids", pa.list_(batch.schema.field(0).type)),
                    ("sizes", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
                ]
            )
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                block.add(doc_id.as_py(), text.as_py())
                if block.bytes >= BLOCK_BYTES:
                    yield as_batch([*block.rows(first + n, buckets)], names)
                    block.clear()
                    n += 1
        if block.ids:
            yield as_batch([*block.rows(first + n, buckets)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(vocabulary)
        for batch in batches:
            names = pa.schema(
                [
                    ("block", pa.int64()), ("ids", batch.schema.field("ids").type),
                    ("sizes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())),
                    ("sums", pa.list_(pa.int64())),
                ]
            )
            out = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["bucket"] < 0:
                    out.append({k: row[k] for k in ("block", "ids", "sizes", "sums")})
                else:
                    places, sums = document_sums(row, counter)
                    out.append({"block": row["block"], "places": places, "sums": sums})
            yield as_batch(out, names)

    def add(rows: pa.Table) -> pa.Table:
        mine = rows.filter(pc.is_valid(rows.column("ids"))).slice(0, 1)
        ids, sizes = (mine.column(c).combine_chunks().flatten() for c in ("ids", "sizes"))
        total = mine.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()
        sent = rows.filter(pc.is_valid(rows.column("places")))
        places, sums = (
            sent.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for c in ("places", "sums")
        )
        total += np.bincount(places, weights=sums, minlength=len(total)).astype(np.int64)
        return pa.table({id_col: ids, "n_bytes": sizes, "n_tokens": pa.array(total)})

    spread = F.when(F.col("bucket") < 0, F.col("block")).otherwise(F.col("bucket"))
    cut_up = rows.mapInArrow(cut, cut_kind).repartition(max(partitions, buckets // 2), spread)
    counted = cut_up.mapInArrow(count, sent_kind)
    return counted.groupBy("block").applyInArrow(add, f"{id_col} {kind}, n_bytes long, n_tokens long")
