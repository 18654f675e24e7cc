"""Byte-pair encoding and decoding of word-end vocabularies by speculation.

The greedy longest match proposes a word's tokens.  A token sequence is the one that merging in
rank order gives exactly when each adjacent pair is, so all adjacent pairs are tested
together, and only words with a failing pair are merged step by step.
"""

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockscope.llm.common import utf8

# The byte-to-character table, the white space and the word pattern of such vocabularies.
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"
#: the same for lower-cased text of printable ASCII
PLAIN_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ a-z0-9]+"

#: Distinct pieces of text whose tokens a task remembers at most before it starts anew, and bytes of such a piece.
REMEMBERED = 250_000
PIECE_BYTES = 64
#: Bytes of text whose pieces are encoded together; a worker's memory grows with them.
SLICE_BYTES = 1 << 20
NEVER = np.int64(1) << 60
#: Symbols in the table of words that are merged together.
CELLS = 1 << 20
#: Words of more symbols are merged one by one.
LONG = 512
#: Symbols by whose first ones the length of a longest match is bounded.
HEAD = 4
#: Texts put together from their pieces at once.
TOGETHER = 64
ID_BYTES = np.dtype(np.intc).itemsize
BLANK = pa.scalar(b" ", pa.large_binary())


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    table, more = [""] * 256, 256
    for b in range(256):
        if b in PLAIN_BYTES:
            table[b] = chr(b)
        else:
            table[b], more = chr(more), more + 1
    return table


class WordBpe:
    """A vocabulary file of merges over bytes whose last one in a word carries an end mark."""

    def __init__(self, data: str):
        file = json.loads(data)
        model = file["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        #: decimal id and text by token
        ids = range(max(self.names) + 1)
        self.decimal = pa.array([str(i).encode() for i in ids], pa.large_binary())
        self.text = pa.array([self.names.get(i, "").encode() for i in ids], pa.large_binary())
        self.longest = max(map(len, self.vocab))
        #: most symbols of a token, by its first ``HEAD`` symbols; only shorter ones begin otherwise
        self.reach: dict[str, int] = {}
        for t in self.vocab:
            if len(t) >= HEAD:
                self.reach[t[:HEAD]] = max(len(t), self.reach.get(t[:HEAD], 0))
        self.bytes = dict(enumerate(byte_characters()))
        self.word, self.plain_word = regex.compile(WORD), re.compile(PLAIN_WORD)
        self.white = regex.compile(f"[{WHITE}]+")
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.marks = regex.compile(f"({marks})") if marks else None
        #: first characters of special strings; a text without them holds none
        self.first = {t[0].encode() for t in self.special}
        size = len(self.names) + 1
        self.size = size
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        #: rank of the merge of two tokens, and what it gives
        self.merges = {(a, b): (rank, made) for rank, (a, b, made) in reversed([*enumerate(pairs)])}
        keys = np.array([a * size + b for a, b in self.merges], dtype=np.int64)
        ranks = np.array([rank for rank, _ in self.merges.values()], dtype=np.int64)
        gives = np.array([made for _, made in self.merges.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.gives = keys[order], ranks[order], gives[order]
        #: rank of the merge that makes a token and its two sides; single symbols have rank -1
        self.made = np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), (rank, made) in self.merges.items():
            if self.made[made] < 0:
                self.made[made], self.left[made], self.right[made] = rank, a, b

    def merge_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the merge of each two tokens, ``NEVER`` if there is none, and the token it gives."""
        key = a * self.size + b
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], NEVER), self.gives[place]

    # --- words to tokens -----------------------------------------------------------------------
    def greedy(self, symbols: str) -> list[int] | None:
        """Longest matches from the left over a word's symbols, the last with its end mark."""
        vocab, reach, out, at, n = self.vocab, self.reach, [], 0, len(symbols)
        while at < n:
            if n - at <= self.longest and (found := vocab.get(symbols[at:] + self.end)) is not None:
                out.append(found)
                return out
            to = min(n - 1, at + reach.get(symbols[at : at + HEAD], HEAD - 1))
            while to > at and (found := vocab.get(symbols[at:to])) is None:
                to -= 1
            if to == at:
                return None
            out.append(found)
            at = to
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of two tokens together gives just these two, for all pairs at once.

        Going back in time, the token formed last at the border is taken apart.  A merge
        over the border spoils the pair if it comes before the side's own merge; of equal
        merges the leftmost comes first.
        """
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), dtype=bool)
        limit = np.full(len(a), NEVER)  # twice a rank, and one more where an equal rank is earlier
        active = np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            rank, _ = self.merge_of(x, y)
            spoilt = 2 * rank < limit[active]
            good[active[spoilt]] = False
            left, right = self.made[x], self.made[y]
            go = ~spoilt & ((left >= 0) | (right >= 0))
            undo_left = go & (left > right)
            undo_right = go & ~undo_left
            some = active[undo_left]
            a[some], limit[some] = self.right[x[undo_left]], 2 * left[undo_left]
            some = active[undo_right]
            b[some], limit[some] = self.left[y[undo_right]], 2 * right[undo_right] + 1
            active = active[go]
        return good

    def symbols(self, word: str) -> list[int]:
        """A word's single symbols; those that the vocabulary lacks are left out."""
        get = self.vocab.get
        ids = [*map(get, word[:-1]), get(word[-1] + self.end)]
        return ids if None not in ids else [i for i in ids if i is not None]

    def merged(self, words: list[list[int]]) -> list[list[int]]:
        """Exact merging of words of equally many symbols, all at once: least rank first, leftmost
        among equals."""
        ids = np.array(words, dtype=np.int64)
        out: list[list[int]] = [[]] * len(words)
        owner = np.arange(len(words))
        ranks, made = self.merge_of(ids[:, :-1], ids[:, 1:])
        while len(owner):
            best = ranks.argmin(axis=1) if ids.shape[1] > 1 else np.zeros(len(owner), dtype=np.int64)
            rows = np.arange(len(owner))
            go = ranks[rows, best] < NEVER if ids.shape[1] > 1 else np.zeros(len(owner), dtype=bool)
            for at, tokens in zip(owner[~go], ids[~go].tolist()):
                out[at] = tokens
            owner, ids, ranks, made, best = owner[go], ids[go], ranks[go], made[go], best[go]
            if not len(owner):
                break
            rows = np.arange(len(owner))
            ids[rows, best] = made[rows, best]
            # the token after the merged one and the pair at its place go
            kept = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.take_along_axis(ids, kept + (kept > best[:, None]), axis=1)
            kept = kept[:, :-1]
            shift = kept + (kept >= best[:, None])
            ranks, made = np.take_along_axis(ranks, shift, axis=1), np.take_along_axis(made, shift, axis=1)
            for pair in (best - 1, best):  # the two pairs the merged token is in
                some = np.flatnonzero((pair >= 0) & (pair < ranks.shape[1]))
                at = pair[some]
                ranks[some, at], made[some, at] = self.merge_of(ids[some, at], ids[some, at + 1])
        return out

    def merged_long(self, ids: list[int]) -> list[int]:
        """As ``merged`` for one word of any length: the pairs wait in a heap by rank and then place."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        ids = [*ids]
        waiting = []
        for at, pair in enumerate(zip(ids, ids[1:])):
            if (found := merges.get(pair)) is not None:
                waiting.append(found[0] * n + at)
        heapify(waiting)
        while waiting:
            rank, at = divmod(heappop(waiting), n)
            to = after[at]
            found = merges.get((ids[at], ids[to])) if to >= 0 and ids[at] >= 0 else None
            if found is None or found[0] != rank:
                continue  # one of the two has been merged since
            ids[at], ids[to] = found[1], -1
            after[at] = after[to]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (found := merges.get((ids[left], ids[right]))) is not None:
                    heappush(waiting, found[0] * n + left)
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word, given as its byte characters."""
        proposed = [self.greedy(w) for w in words]
        flat = np.array([t for p in proposed if p for t in p], dtype=np.int64)
        lengths = np.array([len(p) if p else 0 for p in proposed], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        keys, place = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[place]
        failed = np.zeros(len(words), dtype=bool)
        failed[owner[inside[~good]]] = True
        by_length: dict[int, list[int]] = {}
        for at in np.flatnonzero(failed | (lengths == 0)).tolist():
            proposed[at] = self.symbols(words[at])
            by_length.setdefault(len(proposed[at]), []).append(at)
        for length, places in by_length.items():
            if length > LONG:
                for place in places:
                    proposed[place] = self.merged_long(proposed[place])
                continue
            step = max(1, CELLS // length) if length > 1 else 0
            for at in range(0, len(places), step) if step else ():
                some = places[at : at + step]
                for place, ids in zip(some, self.merged([proposed[k] for k in some])):
                    proposed[place] = ids
        return proposed

    # --- texts to tokens -----------------------------------------------------------------------
    def words(self, piece: bytes) -> list[str | int]:
        """Words of a text as byte characters, and the ids of special strings among them."""
        if piece.isalpha():  # ASCII letters alone
            return [piece.decode().lower()]
        text = piece.decode("utf-8", "replace")
        out: list[str | int] = []
        marked = any(c in piece for c in self.first)
        for part in self.marks.split(text) if marked else [text]:
            if marked and part in self.special:
                out.append(self.special[part])
            elif part.isascii() and part.isprintable():
                out += self.plain_word.findall(part.lower())
            else:
                part = self.white.sub(" ", unicodedata.normalize("NFC", part))
                # each character is lowered by itself, so a capital sigma never becomes a final one
                part = part.replace("\u03a3", "\u03c3").lower()
                found = self.word.findall(part)
                out += [w.encode().decode("latin-1").translate(self.bytes) for w in found]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        split = [self.words(p) for p in pieces]
        distinct = list(dict.fromkeys(w for words in split for w in words if isinstance(w, str)))
        known = dict(zip(distinct, self.encode_words(distinct)))
        known.update((i, [i]) for i in self.special.values())
        return [
            known[words[0]] if len(words) == 1 else [t for w in words for t in known[w]]
            for words in split
        ]

    def decoded(self, ids: list[int]) -> str:
        """Without a decoder of its own such a file joins the tokens by blanks; special ones stay."""
        return " ".join([self.names[i] for i in ids])

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The ids of many texts in decimal; a text's ids lie between two neighbouring ``bounds``."""
        return pc.binary_join(pa.LargeListArray.from_arrays(bounds, self.decimal.take(pa.array(ids))), BLANK)

    def decoded_texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """As ``decoded`` for many texts."""
        return pc.binary_join(pa.LargeListArray.from_arrays(bounds, self.text.take(pa.array(ids))), BLANK)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for reference cycles, of which the many lists of a slice have none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def encode_texts(bpe: WordBpe, texts: list[bytes | None], known: dict) -> Iterator[tuple[int, bytes, bytes]]:
    """(tokens, decimal ids, decoded text) per text; ``known`` holds the packed ids of pieces already encoded.

    ASCII white space never lies inside a token, a special string or a composed
    character, so the pieces between it are encoded by themselves, each distinct one once.
    """
    whole = pa.array([t or b"" for t in texts], pa.large_binary()).cast(pa.large_string(), safe=False)
    split = pc.ascii_split_whitespace(whole)
    pieces = split.flatten().dictionary_encode()
    distinct = pieces.dictionary.cast(pa.large_binary()).to_pylist()
    new = [p for p in distinct if p not in known]
    with uncollected():
        known.update((p, array("i", ids).tobytes()) for p, ids in zip(new, bpe.encode_pieces(new)))
    packed = [known[p] for p in distinct]
    for piece in new:
        if len(piece) > PIECE_BYTES:
            del known[piece]
    lengths = np.array([*map(len, packed)], dtype=np.int64) // ID_BYTES
    starts = np.cumsum(lengths) - lengths
    tokens = np.frombuffer(b"".join(packed), dtype=np.intc)
    place, offsets = pieces.indices.to_numpy(), split.offsets.to_numpy()
    del whole, split, pieces, distinct, new, packed
    for low in range(0, len(texts), TOGETHER):
        cut = offsets[low : low + TOGETHER + 1]
        some = place[cut[0] : cut[-1]]
        n = lengths[some]
        bounds = np.concatenate([[0], np.cumsum(n)])
        # a piece's tokens follow those of the pieces before it
        ids = tokens[np.repeat(starts[some] - bounds[:-1], n) + np.arange(bounds[-1])]
        bounds = bounds[cut - cut[0]]
        for found in zip(np.diff(bounds).tolist(), bpe.written(ids, bounds), bpe.decoded_texts(ids, bounds)):
            yield found[0], found[1].as_py(), found[2].as_py()


def shared(vocabulary: str) -> Broadcast:
    """A vocabulary file's content, a few MB that go to each worker once; see ``_parsed``."""
    return SparkSession.active().sparkContext.broadcast({"file": vocabulary})


def _parsed(sent: dict) -> WordBpe:
    """The tables of the content sent; a worker keeps them beside it for its later tasks."""
    if "bpe" not in sent:
        sent["bpe"] = WordBpe(sent["file"])
    return sent["bpe"]


def tokens_of(text: Column, vocabulary: str) -> Column:
    """Struct of ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` for UTF-8 bytes; null is empty.

    ``vocabulary`` is the content of the vocabulary file, which is sent with the job.  Memory
    is bounded by ``SLICE_BYTES``, or the longest text, and ``REMEMBERED`` pieces.
    """
    sent = shared(vocabulary)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pa.default_memory_pool().release_unused()  # what earlier tasks of the worker left
        bpe, known = _parsed(sent.value), {}
        for texts in batches:
            rows, held, size = [], [], 0
            for k, text in enumerate(texts):
                held.append(text)
                size += len(text or b"")
                if size >= SLICE_BYTES or k + 1 == len(texts):
                    if len(known) > REMEMBERED:
                        known = {}
                    rows += [
                        (n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(out).hexdigest())
                        for n, ids, out in encode_texts(bpe, held, known)
                    ]
                    held, size = [], 0
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def ids_of(text: Column, vocabulary: str) -> Column:
    """The token ids of UTF-8 bytes, as an array; null is empty."""

    sent = shared(vocabulary)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _parsed(sent.value)
        for texts in batches:
            pieces = [bpe.encode_pieces([(t or b"")])[0] for t in texts]
            yield pd.Series(pieces)

    return run(text)


def decoded_of(ids: Column, vocabulary: str) -> Column:
    """The text that token ids decode to; null is empty, ids out of the vocabulary are left out."""

    sent = shared(vocabulary)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _parsed(sent.value)
        for each in batches:
            rows = [[] if i is None else [t for t in i if t in bpe.names] for i in each]
            yield pd.Series([bpe.decoded(r) for r in rows])

    return run(ids)


def read_vocabulary(path: str) -> str:
    """A vocabulary file of a few MB, read on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Whole texts; null and empty texts have no token, whose digests are those of nothing.
    """
    found = docs.select(F.col(id_col), tokens_of(utf8(text_col), vocabulary).alias("found"))
    return found.select(id_col, "found.*")
