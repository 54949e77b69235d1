"""Encoding of texts with a public tokenizer."""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from difflode.llm.classes import mix

#: Where the vocabulary files are; a parameter everywhere.
TOKENIZER_DIR = "/opt/tokenizers"
#: Code points handled in one go, and pieces kept in a worker's cache.
BLOCK_CHARS, CACHED_PIECES = 1_000_000, 300_000
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The endings that follow an apostrophe as a piece of their own, and the white space of Unicode.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    of = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    return table


def piece_starts(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of many concatenated texts start, found without a regular expression.

    A run of one class is a piece, with one blank before it if there is one; white space
    before other text gives its last character away (to the piece that follows if it is a
    blank, else as a piece of its own); an apostrophe that begins a piece takes a
    contraction's ending along. Whether white space reaches the end of its text is found
    by a scan from the right that composes "keep" and "reset" functions, which is
    associative; all other decisions look at neighbours only.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[doc_starts[doc_starts < n]] = True
    first[n] = True
    space = kind == SPACE
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    # the next start of a run or text, from the right: the end of each run
    at = np.where(np.append(change[1:], True), np.arange(1, n + 1), n + 1)
    run_end = np.minimum.accumulate(at[::-1])[::-1]
    to_the_end = first[run_end]
    start = change.copy()
    last = space & (run_end == np.arange(1, n + 1)) & ~to_the_end
    start |= last
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (codes[:-1] == 32) & ~first[1:n]
    start &= ~(change & ~space & blank_before)
    quote = np.flatnonzero(start & (codes == 39))
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        doc_end = np.append(np.sort(doc_starts), n)
        stop = doc_end[np.searchsorted(doc_end, quote, side="right")]
        for end in CONTRACTIONS:
            ok = quote + len(end) < stop
            for k, c in enumerate(end, 1):
                ok &= padded[quote + k] == ord(c)
            hit = quote[ok]
            start[hit + 1] = False
            after = hit + len(end) + 1
            start[after[after < n]] = True
            quote, stop = quote[~ok], stop[~ok]
    return np.flatnonzero(start)


class PairMerger:
    """Merges the bytes of a piece by rank: the pair of least rank first, the leftmost of equals."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __call__(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))
        prev = list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not live[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue
            live[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


class Encoder:
    """Texts to ids: pieces of a block are told apart by hash, checked against their first instance, and merged once each."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merge = PairMerger(ranks)
        self.cache: dict[str, list[int]] = {}

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, ids per text, starts of pieces within their text, ids per piece, pieces per text)``."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        n = len(codes)
        doc_starts = np.concatenate([[0], np.cumsum(sizes)])
        starts = piece_starts(codes, doc_starts[:-1][sizes > 0])
        ends = np.append(starts[1:], n)
        if not n:
            zero = np.zeros(len(texts), np.int64)
            return np.zeros(0, np.int32), zero, starts, starts, zero
        power = np.full(n, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(codes.view(np.uint64) + np.uint64(11)) * power)])
        inverse = np.full(n, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        length = ends - starts
        h = mix((total[ends] - total[starts]) * inverse[starts] ^ length.astype(np.uint64))
        _, one, back = np.unique(h, return_index=True, return_inverse=True)
        rep = starts[one][back]
        shift = np.repeat(rep - starts, length)
        if not (length == length[one][back]).all() or not (codes == codes[np.arange(n) + shift]).all():
            one, back = np.arange(len(starts)), np.arange(len(starts))
        cache, merge = self.cache, self.merge
        if len(cache) > CACHED_PIECES:
            cache.clear()
        lists = []
        for s, e in zip(starts[one].tolist(), ends[one].tolist()):
            piece = joined[s:e]
            ids = cache.get(piece)
            if ids is None:
                ids = cache[piece] = merge(piece.encode())
            lists.append(ids)
        width = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for ids in lists for i in ids), np.int32, int(width.sum()))
        begin = np.concatenate([[0], np.cumsum(width)])[:-1]
        per = width[back]
        out_at = np.concatenate([[0], np.cumsum(per)])
        ids = flat[np.arange(out_at[-1]) + np.repeat(begin[back] - out_at[:-1], per)]
        doc = np.searchsorted(doc_starts, starts, side="right") - 1
        per_text = np.bincount(doc, weights=per, minlength=len(texts)).astype(np.int64)
        return ids, per_text, starts - doc_starts[doc], per, np.bincount(doc, minlength=len(texts))


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: one token in base 64 and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``BLOCK_CHARS`` code points, or of one text."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > BLOCK_CHARS:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", offsets: bool = False, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key, ids`` for every row, and with ``offsets`` the start of each pre-token and its number of ids.

    Null and empty texts give empty lists. Strings that look like special tokens are
    ordinary text. The vocabulary is read once by the driver and broadcast (its size is
    that of a rank file, about a megabyte). Texts are encoded whole; repeated rows give
    repeated rows.
    """
    spark: SparkSession = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(os.path.join(tokenizer_dir, f"{tokenizer}.tiktoken")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for a, b in blocks(texts):
                ids, per_text, starts, per, pieces = enc.block(texts[a:b])
                cols = [batch.column(key).slice(a, b - a), _lists(ids, per_text)]
                if offsets:
                    cols += [_lists(starts, pieces), _lists(per, pieces)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "starts", "sizes"][: len(cols)])

    kind = docs.schema[key].dataType.simpleString()
    more = ", starts array<int>, sizes array<int>" if offsets else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>{more}")


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids, by the inverse of the vocabulary."""
    back = {r: b for b, r in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", errors="replace")


def count_tokens(docs: DataFrame, key: str, text: str, tokenizers: list[str], tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and for each tokenizer ``n_<name>`` and ``loss_<name>``: tokens of the text, and of what follows its first line.

    Rank files are encoded with the operator above, ``.model`` files by their own library.
    Null and empty texts have no tokens.
    """
    spark = docs.sparkSession
    ranks = {t: spark.sparkContext.broadcast(read_ranks(p)) for t in tokenizers if os.path.exists(p := os.path.join(tokenizer_dir, f"{t}.tiktoken"))}
    models = {}
    for t in tokenizers:
        if t not in ranks:
            with open(os.path.join(tokenizer_dir, f"{t}.model"), "rb") as f:
                models[t] = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {t: Encoder(r.value) for t, r in ranks.items()}
        if models:
            import sentencepiece

            pieces = {t: sentencepiece.SentencePieceProcessor(model_proto=m.value) for t, m in models.items()}
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            heads = [t.partition("\n")[0] + "\n" if "\n" in t else t for t in texts]
            cols, names = [batch.column(key)], [key]
            for t in tokenizers:
                for kind, what in (("n", texts), ("h", heads)):
                    if t in encoders:
                        got = np.concatenate([encoders[t].block(what[a:b])[1] for a, b in blocks(what)] or [np.zeros(0, np.int64)])
                    else:
                        got = np.fromiter((len(x) for a in range(0, len(what), 256) for x in pieces[t].encode(what[a : a + 256], num_threads=1)), np.int64, len(what))
                    if kind == "n":
                        n = got
                    else:
                        cols += [pa.array(n), pa.array(np.maximum(n - got, 0))]
                        names += [f"n_{t}", f"loss_{t}"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, ", ".join([f"`{key}` {kind}", *[f"n_{t} long, loss_{t} long" for t in tokenizers]]))
