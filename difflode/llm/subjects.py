"""Subject areas of documents, from a few labelled ones."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from difflode.llm.classes import GOLD, mix, salt
from difflode.plans.lineage import cut, stored

#: Sentences or items of a document that must deal with an area, as the task defines it: the calibration counts up to thrice as many.
SENTENCES, MOST = 3, 9
#: Words in more documents of a language than this share carry no subject alone, nor in pairs beyond the second share; features in fewer documents than this are not weighed.
COMMON_SHARE, STOP_SHARE, LEAST_DOCS = 0.10, 0.35, 4
#: A feature speaks for an area if its log odds and the lower bound of its share of documents of the area are at least these.
ODDS, SHARE = 0.8, 0.30
#: From labels alone, a feature also speaks for an area that half of its documents have, if chance does not explain it (likelihood ratio, one in a thousand).
LABEL_SHARE, LABEL_RATIO = 0.5, 10.83
#: Rounds of expectation and maximisation after the one on labels, and parts of the labelled documents that are counted with the weights of the others.
ROUNDS, FOLDS = 3, 4
#: Posterior from which an area is reported.
SURE = 0.5
#: Labelled documents that the curve of all areas of a language counts for at each number of sentences, in the curve of one area; the curve of all languages likewise in that of one.
POOLED = 2.0
#: Deviations of the bounds (Wilson) for features and for contexts.
Z, Z_CONTEXT = 2.58, 1.64
#: A language is told apart if so large a share of the documents with a stated language have it; its marks are words of so large a share of them.
LANGUAGE_SHARE, MARK_SHARE = 0.02, 0.25
#: Characters and documents handled at a time by a task.
BLOCK_CHARS, BLOCK_DOCS = 1_000_000, 4096
#: Rows that a task adds up before it hands them on.
HELD_ROWS = 4_000_000
#: After the first round over all documents only features count on whose share of an area is at least this at one deviation.
ACTIVE = 0.12

FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)

OTHER, UPPER, LOWER, HAN = 0, 1, 2, 3
#: What ends a sentence before white space, what may stand between, what ends one at once, and white space.
STOPS, CLOSERS, FULL_STOPS = ".!?", "\"'”’)]", "。！？"
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What stands for a language where documents with Chinese characters are counted.
HAN_DOCS = "+han"
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = 0x10FFFF


def _class_table() -> np.ndarray:
    table = np.zeros(_LAST + 1, np.uint8)
    for a, b, kind in ((0x41, 0x5A, UPPER), (0xC0, 0xD6, UPPER), (0xD8, 0xDE, UPPER), (0x61, 0x7A, LOWER), (0xDF, 0xF6, LOWER), (0xF8, 0xFF, LOWER), (0x3400, 0x4DBF, HAN), (0x4E00, 0x9FFF, HAN)):
        table[a : b + 1] = kind
    return table


def _marks(chars: str) -> np.ndarray:
    table = np.zeros(_LAST + 1, bool)
    table[[ord(c) for c in chars]] = True
    return table


_CLASS = _class_table()
_STOP, _CLOSER, _FULL, _SPACE, _BREAK = (_marks(c) for c in (STOPS, CLOSERS, FULL_STOPS, SPACES, "\r\n"))
_SMALL = _marks("".join(chr(c) for c in [*range(0x61, 0x7B), *range(0xE0, 0x100)]))


def sentence_ends(flat: np.ndarray) -> np.ndarray:
    """Which characters end a sentence or list item; a text ends with code point 0.

    White space after a full stop (and closing marks), Chinese full stops, line breaks that
    no small letter follows, and empty lines.
    """
    n = len(flat)
    space, brk = _SPACE[flat], _BREAK[flat]
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where(_CLOSER[flat], -1, at))
    before = np.concatenate([[-1], solid[:-1]])
    new_space = space & ~np.concatenate([[False], space[:-1]])
    after_stop = new_space & (before >= 0) & _STOP[flat[np.maximum(before, 0)]]
    following = np.minimum.accumulate(np.where(space, n - 1, at)[::-1])[::-1]
    starts = brk & ~np.concatenate([[False], brk[:-1]])
    double = starts & np.concatenate([brk[1:], [False]])
    return (flat == 0) | _FULL[flat] | after_stop | double | (starts & ~_SMALL[flat[following]])


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n + 1, np.uint64(base & 0xFFFFFFFFFFFFFFFF), np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


@dataclass
class Parsed:
    """The words and features of some documents as flat arrays; places are character offsets in the joined text."""

    docs: int
    sentence_doc: np.ndarray
    chars: int
    #: words: hash, start, end, sentence, whether Chinese
    word: np.ndarray
    w_start: np.ndarray
    w_end: np.ndarray
    w_sentence: np.ndarray
    w_han: np.ndarray
    #: features: hash, start, end, sentence
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    f_start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    f_end: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    f_sentence: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: pairs of neighbouring Chinese characters and single ones: hash, start, sentence
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    p_start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    p_sentence: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    single: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    s_sentence: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def parse(texts: list[str | None]) -> Parsed:
    """Words of all sentences: lower case, identifiers taken apart, plain plurals cut, runs of Chinese characters; code blocks left out.

    Nothing runs by character or word: classes of code points tell where words begin and
    end, and a word's hash is a difference of running sums of a polynomial.
    """
    joined = "".join(FENCE.sub("\n\n", t.replace("\0", " ")) + "\0" if t else "\0" for t in texts) or "\0"
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = sentence_ends(flat)
    sentence = np.cumsum(ends) - ends
    owner = (np.cumsum(flat == 0) - (flat == 0))[ends]
    kind = _CLASS[flat]
    before, after = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
    begins = (kind != OTHER) & (
        (before == OTHER) | ((kind == HAN) != (before == HAN)) | ((kind == UPPER) & (before == LOWER)) | ((kind == UPPER) & (before == UPPER) & (after == LOWER))
    )
    start = np.flatnonzero(begins)
    closes = (kind != OTHER) & ((after == OTHER) | np.concatenate([begins[1:], [True]]))
    end = np.flatnonzero(closes) + 1
    n = len(flat)
    value = (flat + 32 * (kind == UPPER) + 1).astype(np.uint64)
    power = _powers(n, _BASE)
    inverse = _powers(n, pow(_BASE, -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:n], dtype=np.uint64)])

    def raw(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (total[b] - total[a]) * inverse[a]

    def named(h: np.ndarray, length: np.ndarray | int, kind: int) -> np.ndarray:
        return mix(h + np.asarray(length).astype(np.uint64) * GOLD + salt(kind))

    han = kind[start] == HAN
    size = end - start
    low = value - np.uint64(1)
    last, second, third = low[end - 1], low[np.maximum(end - 2, 0)], low[np.maximum(end - 3, 0)]
    ies = ~han & (size > 4) & (last == 115) & (second == 101) & (third == 105)
    plural = ~han & ~ies & (size > 3) & (last == 115) & (second != 115)
    h = raw(start, end - plural - 3 * ies)
    length = size - plural - 2 * ies
    h = np.where(ies, h + np.uint64(122) * power[np.maximum(size - 3, 0)], h)
    out = Parsed(len(texts), owner, n, named(h, length, 1), start, end, sentence[start], han)
    latin = np.flatnonzero(~han)
    out_f, out_s, out_e = [], [], []
    # words of three letters and more, and pairs of neighbours in a sentence; what is common is taken out later
    long_ = latin[length[latin] > 2]
    out_f.append(out.word[long_])
    out_s.append(start[long_])
    out_e.append(end[long_])
    k = np.flatnonzero(~han[:-1] & ~han[1:] & (out.w_sentence[:-1] == out.w_sentence[1:]) & (length[:-1] > 1) & (length[1:] > 1)) if len(start) else np.zeros(0, np.int64)
    out._pairs = (len(long_), k, long_)
    out_f.append(mix(out.word[k] * GOLD + out.word[k + 1] + salt(2)))
    out_s.append(start[k])
    out_e.append(end[k + 1] if len(k) else end[:0])
    at = np.flatnonzero(kind == HAN)
    run_end = np.repeat(end[han], size[han])
    for m in (2, 3, 4, 5):
        p = at[at + m <= run_end]
        g = named(raw(p, p + m), m, 3)
        out_f.append(g)
        out_s.append(p)
        out_e.append(p + m)
        if m == 2:
            out.pair, out.p_start, out.p_sentence = g, p, sentence[p]
    out.single, out.s_sentence = named(value[at], 1, 4), sentence[at]
    out.feature, out.f_start, out.f_end = np.concatenate(out_f), np.concatenate(out_s), np.concatenate(out_e)
    out.f_sentence = sentence[out.f_start]
    # 52 bits name a feature, so that 12 more can name a document of the block; the lowest tells Chinese ones
    words = len(long_) + len(k)
    out.feature = (out.feature >> np.uint64(13)) << np.uint64(1)
    out.feature[words:] |= np.uint64(1)
    return out


def inside(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted array, -1 where it is not in."""
    if not len(sorted_keys):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == x, at, -1)


@dataclass
class Model:
    """What the tasks need to count sentences: a few arrays, all sorted by their hash."""

    areas: int
    #: documents with Chinese characters
    han_docs: int
    common: np.ndarray
    stop: np.ndarray
    #: languages and their marks: log shares, a row a word and a column a language
    marks: np.ndarray
    shares: np.ndarray
    #: features and the log odds by area of complement naive Bayes, 0 where a feature does not speak for the area
    features: np.ndarray
    odds: np.ndarray
    passing: np.ndarray
    posterior: np.ndarray | None
    #: features that later rounds count, all if there is no such list
    active: np.ndarray | None = None

    @property
    def languages(self) -> int:
        return max(1, self.shares.shape[1])


def drop_common(p: Parsed, model: Model) -> Parsed:
    """The features without common words and without pairs that hold a stop word."""
    n_words, k, long_ = p._pairs
    keep = np.ones(len(p.feature), bool)
    keep[:n_words] = inside(model.common, p.word[long_]) < 0
    stop = inside(model.stop, p.word) >= 0
    keep[n_words : n_words + len(k)] = ~(stop[k] | stop[k + 1]) if len(k) else True
    p.feature, p.f_start, p.f_end, p.f_sentence = p.feature[keep], p.f_start[keep], p.f_end[keep], p.f_sentence[keep]
    return p


def language(p: Parsed, model: Model) -> np.ndarray:
    """The likeliest language of each document, by the words that mark one."""
    score = np.zeros((p.docs, model.languages))
    for keys, sent in ((p.word, p.w_sentence), (p.single, p.s_sentence)):
        at = inside(model.marks, keys)
        ok = at >= 0
        np.add.at(score, p.sentence_doc[sent[ok]], model.shares[at[ok]])
    return score.argmax(axis=1)


def mentions(p: Parsed, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sentence, area, cover)``: the areas each sentence names, and which characters their features cover.

    A place is explained by its longest feature only. A sentence names the areas for which
    the log odds of its features add up to ``ODDS``.
    """
    at = inside(model.features, p.feature)
    hit = np.flatnonzero(at >= 0)
    hit = hit[np.argsort(p.f_start[hit], kind="stable")]
    s, e = p.f_start[hit], p.f_end[hit]
    # features that overlap, directly or through others, form a cluster; only those need a look one by one
    reach = np.maximum.accumulate(e) if len(e) else e
    cluster = np.cumsum(np.concatenate([[True], s[1:] >= reach[:-1]])) if len(s) else s
    order = np.lexsort((s, s - e, cluster))
    hit, s, e, cluster = hit[order], s[order], e[order], cluster[order]
    keep = np.ones(len(hit), bool)
    taken: list[tuple[int, int]] = []
    last = -1
    crowded = np.flatnonzero(np.bincount(cluster)[cluster] > 1) if len(hit) else hit
    for i, c, x, y in zip(crowded.tolist(), cluster[crowded].tolist(), s[crowded].tolist(), e[crowded].tolist()):
        if c != last:
            last, taken = c, []
        if all(y <= u or x >= v for u, v in taken):
            taken.append((x, y))
        else:
            keep[i] = False
    hit, s, e = hit[keep], s[keep], e[keep]
    edge = np.zeros(p.chars + 1, np.int32)
    np.add.at(edge, s, 1)
    np.add.at(edge, e, -1)
    named, back = np.unique(p.f_sentence[hit], return_inverse=True)
    weight = np.zeros((len(named), model.areas))
    np.add.at(weight, back.reshape(-1), model.odds[at[hit]])
    i, area = np.nonzero(weight >= ODDS)
    return named[i], area, np.cumsum(edge[:-1]) > 0


def contexts(p: Parsed, cover: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(sentence, hash)`` of what the features do not cover in the given sentences: words, and pairs of Chinese characters; each once a sentence."""
    own = np.zeros(len(p.sentence_doc) + 1, bool)
    own[sentences] = True
    w = np.flatnonzero(~p.w_han & own[p.w_sentence] & ~cover[np.minimum(p.w_start, max(p.chars - 1, 0))]) if p.chars else np.zeros(0, np.int64)
    h = np.flatnonzero(own[p.p_sentence] & ~cover[p.p_start] & ~cover[p.p_start + 1]) if len(p.pair) else np.zeros(0, np.int64)
    sent, key = np.concatenate([p.w_sentence[w], p.p_sentence[h]]), np.concatenate([p.word[w], p.pair[h]])
    if not len(key):
        return sent, key
    order = np.lexsort((key, sent))
    sent, key = sent[order], key[order]
    new = np.concatenate([[True], (sent[1:] != sent[:-1]) | (key[1:] != key[:-1])])
    return sent[new], key[new]


def counts(p: Parsed, model: Model) -> np.ndarray:
    """How many sentences of each document deal with each area; sentences with a context of passing mentions count for none."""
    out = np.zeros((p.docs, model.areas), np.int32)
    sent, area, cover = mentions(p, model)
    if len(sent) and len(model.passing):
        cs, ck = contexts(p, cover, sent)
        bad = np.zeros(len(p.sentence_doc) + 1, bool)
        bad[cs[inside(model.passing, ck) >= 0]] = True
        ok = ~bad[sent]
        sent, area = sent[ok], area[ok]
    np.add.at(out, (p.sentence_doc[sent], area), 1)
    return out


def isotonic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``x`` under weights ``w`` (pooling adjacent violators)."""
    stack: list[list[float]] = []
    for v, k in zip(x, w):
        stack.append([v, k, 1])
        while len(stack) > 1 and stack[-2][0] > stack[-1][0]:
            b, a = stack.pop(), stack.pop()
            t = a[1] + b[1]
            stack.append([(a[0] * a[1] + b[0] * b[1]) / t if t else max(a[0], b[0]), t, a[2] + b[2]])
    return np.array([v for v, _, m in stack for _ in range(int(m))])


def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of a bounded number of documents and characters; a longer document is a slice of its own."""
    size = [len(t or "") for t in batch.column("text").to_pylist()]
    at = chars = 0
    for i, n in enumerate(size):
        if i > at and (chars + n > BLOCK_CHARS or i - at == BLOCK_DOCS):
            yield batch.slice(at, i - at)
            at, chars = i, 0
        chars += n
    if batch.num_rows > at:
        yield batch.slice(at)


def _labels(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Label vectors, and which documents have one."""
    rows = batch.column("label").to_pylist()
    has = np.array([r is not None for r in rows], bool)
    return np.array([r if r is not None else [0.0] * n for r in rows], np.float64).reshape(len(rows), n), has


def _merged(cols: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows ``f, fold, area, v, n`` with one row for each feature, part and area."""
    f, g, a, v, n = (np.concatenate(c) for c in zip(*cols))
    order = np.lexsort((a, g, f))
    f, g, a, v, n = f[order], g[order], a[order], v[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (g[1:] != g[:-1]) | (a[1:] != a[:-1])]))
    return f[head], g[head], a[head], np.add.reduceat(v, head), np.add.reduceat(n, head)


def _statistics(docs: DataFrame, model: Model, fold: bool) -> DataFrame:
    """``f, fold, area, v, n``: for each feature its occurrences and documents (area -1), and its occurrences weighed by the posterior of each area; all documents under feature -1.

    Without a posterior the labels stand for it, and only labelled documents are taken.
    Later all documents are, with the calibrated posterior of their sentence counts,
    averaged with the label where there is one; an area that no sentence names has none.
    Where the model names active features, only those are counted. A task adds up its rows
    before they leave it.
    """
    n = model.areas

    def record(cols: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(_merged(cols), (np.int64, np.int32, np.int32, np.float64, np.int64))], names=["f", "fold", "area", "v", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            for batch in blocks(whole):
                p = drop_common(parse(batch.column("text").to_pylist()), model)
                label, has = _labels(batch, n)
                part = np.asarray(batch.column("fold")).astype(np.int64) if fold else np.zeros(p.docs, np.int64)
                if model.posterior is None:
                    r = label
                else:
                    s = np.minimum(counts(p, model), MOST)
                    r = np.where(s > 0, model.posterior[language(p, model)[:, None], np.arange(n)[None, :], s], 0.0)
                    r[has] = (r[has] + label[has]) / 2
                feature, sentence = p.feature, p.f_sentence
                if model.active is not None:
                    ok = inside(model.active, feature) >= 0
                    feature, sentence = feature[ok], sentence[ok]
                doc = p.sentence_doc[sentence]
                for g in np.unique(part):
                    own = part == g
                    pick = own[doc] if fold else slice(None)
                    key = np.sort((feature[pick] << np.uint64(12)) | doc[pick].astype(np.uint64))
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                    tf = np.diff(np.append(first, len(key))).astype(np.float64)
                    f, d = (key[first] >> np.uint64(12)).view(np.int64), (key[first] & np.uint64(4095)).astype(np.int64)
                    head = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
                    names = f[head]
                    cols.append((np.append(names, -1), np.full(len(names) + 1, g), np.full(len(names) + 1, -1), np.append(np.add.reduceat(tf, head) if len(head) else tf[:0], own.sum()), np.append(np.diff(np.append(head, len(f))), own.sum())))
                    for a in range(n):
                        if not (r[own, a] > 0).any():
                            continue
                        v = np.add.reduceat(tf * r[d, a], head) if len(head) else tf[:0]
                        ok = v > 0
                        cols.append((np.append(names[ok], -1), np.full(ok.sum() + 1, g), np.full(ok.sum() + 1, a), np.append(v[ok], r[own, a].sum()), np.zeros(ok.sum() + 1)))
                if sum(len(c[0]) for c in cols) > HELD_ROWS:
                    cols = [_merged(cols)]
                    if len(cols[0][0]) > HELD_ROWS // 2:
                        yield record(cols)
                        cols = []
        if cols:
            yield record(cols)

    src = docs.where("label is not null") if model.posterior is None else docs
    return src.select("text", "label", "fold").mapInArrow(run, "f long, fold int, area int, v double, n long").groupBy("f", "fold", "area").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def _shares(stats: DataFrame, n: int, least: int, han_docs: int | None) -> tuple[DataFrame, float] | None:
    """``f, area, n, t, k, in``: of each feature its documents and occurrences, those of an area, and the documents of the area; and the number of documents."""
    total = {r["area"]: (r["v"], r["n"]) for r in stats.where("f = -1").groupBy("area").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    docs = float(total.get(-1, (0.0, 0))[0])
    if not docs:
        return None
    t = stats.where("f != -1 and area = -1").groupBy("f").agg(F.sum("v").alias("t"), F.sum("n").alias("n")).where(F.col("n") >= least)
    if han_docs is not None:
        t = t.where((F.col("f").bitwiseAND(F.lit(1)) == 0) | (F.col("n") <= COMMON_SHARE * han_docs))
    k = stats.where("f != -1 and area != -1").groupBy("f", "area").agg(F.sum("v").alias("k"))
    base = F.create_map(*[x for a in range(n) for x in (F.lit(a), F.lit(float(total.get(a, (0.0, 0))[0])))])
    return t.join(k, "f").select("f", "area", "n", "t", F.least("k", "t").alias("k"), base[F.col("area")].alias("in")), docs


def _low(z: float):
    """The lower bound (Wilson) of the share of an area among a feature's documents."""
    p, nn, z2 = F.col("k") / F.col("t"), F.col("n"), z * z
    return (p + z2 / (2 * nn) - z * F.sqrt((p * (1 - p) + z2 / (4 * nn)) / nn)) / (1 + z2 / nn)


def _weights(stats: DataFrame, n: int, least: int, from_labels: bool, han_docs: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features that speak for an area, sorted, and their log odds by complement naive Bayes: the rate in the area's documents against that in all others.

    The lower bound of the share of the area among the documents with the feature must be
    high as well, which keeps out what is frequent only by chance; Chinese features in more
    than ``COMMON_SHARE`` of the ``han_docs`` are common.
    """
    none = np.zeros(0, np.uint64), np.zeros((0, n))
    got = _shares(stats, n, least, None if from_labels else han_docs)
    if got is None:
        return none
    x, docs = got
    k, t, nn = F.col("k"), F.col("t"), F.col("n")
    odds = F.log((k + 0.5) / (F.col("in") + 1.0)) - F.log((t - k + 0.5) / (F.greatest(F.lit(docs) - F.col("in"), F.lit(0.0)) + 1.0))
    sure = _low(Z) >= SHARE
    if from_labels:
        p = k / t
        rate = F.least(F.greatest(F.col("in") / docs, F.lit(1e-6)), F.lit(1 - 1e-6))
        ratio = 2 * nn * (p * F.log(F.greatest(p, F.lit(1e-9)) / rate) + (1 - p) * F.log(F.greatest(1 - p, F.lit(1e-9)) / (1 - rate)))
        sure = sure | ((p >= LABEL_SHARE) & (p > rate) & (ratio >= LABEL_RATIO))
    rows = x.where(sure & (odds >= ODDS)).select("f", "area", odds.alias("w")).collect()
    if not rows:
        return none
    keys, back = np.unique(np.array([r["f"] for r in rows], np.int64).view(np.uint64), return_inverse=True)
    w = np.zeros((len(keys), n))
    w[back.reshape(-1), np.array([r["area"] for r in rows])] = [r["w"] for r in rows]
    return keys, w


def _active(stats: DataFrame, n: int, least: int, han_docs: int) -> np.ndarray:
    """The features that may come to speak for an area in a later round, sorted."""
    got = _shares(stats, n, least, han_docs)
    rows = [] if got is None else got[0].where(_low(1.0) >= ACTIVE).select("f").distinct().collect()
    return np.sort(np.array([r["f"] for r in rows], np.int64).view(np.uint64))


def _calibrated(docs: DataFrame, models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """From the labelled documents: the contexts of passing mentions, and the posterior by language, area and number of sentences.

    With several models each document is counted by that of its part. The curve of an area
    is drawn to that of all areas of its language, and that to the curve of all languages,
    where labels are few; the areas' posteriors are independent of one another.
    """
    n, langs = models[0].areas, models[0].languages
    own = docs.where("label is not null").select("text", "label", "fold")

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[Parsed, np.ndarray, Model]]:
        for block in blocks(batch):
            fold = np.asarray(block.column("fold")).astype(np.int64)
            for g in np.unique(fold) if len(models) > 1 else [0]:
                pick = block.filter(pa.array(fold == g)) if len(models) > 1 else block
                yield drop_common(parse(pick.column("text").to_pylist()), models[g]), _labels(pick, n)[0], models[g]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, label, model in parts(batch):
                sent, area, cover = mentions(p, model)
                cs, ck = contexts(p, cover, np.unique(sent))
                many, yes = np.zeros(len(p.sentence_doc) + 1), np.zeros(len(p.sentence_doc) + 1)
                np.add.at(many, sent, 1.0)
                np.add.at(yes, sent, label[p.sentence_doc[sent], area])
                yield pa.RecordBatch.from_arrays([pa.array(ck.view(np.int64)), pa.array(many[cs]), pa.array(yes[cs])], names=["c", "n", "y"])

    at = own.mapInArrow(seen, "c long, n double, y double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).where("n >= 6")
    p, z2 = F.col("y") / F.col("n"), Z_CONTEXT * Z_CONTEXT
    high = (p + z2 / (2 * F.col("n")) + Z_CONTEXT * F.sqrt((p * (1 - p) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
    passing = np.sort(np.array([r["c"] for r in at.where(high < 0.33).select("c").collect()], np.int64).view(np.uint64))
    for m in models:
        m.passing = passing

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.zeros((2, langs, n, MOST + 1))
            for p, label, model in parts(batch):
                s, g = np.minimum(counts(p, model), MOST), language(p, model)
                for j, v in enumerate((np.ones_like(label), label)):
                    np.add.at(t[j], (g[:, None], np.arange(n)[None, :], s), v)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(langs * n * (MOST + 1), dtype=np.int32)), pa.array(t[0].reshape(-1)), pa.array(t[1].reshape(-1))], names=["s", "n", "y"])

    k, y = np.zeros(langs * n * (MOST + 1)), np.zeros(langs * n * (MOST + 1))
    for r in own.mapInArrow(tally, "s int, n double, y double").groupBy("s").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).collect():
        k[r["s"]], y[r["s"]] = r["n"], r["y"]
    k, y = k.reshape(langs, n, MOST + 1), y.reshape(langs, n, MOST + 1)
    every = isotonic((y.sum(axis=(0, 1)) + 0.1) / (k.sum(axis=(0, 1)) + 1), k.sum(axis=(0, 1)) + 1e-6)
    out = np.zeros((langs, n, MOST + 1))
    for g in range(langs):
        kg, yg = k[g].sum(axis=0), y[g].sum(axis=0)
        pooled = isotonic((yg + POOLED * every) / (kg + POOLED), kg + POOLED)
        for a in range(n):
            out[g, a] = isotonic((y[g, a] + POOLED * pooled) / (k[g, a] + POOLED), k[g, a] + POOLED)
    return passing, out


def _vocabulary(docs: DataFrame, n: int) -> Model:
    """Common words, and the words that mark a language; both from all documents.

    At most (words a document) / share words can be common or marks, whatever the corpus.
    """
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                p = parse(batch.column("text").to_pylist())
                langs, code = np.unique(np.array([x or "" for x in batch.column("lang").to_pylist()], dtype=object).astype(str), return_inverse=True)
                code = code.reshape(-1)
                own = ~p.w_han
                key = np.concatenate([p.word[own], p.single])
                doc = p.sentence_doc[np.concatenate([p.w_sentence[own], p.s_sentence])]
                han = np.concatenate([np.zeros(own.sum(), bool), np.ones(len(p.single), bool)])
                order = np.lexsort((key, doc))
                key, doc, han = key[order], doc[order], han[order]
                new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]) if len(key) else np.zeros(0, bool)
                key, han, lang = key[new], han[new], code[doc[new]]
                order = np.lexsort((key, lang))
                key, han, lang = key[order], han[order], lang[order]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])])) if len(key) else np.zeros(0, np.int64)
                docs_of = np.append(np.bincount(code, minlength=len(langs)), len(np.unique(p.sentence_doc[p.s_sentence])))
                names = [*langs.tolist(), HAN_DOCS]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([key[head].view(np.int64), np.zeros(len(names), np.int64)])), pa.array(np.concatenate([han[head], np.zeros(len(names), bool)])),
                        pa.array([*langs[lang[head]].tolist(), *names], pa.string()), pa.array(np.concatenate([np.diff(np.append(head, len(key))), docs_of]).astype(np.int64)),
                        pa.array(np.concatenate([np.zeros(len(head), bool), np.ones(len(names), bool)])),
                    ],
                    names=["w", "han", "lang", "n", "whole"],
                )

    code = F.lower(F.regexp_extract(F.coalesce(F.trim("lang"), F.lit("")), r"^([A-Za-z]{2,3})(?:[-_]\w+)?$", 1))
    src = docs.select("text", F.when(code == "und", "").otherwise(code).alias("lang"))
    rows = stored(src.mapInArrow(seen, "w long, han boolean, lang string, n long, whole boolean").groupBy("w", "han", "lang", "whole").agg(F.sum("n").alias("n")))
    size = {r["lang"]: r["n"] for r in rows.where("whole").collect()}
    han_docs = size.pop(HAN_DOCS, 0)
    total, stated = sum(size.values()), sum(v for k, v in size.items() if k)
    langs = sorted(k for k, v in size.items() if k and v >= LANGUAGE_SHARE * stated)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(float(size[k])))]) if langs else None
    alone = F.col("n") / share[F.col("lang")] if langs else F.lit(0.0)
    words = rows.where("not whole and not han").groupBy("w").agg((F.sum("n") / float(max(total, 1))).alias("p"), F.max(F.coalesce(alone, F.lit(0.0))).alias("q"))
    often = words.select("w", F.greatest("p", "q").alias("p")).where(F.col("p") > COMMON_SHARE).collect()
    common = np.sort(np.array([r["w"] for r in often], np.int64).view(np.uint64))
    stop = np.sort(np.array([r["w"] for r in often if r["p"] > STOP_SHARE], np.int64).view(np.uint64))
    marks, shares = np.zeros(0, np.uint64), np.zeros((0, max(1, len(langs))))
    if len(langs) > 1:
        known = rows.where(~F.col("whole") & F.col("lang").isin(langs)).withColumn("p", F.col("n") / share[F.col("lang")])
        mark = known.groupBy("w").agg(F.max("p").alias("most"), F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("by")).where(F.col("most") >= MARK_SHARE).collect()
        key = np.array([r["w"] for r in mark], np.int64).view(np.uint64)
        order = np.argsort(key)
        marks = key[order]
        shares = np.log(np.array([[mark[i]["by"].get(k, 0.0) + 0.01 for k in langs] for i in order]).reshape(len(order), len(langs)))
    return Model(n, han_docs, common, stop, marks, shares, np.zeros(0, np.uint64), np.zeros((0, n)), np.zeros(0, np.uint64), None)


def subject_areas(docs: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """``doc_id, area, sentences, posterior`` for every area whose posterior is at least ``SURE``.

    Complement naive Bayes weighs the features of labelled documents; its log odds decide
    which areas a sentence deals with, and calibrated curves turn the number of sentences
    of a document into an independent posterior for each area. The first curves count each
    labelled document with weights from the other parts of the labels. Expectation
    (posteriors of all documents) and maximisation (weights from all documents) then
    alternate. Contexts that go with mentions in documents without the label mark a
    mention as passing.

    ``docs`` has ``doc_id, text`` and may have ``lang``, from which the marks of languages
    are learned. All statistics cover all documents and whole texts; the model, all
    features that are sure, is gathered by the driver and sent to the tasks. Labels by
    several annotators are averaged, repeated ones count once, unknown areas are ignored.
    Null, empty and blank texts have no area; repeated document rows count once in the
    result. Without any label the result is empty.
    """
    names = sorted(r[0] for r in areas.select("area").distinct().collect() if r[0])
    n = len(names)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, area string, sentences int, posterior double"
    lab = labels.where("doc_id is not null and area is not null and annotator_id is not null").select("doc_id", "area", "annotator_id").distinct()
    soft = lab.groupBy("doc_id").agg(F.array(*[F.sum(F.when(F.col("area") == a, 1.0).otherwise(0.0)) for a in names]).alias("votes"), F.count_distinct("annotator_id").alias("k"))
    soft = soft.select("doc_id", F.transform("votes", lambda v: F.least(v / F.col("k"), F.lit(1.0))).alias("label"))
    text = docs.where("doc_id is not null and text is not null").select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    known = cut(text.join(soft, "doc_id").select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold")))
    if not n or known.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    model = _vocabulary(text, n)

    # the weights of all labels, and for each part of the labelled documents those of the other parts
    stats = stored(_statistics(known, model, True))
    folds = []
    for g in range(FOLDS):
        f, w = _weights(stats.where(F.col("fold") != g), n, 2, True)
        folds.append(Model(n, model.han_docs, model.common, model.stop, model.marks, model.shares, f, w, model.passing, None))
    model.features, model.odds = _weights(stats, n, 2, True)
    model.passing, model.posterior = _calibrated(known, folds)
    everything = text.join(soft, "doc_id", "left").select("text", "label", F.lit(0).alias("fold"))
    for turn in range(ROUNDS):
        stats = stored(_statistics(everything, model, False))
        model.features, model.odds = _weights(stats, n, LEAST_DOCS, False, model.han_docs)
        if turn == 0:
            model.active = _active(stats, n, LEAST_DOCS, model.han_docs)
        model.passing, model.posterior = _calibrated(known, [model])

    model.active = None

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole):
                p = drop_common(parse(batch.column("text").to_pylist()), model)
                s = counts(p, model)
                r = model.posterior[language(p, model)[:, None], np.arange(n)[None, :], np.minimum(s, MOST)]
                d, a = np.nonzero((s > 0) & (r >= SURE))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([names[i] for i in a], pa.string()), pa.array(s[d, a]), pa.array(r[d, a])], names=["doc_id", "area", "sentences", "posterior"])

    return text.select("doc_id", "text").mapInArrow(decide, schema).groupBy("doc_id", "area").agg(F.max("sentences").alias("sentences"), F.max("posterior").alias("posterior"))


def composition(found: DataFrame, docs: DataFrame, areas: DataFrame) -> DataFrame:
    """``area, documents, share`` of the whole corpus, for every area."""
    total = docs.where("doc_id is not null").select(F.count_distinct("doc_id").alias("total"))
    have = found.groupBy("area").agg(F.count(F.lit(1)).alias("documents"))
    rows = areas.select("area").distinct().join(have, "area", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    return rows.join(total, F.lit(True)).select("area", "documents", F.try_divide(F.col("documents").cast("double"), "total").alias("share"))
