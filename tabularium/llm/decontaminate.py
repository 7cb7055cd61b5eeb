"""Benchmark decontamination with an FM-index of each training shard.

A shard is a run of documents of one partition, about ``SHARD_CHARS`` bytes of text. All words of all its texts are
numbered and indexed, one text after the other with a separator between them: the Burrows-Wheeler transform of the
sequence as a wavelet tree with rank counts, and suffix positions sampled at every ``SAMPLE``-th place of the sequence.
The index of a shard is built once; then the windows of each benchmark block are searched backwards in it, all windows
together, a word at a time. Windows are distinct: one that many items share is searched once and keeps the list of its
items. A window with a word that the shard lacks has no occurrence. Occurrences are located by walking to the next
sampled position and marked on the shard's words, over all blocks; runs of marked words are the spans. Words are numbered
by 64-bit hashes whose bytes are compared, so equal numbers are equal words.

The benchmark is handed out in blocks of about ``BLOCK_CHARS`` characters. The first ``BROADCAST_BLOCKS`` are
broadcast; a larger benchmark's further blocks are files in the shared folder that workers read one at a time. So
neither what is broadcast nor what a worker holds grows with the benchmark.

Defined cases: a null text has no words and is never contaminated; an item without words has no window; one of fewer
words than a window is one window; items that share a text are all counted; a long text is one shard of its own, whole;
repeated rows stay separate; empty tables give no rows, or no hits; windows of an item with a null key mark hits, but
add no item; keys may be of any type (items' keys are listed as strings); columns other than key and text are ignored,
whatever they are called.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, by_text, filesystem, joined, quoted, runs, shared_dir, span_hashes

WINDOW, SAMPLE = 13, 8
#: Characters of benchmark text a block (one item at least), and how many blocks are broadcast.
BLOCK_CHARS, BROADCAST_BLOCKS = 4_000_000, 4
#: Bytes of text a shard.
SHARD_CHARS = 1_500_000
#: Fixed by the contract: a document is contaminated if hit words are at least one in so many.
SHARE = 20

_WORD = np.array([not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of the texts, begin and end of each word, and its text's number."""
    data, starts = joined(texts)
    data = np.frombuffer(data.tobytes().translate(LOWER_ASCII), np.uint8)
    begin, end = runs(_WORD[data])
    return data, begin, end, np.searchsorted(starts, begin, "right") - 1


class WaveletTree:
    """Ranks over a sequence of small numbers: one bit vector with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        s = symbols
        for k in range(bits - 1, -1, -1):  # the matrix form: after each level, symbols with a 0 bit come first
            bit = ((s >> k) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(int(len(s) - ones[-1]))
            s = np.concatenate((s[~bit], s[bit]))

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``lo`` and before ``hi``."""
        base = np.zeros_like(lo)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            base, lo, hi = (np.where(bit, zeros + x, at - x) for at, x in ((base, ones[base]), (lo, ones[lo]), (hi, ones[hi])))
        return lo - base, hi - base

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.levels, self.zeros):
            before = ones[at]
            bit = ones[at + 1] - before
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + before, at - before)
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes. The last symbol must be the least and occur once.

    Suffixes are ordered by their first symbols, then by twice as many, and so on; only those that are still tied are
    sorted again.
    """
    n, top = len(s), int(s.max()) + 1
    width = max(1, 62 // max(1, top.bit_length()))  # symbols that fit into one number
    padded, key = np.concatenate((s, np.zeros(width, s.dtype))), np.zeros(n, np.int64)
    for k in range(width):
        key = key << top.bit_length() | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    found = key[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # a suffix's rank: where its group of ties begins
    rank = np.empty(n, np.int64)
    rank[order] = head
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order that belong to groups of several
    k = width
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        sub = np.argsort(key, kind="stable")
        at, key = at[sub], key[sub]
        order[tied] = at  # groups stay where they are: their rank leads the key
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        k *= 2
    return order


class FMIndex:
    """Full-text index of a sequence over 2..symbols-1, in which 1 separates runs and a 0 is put at the end."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        s = np.append(sequence, 0).astype(np.int32)
        order = suffix_array(s)
        self.n = len(s)
        self.tree = WaveletTree(s[order - 1], max(1, int(symbols - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=symbols))))
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate(([0], np.cumsum(sampled, dtype=np.int32)))
        self.kept = order[sampled]

    def search(self, words: np.ndarray, lengths: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern words[start : start + length] (without ``start``: each row of ``words``) the range of suffixes that begin with it."""
        if start is None:
            words, start = words.ravel(), np.arange(len(lengths)) * words.shape[1]
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        open_ = np.arange(len(start))
        for back in range(int(lengths.max()) if len(lengths) else 0):
            open_ = open_[(lengths[open_] > back) & (lo[open_] < hi[open_])]
            if not len(open_):
                break
            c = words[start[open_] + lengths[open_] - 1 - back]
            a, b = self.tree.ranks(c, lo[open_], hi[open_])
            lo[open_], hi[open_] = self.first[c] + a, self.first[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each suffix row: steps back until a sampled position, plus the number of steps."""
        out, row, open_ = np.zeros(len(rows), np.int64), rows.astype(np.int64), np.arange(len(rows))
        steps = 0
        while len(open_):
            r = row[open_]
            hit = self.sampled[r + 1] > self.sampled[r]
            out[open_[hit]] = self.kept[self.sampled[r[hit]]] + steps
            open_, r = open_[~hit], r[~hit]
            c = self.tree.access(r)
            row[open_] = self.first[c] + self.tree.ranks(c, r, r)[0]
            steps += 1
        return out


def _numbered(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words in order, where each first occurs, and the number of each word. Equal numbers are equal bytes."""
    h = span_hashes(data, begin, end)
    vocabulary, first, number = np.unique(h, return_index=True, return_inverse=True)
    size, model = end - begin, first[number]
    same = bool((size == size[model]).all())
    if same and len(size):
        offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = bool((data[np.repeat(begin, size) + offset] == data[np.repeat(begin[model], size) + offset]).all())
    if not same:  # two words with one hash: they are told apart by their bytes
        words = [(x, data[a:b].tobytes()) for x, a, b in zip(h.tolist(), begin.tolist(), end.tolist())]
        places = {w: i for i, w in enumerate(sorted(set(words)))}
        number = np.array([places[w] for w in words], np.int64)
        vocabulary, first = np.array([x for x, _ in sorted(places)], np.uint64), np.unique(number, return_index=True)[1]
    return vocabulary, first, number


class Shard:
    """The texts of a shard, numbered and indexed word by word."""

    def __init__(self, texts: list[str | None]):
        data, begin, end, self.doc = _words(texts)
        self.texts = len(texts)
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(self.doc) else np.zeros(len(texts), np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.vocabulary, first, number = _numbered(data, begin, end)  # word number = place + 2
        raw = data.tobytes()
        self.words = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())]
        sequence = np.ones(len(number) + len(texts), np.int64)  # 1 after each text
        sequence[np.arange(len(number)) + self.doc] = number + 2
        self.index = FMIndex(sequence, len(self.vocabulary) + 2)

    def numbers(self, block: Block) -> np.ndarray:
        """The number here of each word of a block, 0 for those that don't occur."""
        out = np.zeros(len(block.vocabulary), np.int64)
        at = np.searchsorted(self.vocabulary, block.vocabulary)
        held = np.flatnonzero((at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == block.vocabulary))
        for i, p in zip(held.tolist(), at[held].tolist()):
            while p < len(self.words) and self.vocabulary[p] == block.vocabulary[i]:  # nearly always one
                if self.words[p] == block.words[i]:
                    out[i] = p + 2
                p += 1
        return out

    def find(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The occurrences of a block's distinct windows: window, first word of the shard, text."""
        none = np.zeros(0, np.int64)
        if not len(self.vocabulary) or not len(block.start):
            return none, none, none
        number = self.numbers(block)[block.sequence]
        missing = np.concatenate(([0], np.cumsum(number == 0)))
        window = np.flatnonzero(missing[block.start + block.length] == missing[block.start])
        lo, hi = self.index.search(number, block.length[window], block.start[window])
        size = hi - lo
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        which, at = np.repeat(window, size), self.index.locate(rows)
        doc = np.searchsorted(self.first[1:] + np.arange(self.texts) + 1, at, "right")
        return which, at - doc, doc


@dataclass
class Block:
    """Distinct windows of some benchmark items: stretches of ``sequence``, whose numbers are places in the vocabulary."""

    vocabulary: np.ndarray  # sorted hashes
    words: list[bytes]
    sequence: np.ndarray
    start: np.ndarray
    length: np.ndarray
    edge: np.ndarray  # window w is in the items item[edge[w]:edge[w + 1]]
    item: np.ndarray
    names: list[str | None]

    @classmethod
    def build(cls, items: list[tuple], window: int = WINDOW) -> Block:
        data, begin, end, item = _words([t for _, t in items])
        vocabulary, first, number = _numbered(data, begin, end)
        raw = data.tobytes()
        size = np.bincount(item, minlength=len(items)) if len(item) else np.zeros(len(items), np.int64)
        per = np.where(size > 0, np.maximum(size - window + 1, 1), 0)
        of = np.repeat(np.arange(len(items)), per)
        start = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(np.cumsum(size) - size, per)
        length = np.minimum(size[of], window)
        padded = np.concatenate((number, np.zeros(window, number.dtype)))
        content = np.full((len(of), window), -1, np.int32)
        for k in range(window):  # a window's words, -1 beyond a short one
            content[:, k] = np.where(k < length, padded[start + k], -1)
        _, model, distinct = np.unique(content, axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(distinct.reshape(-1).astype(np.int64) * max(1, len(items)) + of)
        edge = np.searchsorted(pairs // max(1, len(items)), np.arange(len(model) + 1))
        return cls(vocabulary, [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], number.astype(np.int32), start[model], length[model], edge, pairs % max(1, len(items)), [None if k is None else str(k) for k, _ in items])

    def items(self, window: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item), distinct, of occurrences."""
        pairs = np.unique(doc * max(1, len(self.start)) + window)
        doc, window = pairs // max(1, len(self.start)), pairs % max(1, len(self.start))
        size = self.edge[window + 1] - self.edge[window]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.edge[window], size)
        both = np.unique(np.repeat(doc, size) * max(1, len(self.names)) + self.item[at])
        return both // max(1, len(self.names)), both % max(1, len(self.names))


def _spans(hit: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of marked words; a run ends where its text does."""
    before = np.concatenate(([False], hit[:-1] & (doc[1:] == doc[:-1]))) if len(hit) else hit
    after = np.concatenate((hit[1:] & (doc[1:] == doc[:-1]), [False])) if len(hit) else hit
    return np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS):
    """The benchmark, read a partition at a time, as blocks of at most ``chars`` characters (or one item)."""
    held, size = [], 0
    for r in benchmark.select(quoted(key).cast("string").alias("k"), quoted(text).cast("string").alias("t")).where("t IS NOT NULL").toLocalIterator():
        if held and size + len(r.t) > chars:
            yield Block.build(held)
            held, size = [], 0
        held.append((r.k, r.t))
        size += len(r.t)
    yield Block.build(held)


def hand_out(spark: SparkSession, found) -> list[Callable[[], Block]]:
    """How a worker comes by each block: broadcast, or as a file of the shared folder."""
    out, root = [], None
    for i, block in enumerate(found):
        if i < BROADCAST_BLOCKS:
            held = spark.sparkContext.broadcast(block)
            out.append(lambda held=held: held.value)
            continue
        root = root or shared_dir(spark)
        fs, path = filesystem(f"{root}/block-{i:06d}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(pickle.dumps(block))
        out.append(lambda uri=f"{root}/block-{i:06d}": _read_block(uri))
    return out


def _read_block(uri: str) -> Block:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return pickle.loads(f.read())


KIND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def contamination(spark: SparkSession, text: Column, benchmark: DataFrame, *, item_key: str = "item_id", item_text: str = "text", chars: int = BLOCK_CHARS) -> Column:
    """(n_words, n_hit, n_items, items_sha256, contaminated, spans) of a text; spans are the word positions to remove."""
    given = hand_out(spark, blocks(benchmark, item_key, item_text, chars))

    def work(texts: list) -> pa.Array:
        shard = Shard(texts)
        marks = np.zeros(len(shard.doc) + 1, np.int64)
        items: list[set] = [set() for _ in texts]
        for get in given:  # one after the other: no more than a block's occurrences at once
            block = get()
            which, word, doc = shard.find(block)
            np.add.at(marks, word, 1)
            np.add.at(marks, word + block.length[which], -1)
            for d, i in zip(*(x.tolist() for x in block.items(which, doc))):
                if block.names[i] is not None:
                    items[d].add(block.names[i])
        hit = np.cumsum(marks)[:-1] > 0
        begin, end = _spans(hit, shard.doc)
        of = np.searchsorted(shard.first, begin, "right") - 1
        edge, total = np.searchsorted(of, np.arange(len(texts) + 1)), np.concatenate(([0], np.cumsum(hit)))
        out = []
        for d, (n, own) in enumerate(zip(shard.count.tolist(), items)):
            a, b, zero = int(edge[d]), int(edge[d + 1]), int(shard.first[d])
            found = int(total[shard.first[d + 1]] - total[zero])
            spans = [{"start": x - zero, "end": y - zero} for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]
            out.append((n, found, len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), found > 0 and SHARE * found >= n, spans))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    return by_text(KIND, work, SHARD_CHARS)(text.cast("string"))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """Every row's doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans."""
    rows = docs.select(quoted(key).alias("doc_id"), contamination(spark, quoted(text), benchmark, chars=chars).alias("found"))
    return rows.select("doc_id", "found.*")


ORACLE_SQL = r"""with dw as (select row_number() over () as rid, doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
items as (select item_id, w, least(len(w), 13) as n, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from bw where len(w) > 0),
wins as (select distinct item_id, n, array_to_string(w[i:i+n-1], ' ') as g from items),
sizes as (select distinct n from wins),
grams as (select rid, n, unnest(generate_series(1, len(w) - n + 1)) as i, w from dw, sizes where len(w) >= n),
hits as (select rid, i, grams.n, item_id from (select rid, n, i, array_to_string(w[i:i+n-1], ' ') as g from grams) grams join wins on grams.n = wins.n and grams.g = wins.g),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(generate_series(i, i + n - 1)) as p from hits) group by rid),
found as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from dw left join covered using (rid) left join found using (rid)"""
