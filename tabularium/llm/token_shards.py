"""Token-id shards: raw id payloads with a minimal perfect hash index beside each.

``write_shards`` deals documents into shards in ascending key order, tokenises them and writes two files a shard:

* ``*.ids``: nothing but token ids, little-endian, 2 bytes each if every id fits and 4 otherwise;
* ``*.idx``: a JSON header, then arrays: the record offsets (in ids), the keys in record order, and a minimal perfect
  hash over the distinct keys: for every slot a 32-bit fingerprint of its key, the first record and the number of records.

The hash is a cascade of bit arrays: at each level the keys that are alone in their cell settle there, the others go
on to the next; a key's slot is the number of set cells before its own. A look-up touches a bounded expected number
of levels, then one slot: constant time, however many documents a shard has.

Defined cases: a null or empty text is one end id; a long text is one record, whole; keys are whole numbers (or cast to
them); null keys come first, are stored, and can't be looked up; repeated keys are separate records, ordered by a hash of
their text (equal texts have equal records), and a look-up returns them all; an empty table gives no shards; columns
other than key and text are ignored, whatever they are called.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, filesystem, quoted, shared_dir, slices

MAGIC = b"TBLMTOK1"
#: Cells a key at each level of the cascade.
GAMMA = 2
#: Words whose ids are remembered by a worker; then it begins anew.
CACHE_WORDS = 500_000
#: Most bytes of ids and most records of a shard, whatever its partition holds; a longer record is a shard of its own.
SHARD_BYTES, SHARD_RECORDS = 1 << 28, 1 << 20
MANIFEST = "shard int, piece int, ids_path string, idx_path string, n_docs long, n_tokens long"


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:  # set cells before each byte of the level, over all levels
            counts = np.bitwise_count(bits).astype(np.int64)
            self.before.append(total + np.concatenate(([0], np.cumsum(counts)[:-1])) if len(bits) else np.zeros(0, np.int64))
            total += int(counts.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left):
            cells = max(8, GAMMA * len(left) + 7 & ~7)
            at = (_hash(left, len(levels)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where a key is surely unknown (a known-looking slot still needs its fingerprint checked)."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = (_hash(keys[open_], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            found = (byte >> bit) & 1 == 1
            low = byte[found] & ((np.uint16(1) << bit[found].astype(np.uint16)) - np.uint16(1)).astype(np.uint8)
            out[open_[found]] = self.before[level][at[found] >> 3] + np.bitwise_count(low)
            open_ = open_[~found]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xF1) >> np.uint64(32)).astype(np.uint32)


#: A word of Latin letters and the ASCII punctuation after it; an apostrophe may begin a contraction, so it isn't in here.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """How byte-level models write each byte: printable Latin-1 characters stand for themselves, the others follow from U+0100."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in kept else next(others)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts from ids of words.

    A tokenizer that drops white space and never joins across it gives a text its words' ids, one after the other.
    Texts are cut at ASCII blanks, which every step treats as white space; what lies between goes through the
    tokenizer once for each distinct word. Of these, plain words (letters, then punctuation) go to the model as their
    two pieces, without the general normaliser and splitter. Both shortcuts are tried on probes first; if a tokenizer
    doesn't work that way, its whole ``encode`` is used.
    """

    PROBES = ("Abc, dEf  ghi.\nÉtÀ!! x", "The end***  of\tit&&& ñÑ")

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        self.letters, self.words, self.pieces = _byte_letters(), _Words(self._word), {"": b""}
        self.by_word = self.plain = True
        self.plain = all(self.encode(p) == self._whole(p) for p in self.PROBES)
        self.words, self.pieces = _Words(self._word), {"": b""}
        self.by_word = all(self.encode(p) == self._whole(p) for p in self.PROBES)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if (out := self.pieces.get(piece)) is None:
            written = piece if piece.isascii() else "".join(self.letters[b] for b in piece.encode())
            out = self._bytes([t.id for t in self.tokenizer.model.tokenize(written)])
            if len(piece) <= 100:
                self.pieces[piece] = out
        return out

    def _word(self, word: str) -> bytes:
        if self.plain and (m := _PLAIN.fullmatch(word)):
            return self._piece(m[1].lower()) + self._piece(m[2])
        return self._whole(word)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        if len(self.words) > CACHE_WORDS:
            self.words = _Words(self._word)
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = {"": b""}
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


class _Words(dict):
    """Ids by word, found when first asked for."""

    def __init__(self, find):
        super().__init__({"": b""})
        self.find = find

    def __missing__(self, word: str) -> bytes:
        out = self.find(word)
        if len(word) <= 100:
            self[word] = out
        return out


_TOKENIZERS: dict[tuple[str, str], WordTokenizer] = {}


def tokenizer(path: str, dtype: str) -> WordTokenizer:
    """One for each worker process, with the words that it has seen."""
    if (path, dtype) not in _TOKENIZERS:
        _TOKENIZERS[path, dtype] = WordTokenizer(path, dtype)
    return _TOKENIZERS[path, dtype]


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def _write(uri: str, chunks) -> str:
    """The file appears under its name only when it is complete; a second attempt replaces it by the same bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    context = TaskContext.get()
    part = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, path)
    return uri


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, root: str, *, end_id: int = 1, vocabulary: int = 49_408, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Write the shards below ``root``; return their manifest (a row a shard, kept in the checkpoint folder), in key order.

    Range partitioning by key and a hash of the text deals even one much-repeated key to many shards. A partition begins
    a new shard wherever the bound on bytes or records would be passed, so no index grows with its partition.
    """
    bounded_batches(spark)
    dtype = id_type(vocabulary, end_id)
    end = np.array([end_id], dtype).tobytes()

    def write(batches):
        words, shard = tokenizer(tokenizer_path, dtype), TaskContext.get().partitionId()
        records = ((k, words.encode(t or "") + end) for doc_ids, texts in slices(batches) for k, t in zip(doc_ids, texts))
        ahead = next(records, None)

        def payload(keys: list, lengths: list):
            nonlocal ahead
            size = 0
            while ahead and (not keys or len(keys) < shard_records and size + len(ahead[1]) <= shard_bytes):
                k, ids = ahead
                keys.append(k)
                lengths.append(len(ids) // len(end))
                size += len(ids)
                yield ids
                ahead = next(records, None)

        for piece in count():
            if not ahead:
                return
            keys, lengths, name = [], [], f"{root}/shard-{shard:06d}-{piece:04d}"
            _write(f"{name}.ids", _grouped(payload(keys, lengths)))
            _write(f"{name}.idx", [index_bytes(keys, lengths, dtype)])
            made = {"shard": shard, "piece": piece, "ids_path": f"{name}.ids", "idx_path": f"{name}.idx", "n_docs": len(keys), "n_tokens": sum(lengths)}
            yield pa.RecordBatch.from_pylist([made], schema=pa.schema([("shard", pa.int32()), ("piece", pa.int32()), ("ids_path", pa.string()), ("idx_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    return checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, MANIFEST))


def _grouped(records, size: int = 1 << 20):
    held, n = [], 0
    for x in records:
        held.append(x)
        n += len(x)
        if n >= size:
            yield b"".join(held)
            held, n = [], 0
    yield b"".join(held)


def index_bytes(keys: list, lengths: list[int], dtype: str) -> bytes:
    """The index file of a shard."""
    null = np.array([k is None for k in keys], bool)
    own = np.array([0 if k is None else k for k in keys], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    distinct, first, count = np.unique(own[~null], return_index=True, return_counts=True)
    at = np.flatnonzero(~null)[first] if len(distinct) else np.zeros(0, np.int64)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    prints, record, records = np.zeros(mph.size, np.uint32), np.zeros(mph.size, np.int64), np.zeros(mph.size, np.int64)
    prints[slot], record[slot], records[slot] = fingerprints(distinct), at, count
    arrays = [offsets, own, null.view(np.uint8), prints, record, records, *mph.levels]
    head = json.dumps({"dtype": dtype, "arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in arrays)])


class Shard:
    """A written shard: records in order, or those of a key."""

    def __init__(self, ids_path: str, idx_path: str):
        fs, path = filesystem(idx_path)
        with fs.open_input_file(path) as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{idx_path} is not a token index")
        n = int.from_bytes(data[8:16], "little")
        head, at, arrays = json.loads(data[16 : 16 + n]), 16 + n, []
        for kind, size in head["arrays"]:
            arrays.append(np.frombuffer(data, kind, size, at))
            at += arrays[-1].nbytes
        self.offsets, self.keys, null, self.prints, self.record, self.records, *levels = arrays
        self.null, self.mph, self.dtype = null.view(bool), PerfectHash(levels), np.dtype(head["dtype"])
        fs, path = filesystem(ids_path)
        self.file = fs.open_input_file(path)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids from offset a to b."""
        self.file.seek(int(a) * self.dtype.itemsize)
        return np.frombuffer(self.file.read(int(b - a) * self.dtype.itemsize), self.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; number 0 where the fingerprint says that the key isn't here."""
        keys = np.asarray(keys, np.int64)
        slot = self.mph.slots(keys)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == fingerprints(keys[known])
        known[known] = self.keys[self.record[slot[known]]] == keys[known]
        return np.where(known, self.record[np.where(known, slot, 0)] if self.mph.size else 0, -1), np.where(known, self.records[np.where(known, slot, 0)] if self.mph.size else 0, 0)

    def lookup(self, key: int) -> list[np.ndarray]:
        """The ids of every record of ``key``."""
        (first,), (n,) = self.find(np.array([key]))
        return [self.ids(self.offsets[i], self.offsets[i + 1]) for i in range(first, first + n)]


def read_shards(manifest: DataFrame, chunk_ids: int = 2_000_000) -> DataFrame:
    """Every record of the shards, read from the files: key, start over all shards, number of ids, crc32 of the ids as 4 bytes each.

    Records are reached through the index as a reader would: key to slot to record to offset.
    """

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row["ids_path"], row["idx_path"])
                first, n = s.find(s.keys)
                if (n[~s.null] < 1).any():
                    raise ValueError(f"{row['idx_path']}: a stored key isn't found")
                nth = np.arange(len(s.keys)) - np.where(s.null, np.arange(len(s.keys)), first)
                at = np.where(s.null, np.arange(len(s.keys)), first + nth)
                a = 0
                while a < len(at):
                    b = max(a + 1, int(np.searchsorted(s.offsets, s.offsets[a] + chunk_ids, "right")) - 1)
                    ids = s.ids(s.offsets[a], s.offsets[b]).astype("<u4")
                    view, base = memoryview(ids).cast("B"), int(s.offsets[a])
                    lo, hi = s.offsets[at[a:b]], s.offsets[at[a:b] + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(s.keys[a:b], mask=s.null[a:b]),
                            pa.array(lo + row["start"]),
                            pa.array(hi - lo),
                            pa.array([zlib.crc32(view[4 * (x - base) : 4 * (y - base)]) for x, y in zip(lo.tolist(), hi.tolist())], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = b

    before = F.sum("n_tokens").over(Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1))  # a row a shard
    starts = manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    shards = max(1, manifest.rdd.getNumPartitions())
    return starts.repartition(shards).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, tokenizer_path: str, *, root: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as token shards below ``root`` (by default a new shared folder) and return what is read back."""
    return read_shards(write_shards(spark, docs, tokenizer_path, root or f"{shared_dir(spark)}/tokens", end_id=end_id))
