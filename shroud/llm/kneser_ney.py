"""Interpolated modified Kneser-Ney bigram model in memory-mapped hash arrays (operator 6).

Tokens: ASCII letters lowered, runs of bytes other than ASCII white space, and
one end token per document. Words are 48-bit hashes.

Counting, two shuffles of packed arrays (a row is one array of one shard, so
rows stay few and the work is in numpy):

1. Tasks count the distinct bigrams of a few million tokens at a time and deal
   them to shards by a hash of the whole bigram, so a frequent word spreads
   over all shards. A shard adds its counts up, writes its sorted array, and
   sends what each word contributes (types after it by count, types before it,
   count) to word shards.
2. A word shard adds these up and writes its sorted array. Totals and counts of
   counts come to the driver as one row of sums.

A bigram shard is a sorted array of 32-bit remainders with a table of 2**16
bucket starts; with the shard and bucket bits a key has 48 bits and more, and
the number of shards grows with the input. Arrays lie in the shared folder,
where workers map them into memory for scoring; a repeated task writes the same
file again under its final name.

The order is 2: the trigrams of the check tables alone (some 100 million
distinct ones of 18 bytes in a shuffle and 5 in the model) would need more than
the disk that the whole operator is given.

Defined results: a null text is an empty text, whose only token is the end; a
null doc_id is not held out; repeated rows count as often as they occur; an
empty table gives no rows; with no training rows every token has probability 1
over an empty vocabulary; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm import textscan as ts
from shroud.llm.common import python_workers, shared_path

END, START = np.uint64(1), np.uint64(2)
WORD_BITS = 48
_WORD = np.uint64((1 << WORD_BITS) - 1)
#: Tokens counted at a time by a task, and text bytes per bigram shard.
FLUSH = 4_000_000
SHARD_BYTES = 32 << 20
BUCKET_BITS = 16
#: Files that a scoring worker maps at a time.
MAX_MAPS = 1_024
STATS = ["bigrams1", "bigrams2", "bigrams3", "bigrams4", "types", "words", "tokens", "starts",
         "words1", "words2", "words3", "words4"]


def bigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous words, words, bounds per document) of every token, the end tokens included."""
    raw = ts.lower_ascii(buf)
    s, e, doc = ts.tokens(raw, off)
    h = ts.token_hashes(raw, s, e) & _WORD
    n = len(off) - 1
    count = np.bincount(doc, minlength=n) + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    word = np.empty(bounds[-1], np.uint64)
    word[np.arange(len(h)) + doc] = h
    word[bounds[1:] - 1] = END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[bounds[:-1]] = START
    return before, word, bounds


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ts.mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _pack_words(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].tobytes()


def _unpack_words(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) * 8 // WORD_BITS, 8), np.uint8)
    out[:, : WORD_BITS // 8] = np.frombuffer(b, np.uint8).reshape(-1, WORD_BITS // 8)
    return out.view("<u8").ravel()


def _join(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)


def _split(blob: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<q", blob)
    at, out = 8 * (n + 1), []
    for size in struct.unpack_from(f"<{n}q", blob, 8):
        out.append(blob[at : at + size])
        at += size
    return out


def _small(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x, "<i8").tobytes(), 1)


def _large(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), "<i8")


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])


def _count_pairs(before: np.ndarray, word: np.ndarray, shard_bits: int) -> Iterator[tuple[int, bytes]]:
    key = pair_key(before, word)
    by = np.argsort(key)
    first = _runs(key[by])
    times = np.diff(np.append(first, len(key)))
    at = by[first]
    shard = key[at] >> np.uint64(64 - shard_bits) if shard_bits else np.zeros(len(at), np.uint64)
    by = np.argsort(shard << np.uint64(WORD_BITS) | before[at])  # words before stand together in a shard
    at, times, shard = at[by], times[by], shard[by]
    cuts = np.searchsorted(shard, np.arange((1 << shard_bits) + 1))
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo < hi:
            b = before[at[lo:hi]]
            start = _runs(b)
            yield i, _join([_pack_words(b[start]), _small(np.diff(np.append(start, hi - lo))),
                            _pack_words(word[at[lo:hi]]), _small(times[lo:hi])])


def _load_pairs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, word, times = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for blob in blobs:
        b, runs, w, t = _split(blob)
        before.append(np.repeat(_unpack_words(b), _large(runs)))
        word.append(_unpack_words(w))
        times.append(_large(t))
    return np.concatenate(before), np.concatenate(word), np.concatenate(times)


def _write(path: str, parts: list[bytes]) -> None:
    """Write a file of a task: whole under its final name, or not there."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as f:
        f.write(_join(parts))
    os.replace(temporary, path)


def _sums(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, ascending, and the sums of the columns."""
    by = np.argsort(keys)
    first = _runs(keys[by])
    return keys[by][first], [np.add.reduceat(c[by], first) if len(first) else c[:0] for c in columns]


def _of_counts(c: np.ndarray) -> list[int]:
    n = np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)
    return [int(x) for x in n[1:5]]


def _bigram_shard(shard: int, blobs: list[bytes], folder: str, shard_bits: int, word_bits: int) -> Iterator[tuple]:
    before, word, times = _load_pairs(blobs)
    key = pair_key(before, word)
    by = np.argsort(key)
    first = _runs(key[by])
    times = np.add.reduceat(times[by], first) if len(first) else times
    at = by[first]
    key, before, word = key[at], before[at], word[at]
    bucket = (key >> np.uint64(64 - BUCKET_BITS - shard_bits)) & np.uint64((1 << BUCKET_BITS) - 1)
    rest = ((key >> np.uint64(32 - BUCKET_BITS - shard_bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    starts = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1)).astype("<u4")
    many = np.flatnonzero(times > 254)
    _write(f"{folder}/bigrams/{shard}", [
        starts.tobytes(), rest.tobytes(), np.minimum(times, 255).astype(np.uint8).tobytes(),
        many.astype("<i8").tobytes(), times[many].astype("<i8").tobytes()])
    zero = np.zeros(len(key), np.int64)
    keys, cols = _sums(np.concatenate([before, word]), *[np.concatenate(x) for x in (
        ((times == 1).astype(np.int64), zero), ((times == 2).astype(np.int64), zero),
        ((times > 2).astype(np.int64), zero), (zero, zero + 1), (zero, times))])
    cuts = np.searchsorted(keys >> np.uint64(WORD_BITS - word_bits), np.arange((1 << word_bits) + 1))
    for u, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo < hi:
            yield u, _join([_pack_words(keys[lo:hi]), *[_small(c[lo:hi]) for c in cols]]), None
    started = int(times[before == START].sum())
    yield -1, None, [*_of_counts(times), len(key), 0, int(times.sum()), started, 0, 0, 0, 0]


def _word_shard(u: int, blobs: list[bytes], folder: str) -> list[int]:
    parts = [_split(b) for b in blobs]
    keys = np.concatenate([np.empty(0, np.uint64), *[_unpack_words(p[0]) for p in parts]])
    keys, cols = _sums(keys, *[np.concatenate([np.empty(0, np.int64), *[_large(p[i]) for p in parts]]) for i in range(1, 6)])
    one, two, more, types, count = cols
    _write(f"{folder}/words/{u}", [
        keys.astype("<u8").tobytes(), one.astype("<u4").tobytes(), two.astype("<u4").tobytes(),
        more.astype("<u4").tobytes(), types.astype("<u4").tobytes(), count.astype("<i8").tobytes()])
    return [0, 0, 0, 0, 0, int((count > 0).sum()), 0, 0, *_of_counts(types[types > 0])]


def _shards(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list, list]]:
    """(key, blobs, stats) of every run of equal keys in sorted batches."""
    held, blobs, stats = None, [], []
    for b in batches:
        for k, blob, st in zip(*[b.column(c).to_pylist() for c in (key, "blob", "stats")], strict=True):
            if held is not None and k != held:
                yield held, blobs, stats
                blobs, stats = [], []
            held = k
            if blob is not None:
                blobs.append(blob)
            if st is not None:
                stats.append(st)
    if held is not None:
        yield held, blobs, stats


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


class Model:
    """The arrays of a written model, mapped into memory, and its smoothing constants."""

    def __init__(self, folder: str, shard_bits: int, word_bits: int, stats: dict[str, int], max_maps: int = MAX_MAPS):
        self.folder, self.shard_bits, self.word_bits, self.stats = folder, shard_bits, word_bits, stats
        self.max_maps = max_maps
        self.discount2 = _discounts([stats[f"bigrams{i}"] for i in range(1, 5)])
        self.discount1 = _discounts([stats[f"words{i}"] for i in range(1, 5)])
        self._open: dict[str, list[np.ndarray]] = {}  # least recently used first

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _open={})

    def _arrays(self, name: str, types: list[str]) -> list[np.ndarray]:
        """The arrays of one file; at most ``max_maps`` files are mapped at a time. Every shard has a file, so one that
        is not there is lost, or the folder is not shared: an error, not a shard without words."""
        if name in self._open:
            self._open[name] = self._open.pop(name)
            return self._open[name]
        while len(self._open) >= self.max_maps:
            self._open.pop(next(iter(self._open)))
        whole = np.memmap(f"{self.folder}/{name}", np.uint8, "r")
        n = int(whole[:8].view("<i8")[0])
        sizes = whole[8 : 8 * (n + 1)].view("<i8")
        ends = 8 * (n + 1) + np.cumsum(sizes)
        self._open[name] = [np.frombuffer(whole, t, int(size) // np.dtype(t).itemsize, int(end - size))
                            for t, size, end in zip(types, sizes, ends, strict=True)]
        return self._open[name]

    def bigram_counts(self, key: np.ndarray) -> np.ndarray:
        """Training counts of ascending bigram keys."""
        out = np.zeros(len(key), np.int64)
        shard = key >> np.uint64(64 - self.shard_bits) if self.shard_bits else np.zeros(len(key), np.uint64)
        cuts = np.searchsorted(shard, np.arange((1 << self.shard_bits) + 1))
        for i in range(1 << self.shard_bits):
            lo, hi = int(cuts[i]), int(cuts[i + 1])
            if lo == hi:
                continue
            starts, rest, count, many, times = self._arrays(f"bigrams/{i}", ["<u4", "<u4", "u1", "<i8", "<i8"])
            if not len(rest):
                continue
            k = key[lo:hi]
            bucket = ((k >> np.uint64(64 - BUCKET_BITS - self.shard_bits)) & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)
            want = ((k >> np.uint64(32 - BUCKET_BITS - self.shard_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            a, z = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
            end = z.copy()
            while (open_ := a < z).any():  # binary search of all keys at once
                mid = (a + z) >> 1
                less = rest[np.minimum(mid, len(rest) - 1)] < want
                a = np.where(open_ & less, mid + 1, a)
                z = np.where(open_ & ~less, mid, z)
            hit = (a < end) & (rest[np.minimum(a, len(rest) - 1)] == want)
            got = count[a[hit]].astype(np.int64)
            big = got == 255
            if big.any():
                got[big] = times[np.searchsorted(many, a[hit][big])]
            out[lo:hi][hit] = got
        return out

    def words(self, key: np.ndarray) -> np.ndarray:
        """Rows (followers seen once, twice, more often; types before; count) of ascending words."""
        out = np.zeros((5, len(key)), np.int64)
        cuts = np.searchsorted(key >> np.uint64(WORD_BITS - self.word_bits), np.arange((1 << self.word_bits) + 1))
        for u in range(1 << self.word_bits):
            lo, hi = int(cuts[u]), int(cuts[u + 1])
            found = self._arrays(f"words/{u}", ["<u8", "<u4", "<u4", "<u4", "<u4", "<i8"]) if lo < hi else None
            if found is None or not len(found[0]):
                continue
            at = np.minimum(np.searchsorted(found[0], key[lo:hi]), len(found[0]) - 1)
            hit = found[0][at] == key[lo:hi]
            for row, column in zip(out, found[1:], strict=True):
                row[lo:hi][hit] = column[at[hit]]
        return out

    def score(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 p(word | before), log10 of the base measure, training count) of every token."""
        st = self.stats
        keys, back = np.unique(pair_key(before, word), return_inverse=True)
        pair = self.bigram_counts(keys)[back].astype(np.float64)
        keys, back = np.unique(np.concatenate([before, word]), return_inverse=True)
        rows = self.words(keys)
        b, w = back[: len(before)], back[len(before) :]
        uniform = 1 / (st["words"] + 1)
        types, count = rows[3][w].astype(np.float64), rows[4][w]
        if st["types"]:
            each = (st["words1"], st["words2"], st["words"] - st["words1"] - st["words2"])
            discounts = self.discount1 if any(d * n for d, n in zip(self.discount1, each, strict=True)) else DISCOUNTS
            spare = sum(d * n for d, n in zip(discounts, each, strict=True))
            low = (types - _taken(types, discounts)) / st["types"] + spare / st["types"] * uniform
        else:
            low = np.full(len(word), uniform)
        total = np.where(before == START, st["starts"], rows[4][b]).astype(np.float64)
        seen = total > 0
        safe = np.where(seen, total, 1)
        held = sum(d * rows[i][b] for i, d in enumerate(self.discount2))
        taken = _taken(pair, self.discount2)
        # small or repetitive text can lack a count of counts, and a word before keep nothing for other words
        none = seen & (held <= 0)
        held = np.where(none, sum(d * rows[i][b] for i, d in enumerate(DISCOUNTS)), held)
        taken = np.where(none, _taken(pair, DISCOUNTS), taken)
        p = np.where(seen, (pair - taken) / safe + held / safe * low, low)
        base = np.log10((count + 0.1) / (st["tokens"] + 0.1 * (st["words"] + 1)))
        return np.log10(p), base, count


#: Discounts of counts 1, 2 and 3 or more where those of the counts of counts leave nothing for what was not seen.
DISCOUNTS = (0.5, 0.75, 1.0)


def _discounts(n: list[int]) -> list[float]:
    """The modified discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.0 for i in (1, 2, 3)]


def _taken(count: np.ndarray, discounts: Sequence[float]) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(count, 3).astype(np.int64)]


def mapped_folder(spark, prefix: str) -> str:
    """A fresh folder in the shared place as a local path; workers must be able to map its files."""
    url = urlparse(shared_path(spark, prefix))
    if url.scheme not in ("", "file"):
        raise ValueError("the model's arrays are mapped into memory: pass model_dir, a folder mounted on all workers")
    return url.path


def train(docs: DataFrame, model_dir: str | None = None, shard_bytes: int | None = None, max_maps: int = MAX_MAPS) -> Model:
    """Count ``docs`` (text) and write the model's arrays: about one shard for every ``shard_bytes`` (``SHARD_BYTES``) of text, at most
    2**16 (beyond, shards grow: a shard of 100 TB has 1.5 GB of text). Scoring maps ``max_maps`` files at a time."""
    spark = docs.sparkSession
    python_workers(spark)
    folder = model_dir or mapped_folder(spark, "kneser-ney")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shard_bits = min(BUCKET_BITS, max(3, int(size // (shard_bytes or SHARD_BYTES)).bit_length()))
    word_bits = shard_bits
    # every shard has a file, also one that no bigram or word falls into
    empty = spark.range(1 << shard_bits).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("blob"),
                                                F.lit(None).cast("array<long>").alias("stats"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pairs = _count_pairs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), shard_bits)
                for row in pairs:
                    yield _batch([(*row, None)], ["shard", "blob", "stats"], [pa.int32(), pa.binary(), pa.list_(pa.int64())])

        for b in batches:
            buf, off = ts.text_buffers(b.column("text"))
            for lo, hi in ts.parts(off):
                held.append(bigrams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[:2])
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs, _ in _shards(batches, "shard"):
            for row in _bigram_shard(shard, blobs, folder, shard_bits, word_bits):
                yield _batch([row], ["u", "blob", "stats"], [pa.int32(), pa.binary(), pa.list_(pa.int64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, blobs, stats in _shards(batches, "u"):
            row = _word_shard(u, blobs, folder) if u >= 0 else [int(x) for x in np.sum(stats, axis=0)]
            yield _batch([tuple(row)], STATS, [pa.int64()] * len(STATS))

    row = "blob binary, stats array<long>"
    pairs = docs.select("text").mapInArrow(count, f"shard int, {row}").unionByName(empty)
    # one shard a task: dealt by its number, since hashes of so few numbers would put several together
    parts = pairs.repartitionById(1 << shard_bits, F.col("shard")).sortWithinPartitions("shard").mapInArrow(
        merge, f"u int, {row}")
    words = parts.unionByName(empty.withColumnRenamed("shard", "u"))
    totals = words.repartitionById((1 << word_bits) + 1, F.col("u") + 1).sortWithinPartitions("u").mapInArrow(
        finish, ", ".join(f"{s} long" for s in STATS))
    got = totals.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS]).first()
    return Model(folder, shard_bits, word_bits, got.asDict(), max_maps)


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    python_workers(docs.sparkSession)
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
              "base_score double, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = ts.text_buffers(b.column("text"))
            for lo, hi in ts.parts(off, 4_000_000):
                before, word, bounds = bigrams(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                log_p, base, count = model.score(before, word)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, n).cast(pa.int64()), b.column("held_out").slice(lo, n),
                     pa.array(np.diff(bounds)), pa.array(np.add.reduceat((count > 0).astype(np.int64), bounds[:-1])),
                     pa.array(np.full(n, model.stats["tokens"])), pa.array(np.add.reduceat(base, bounds[:-1])),
                     pa.array(np.add.reduceat(log_p, bounds[:-1]))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, schema)


def held_out_tenth(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))
