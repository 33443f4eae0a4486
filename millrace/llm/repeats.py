"""Passages that repeat: blockwise ranking of suffixes with a cover sample.

Two equal strings of ``LENGTH`` bytes at places p and q hold sampled places at one and the same distance from their
starts, wherever they lie. The cover sample here goes by content: of the ``SHORT``-byte strings in a window the one with
the smallest hash is sampled, so all windows that share a sampled place form a run, and equal windows lie in runs with
equal sampled strings. Runs are ranked first, one suffix bucket at a time. Where all runs of a sampled string are equal
as a whole, the earliest is original and the others repeat it. Only where runs differ (long ties) are their windows
ranked at full depth, again one bucket at a time. For each bucket a fragment of the corpus sends one block of hashes in
a fixed order and gets back one bit for each, so that neither texts nor places travel, and a task holds one bucket or one
fragment in memory.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import SPAN, flat, hash_of, mixed, powers, prefix_hashes

LENGTH = 100
#: Length of the sampled strings; a window holds REACH of them.
SHORT = 36
REACH = LENGTH - SHORT + 1
FRAGMENT, BUCKET = 8 << 20, 8 << 20
_KEY_BYTES = 5

_PLACE_BITS = np.uint64(21)
_PLACE = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)

_BLOCKS = "bucket long, frag long, keys binary, hashes binary, doc_ids binary, runs binary"
_BITS = "frag long, kind int, bucket long, bits binary, n long"


class _Fragment:
    """The texts of a fragment in order of id, as one run of bytes."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.data, self.offsets = flat(table.column("text").take(pa.array(order)))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window of each run, the hash of its sampled string and that of all it covers."""
        parts: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.uint64, np.uint64)]
        for low in range(0, len(self.data) - LENGTH + 1, SPAN):
            piece = self.data[low : low + SPAN + LENGTH - 1]
            n = len(piece) - LENGTH + 1
            sums = prefix_hashes(piece)
            short = mixed((sums[SHORT:] - sums[:-SHORT]) * powers(len(sums))[1][: len(sums) - SHORT])
            least = (short & ~_PLACE) | np.arange(len(short), dtype=np.uint64)
            width = 1
            while width * 2 <= REACH:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < REACH:
                least = np.minimum(least[:n], least[REACH - width :])
            place = (least & _PLACE).astype(np.int64)
            crossing = np.zeros(n + 1, np.int32)  # windows that start in one text and end in another
            ends = self.offsets[1:-1]
            ends = ends[(ends > low) & (ends < low + n + LENGTH)] - low
            np.add.at(crossing, np.maximum(ends - LENGTH + 1, 0), 1)
            np.add.at(crossing, np.minimum(ends, n), -1)
            inside = np.cumsum(crossing[:-1]) == 0
            change = np.concatenate([[True], (place[1:] != place[:-1]) | ~inside[:-1] | ~inside[1:], [True]])
            first, last = np.flatnonzero(change[:-1] & inside), np.flatnonzero(change[1:] & inside)
            for part, values in zip(parts, (first + low, last + low, short[place[first]], hash_of(sums, first, last + LENGTH))):
                part.append(values)
        return tuple(np.concatenate(p) for p in parts)

    def windows(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of some runs, and the hashes of these windows."""
        size = last - first + 1
        starts = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        hashes = np.zeros(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            to, low = int(np.searchsorted(starts, starts[at] + SPAN)), starts[at]
            sums = prefix_hashes(self.data[low : starts[to - 1] + LENGTH])
            hashes[at:to] = hash_of(sums, starts[at:to] - low, starts[at:to] - low + LENGTH)
            at = to
        return starts, hashes

    def distinct(self, starts: np.ndarray, hashes: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct hash stands first, its text and bucket, in order of bucket and text."""
        first = np.unique(hashes, return_index=True)[1]
        text = np.searchsorted(self.offsets, starts[first], side="right") - 1
        order = np.lexsort((text, buckets[first]))
        return first[order], text[order], buckets[first][order]

    def blocks(self, frag: int, first, text, bucket, hashes, keys=None) -> pa.Table:
        """What is sent to the buckets: hashes in order, and which document each came from."""
        own, low = np.unique(bucket, return_index=True)
        columns: dict[str, list] = {"keys": [], "hashes": [], "doc_ids": [], "runs": []}
        for a, b in zip(low, np.append(low[1:], len(first))):
            some, n = np.unique(text[a:b], return_counts=True)
            if keys is not None:
                narrow = (keys[first[a:b]] >> np.uint64(64 - 8 * _KEY_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)
            columns["keys"].append(b"" if keys is None else narrow[:, :_KEY_BYTES].tobytes())
            columns["hashes"].append(hashes[first[a:b]].astype("<u8").tobytes())
            columns["doc_ids"].append(self.ids[some].astype("<i8").tobytes())
            columns["runs"].append(n.astype("<u4").tobytes())
        return _table(_BLOCKS, bucket=own.astype(np.int64), frag=[frag] * len(own), **columns)

    def open_runs(self, buckets: int, replies: dict[int, dict[int, np.ndarray]]):
        """Runs with what came back for them: whether their windows must be ranked, and whether they repeat as a whole."""
        first, last, keys, hashes = self.runs()
        at, _, _ = self.distinct(first, hashes, (keys & np.uint64(buckets - 1)).astype(np.int64))
        differ, later = np.zeros(len(first), bool), np.ones(len(first), bool)
        differ[at], later[at] = _in_order(replies[0], len(at)), _in_order(replies[1], len(at))
        known, inverse = np.unique(hashes, return_inverse=True)
        of_hash = np.zeros(len(known), bool)
        of_hash[inverse[at]] = differ[at]
        return first, last, of_hash[inverse], later


def _in_order(replies: dict[int, np.ndarray], n: int) -> np.ndarray:
    bits = [replies[k] for k in sorted(replies)]
    joined = np.concatenate(bits) if bits else np.zeros(0, bool)
    if len(joined) != n:
        raise ValueError(f"{len(joined)} bits came back for {n} hashes")
    return joined


def _replies(table: pa.Table) -> dict[int, dict[int, np.ndarray]]:
    out: dict[int, dict[int, np.ndarray]] = {0: {}, 1: {}, 2: {}}
    for kind, bucket, bits, n in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "bits", "n"))):
        out[kind][bucket] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def _table(schema: str, **columns) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({n: pa.array(columns[n], kinds[k]) for n, k in fields})


def _send_runs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        fragment = _Fragment(table)
        first, _, keys, hashes = fragment.runs()
        return fragment.blocks(table.column("frag")[0].as_py(), *fragment.distinct(first, hashes, (keys & np.uint64(buckets - 1)).astype(np.int64)), hashes, keys)

    return run


def _received(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of all blocks of a bucket: their sizes, hashes and document ids."""
    blobs = [np.frombuffer(b.as_buffer(), "<u8") for b in table.column("hashes")]
    ids = [np.repeat(np.frombuffer(d.as_buffer(), "<i8"), np.frombuffer(r.as_buffer(), "<u4")) for d, r in zip(table.column("doc_ids"), table.column("runs"))]
    return [len(b) for b in blobs], np.concatenate(blobs), np.concatenate(ids)


def _answer_runs(table: pa.Table) -> pa.Table:
    """Sampled strings of a bucket whose runs differ, and runs that stand in another fragment's text of smaller id too."""
    sizes, hashes, ids = _received(table)
    wide = np.zeros((len(hashes), 8), np.uint8)
    wide[:, :_KEY_BYTES] = np.concatenate([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("keys")]).reshape(-1, _KEY_BYTES)
    keys = wide.view("<u8")[:, 0]
    order = np.lexsort((ids, hashes, keys))
    key, value = keys[order], hashes[order]
    same_key, same = key[1:] == key[:-1], value[1:] == value[:-1]
    later, differ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same_key & same]] = True
    group = np.concatenate([[0], np.cumsum(~same_key)])
    differ[order] = np.bincount(group[1:], same_key & ~same, group[-1] + 1)[group] > 0
    return pa.concat_tables([_answer(table, differ, sizes, 0), _answer(table, later, sizes, 1)])


def _answer(table: pa.Table, bits: np.ndarray, sizes: list[int], kind: int) -> pa.Table:
    ends = np.cumsum(sizes)
    packed = [np.packbits(bits[e - s : e]).tobytes() for s, e in zip(sizes, ends)]
    return _table(_BITS, frag=table.column("frag").to_pylist(), kind=[kind] * len(sizes), bucket=table.column("bucket").to_pylist(), bits=packed, n=sizes)


def _send_windows(buckets: int):
    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        if texts.num_rows == 0:
            return _table(_BLOCKS, bucket=[], frag=[], keys=[], hashes=[], doc_ids=[], runs=[])
        fragment = _Fragment(texts)
        first, last, differ, _ = fragment.open_runs(buckets, _replies(bits))
        starts, hashes = fragment.windows(first[differ], last[differ])
        return fragment.blocks(texts.column("frag")[0].as_py(), *fragment.distinct(starts, hashes, (hashes & np.uint64(buckets - 1)).astype(np.int64)), hashes)

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """Which windows of a bucket also stand in another fragment's text of smaller id."""
    sizes, hashes, ids = _received(table)
    order = np.lexsort((ids, hashes))
    later = np.zeros(len(hashes), bool)
    later[order[1:][hashes[order[1:]] == hashes[order[:-1]]]] = True
    return _answer(table, later, sizes, 2)


def _remove(buckets: int, texts_too: bool):
    def run(texts: pa.Table, bits: pa.Table) -> pa.Table:
        names = ["id", "n_bytes", "n_removed", "spans", "kept_sha256"] + ["kept"] * texts_too
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.binary()]
        rows: list[list] = [[] for _ in names]
        if texts.num_rows:
            fragment, replies = _Fragment(texts), _replies(bits)
            first, last, differ, later = fragment.open_runs(buckets, replies)
            edge = np.zeros(len(fragment.data) + 1, np.int32)
            whole = later & ~differ
            np.add.at(edge, first[whole], 1)
            np.add.at(edge, last[whole] + LENGTH, -1)
            starts, hashes = fragment.windows(first[differ], last[differ])
            at, _, _ = fragment.distinct(starts, hashes, (hashes & np.uint64(buckets - 1)).astype(np.int64))
            repeated = np.ones(len(starts), bool)
            repeated[at] = _in_order(replies[2], len(at))
            np.add.at(edge, starts[repeated], 1)
            np.add.at(edge, starts[repeated] + LENGTH, -1)
            gone = np.cumsum(edge)[:-1] > 0
            for k, (low, high) in enumerate(zip(fragment.offsets[:-1], fragment.offsets[1:])):
                own = gone[low:high]
                step = np.diff(own.astype(np.int8), prepend=0, append=0)
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                kept = fragment.data[low:high][~own].tobytes()
                row = [int(fragment.ids[k]), int(high - low), int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept]
                for column, value in zip(rows, row):
                    column.append(value)
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, rows, kinds)})

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """Bytes covered by a 100-byte string that also starts earlier (a smaller id, or earlier in the same text).

    Returns id, ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs, start and end in bytes), ``kept_sha256``
    and, if asked for, ``kept`` (the remaining bytes; a cut may split a character). Strings never cross texts and are
    judged on the input. Null counts as empty; texts shorter than 100 bytes keep everything; ids are unique. Strings
    are compared by 64-bit hashes: of n different strings, n^2 / 2^65 pairs are expected to be mixed up.
    """
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    frags = max(1, math.ceil(size / FRAGMENT))
    buckets = 1 << max(0, math.ceil(math.log2(max(1, size * 2 / REACH * 16 / BUCKET))))
    texts = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(frags)).alias("frag"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")
    )
    runs = texts.groupBy("frag").applyInArrow(_send_runs(buckets), _BLOCKS)
    run_bits = runs.groupBy("bucket").applyInArrow(_answer_runs, _BITS)
    windows = texts.groupBy("frag").cogroup(run_bits.groupBy("frag")).applyInArrow(_send_windows(buckets), _BLOCKS)
    full_bits = windows.groupBy("bucket").applyInArrow(_answer_windows, _BITS)
    kept = ", kept binary" if kept_text else ""
    out = (
        texts.groupBy("frag")
        .cogroup(run_bits.unionByName(full_bits).groupBy("frag"))
        .applyInArrow(
            _remove(buckets, kept_text), f"id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string{kept}"
        )
    )
    return out.withColumnRenamed("id", id_col)
