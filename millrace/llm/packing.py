"""Packing by lexical retrieval: BM25 neighbours of a seed document fill the seed's window.

Texts are read once: a task turns them into token ids and keeps, for each document, the pieces that fill a window
by themselves, the rest (tail) with the checksums of its prefixes, and its terms. Only these narrow rows move. Tails
are dealt out by their most telling terms, so that related ones meet, and every run of ``SHARD`` tails is indexed and
packed in memory. Document frequencies come from all documents.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrays import SPACE, flat, slices, word_hashes
from millrace.llm.tables import written

WINDOW = 2048
END_ID = 1
END_BYTES = np.array([END_ID], "<u4").tobytes()
#: Tails are cut at multiples of GRAIN tokens only; the checksum of each such prefix is kept.
GRAIN = 16
#: Terms are hashed to so many slots; document frequencies and the shards' indexes are kept by slot.
SLOTS = 1 << 16
#: Tails in one inverted index.
SHARD = 1024
#: Terms of more than this share of documents carry no weight worth a posting.
COMMON = 0.1
K1, B = 1.2, 0.75
#: Bytes that may close a word without being part of its term.
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in ".,;:!?)\"'"]] = True
#: Units of text whose ids a Python worker remembers at most.
REMEMBER = 1_000_000

_TAIL = "doc_id long, start long, length long, doc_tokens long, crcs binary, terms binary, counts binary, n_words long"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ROW = _TAIL + ", ids_crc32 long, sequence_id long"


# ---- token ids


class Encoder:
    """Ids of a byte-level BPE, the same as those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A single space or line feed between two other characters always begins a new word of such a tokenizer, so texts
    are cut there, each distinct unit is encoded once, and up to ``REMEMBER`` units are kept by their 64-bit hash; a
    second hash tells whether it is the same unit, and one that shares only the first is encoded by itself.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers as public
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        back = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        del spec
        self.fast = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(w) for w in ranks]
        self.keys, self.begin, self.size, self.slot = (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        self.second = np.zeros(0, np.uint64)
        self.ids = np.zeros(0, "<u4")

    @functools.cached_property
    def whole(self):
        """The tokenizer itself, loaded only where a text names a special token."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def alone(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Ids of units that begin with white space and don't end with it: where each one's begin, how many, and all of them."""
        sizes = ends - starts
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        joined = data[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])]
        ids = np.array(self.fast.encode_ordinary(joined.tobytes().decode()), "<u4")
        reach = np.concatenate([[0], np.cumsum(self.width[ids])])
        cuts = np.searchsorted(reach, bounds)
        if not np.array_equal(reach[cuts], bounds):
            raise ValueError("a token crosses two units")
        return cuts[:-1], np.diff(cuts), ids

    def _special_texts(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, str]:
        """Texts that name a special token, by number."""
        joined, names = data.tobytes(), [s.encode() for s in self.special]
        if not any(s in joined for s in names):
            return {}
        parts = ((k, joined[low:high]) for k, (low, high) in enumerate(zip(offsets[:-1], offsets[1:])))
        return {k: part.decode() for k, part in parts if any(s in part for s in names)}

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """Ids of all texts of a slice, where each text's begin, the term slot of each unit and its text."""
        n = len(data)
        if n == 0:
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = SPACE[data]
        cut = np.zeros(n, bool)
        cut[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~space[:-2] & ~space[2:]
        edges = offsets[:-1][np.diff(offsets) > 0]
        near = np.concatenate([edges[edges > 0] - 1, edges])  # not across texts
        cut[near] = False
        cut[edges] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        of = np.searchsorted(offsets, starts, side="right") - 1
        keys, second = (word_hashes(data, starts, ends, lower=False, seed=k) for k in (0, 1))
        alone = np.zeros(len(starts), bool)
        alone[np.searchsorted(starts, edges)] = True
        alone |= space[ends - 1]
        special = self._special_texts(data, offsets)
        alone |= np.isin(of, list(special))

        while True:
            values, first, inverse = np.unique(keys[~alone], return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
            known = self.keys[at] == values if len(self.keys) else np.zeros(len(values), bool)
            own = second[~alone]
            other = own != own[first][inverse]
            if len(self.keys):
                other |= (known & (self.second[at] != own[first]))[inverse]
            if not other.any():
                break
            alone[np.flatnonzero(~alone)[other]] = True
        begin, size, slot = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        begin[known], size[known], slot[known] = self.begin[at[known]], self.size[at[known]], self.slot[at[known]]
        pool = self.ids
        if not known.all():
            fresh = first[~known]
            low, high = starts[~alone][fresh], ends[~alone][fresh]
            b, s, ids = self._together(data, low, high)
            begin[~known], size[~known], slot[~known] = b + len(pool), s, self._slots(data, low, high)
            pool = np.concatenate([pool, ids])
            if len(self.keys) + len(fresh) <= REMEMBER:
                merged = np.concatenate([self.keys, values[~known]])
                order = np.argsort(merged, kind="stable")
                self.keys, self.ids = merged[order], pool
                self.second = np.concatenate([self.second, own[fresh]])[order]
                self.begin = np.concatenate([self.begin, begin[~known]])[order]
                self.size = np.concatenate([self.size, size[~known]])[order]
                self.slot = np.concatenate([self.slot, slot[~known]])[order]

        all_begin, all_size, all_slot = (np.zeros(len(starts), np.int64) for _ in range(3))
        all_begin[~alone], all_size[~alone], all_slot[~alone] = begin[inverse], size[inverse], slot[inverse]
        all_slot[alone] = self._slots(data, starts[alone], ends[alone])
        extra, reach = [pool], len(pool)
        done = set()
        for k in np.flatnonzero(alone):
            text = int(of[k])
            if text in special:  # the whole text at its first unit
                ids = np.zeros(0, "<u4") if text in done else self.alone(special[text])
                done.add(text)
            else:
                ids = self.alone(data[starts[k] : ends[k]].tobytes().decode())
            all_begin[k], all_size[k] = reach, len(ids)
            extra.append(ids)
            reach += len(ids)
        pool = np.concatenate(extra)
        bounds = np.concatenate([[0], np.cumsum(all_size)])
        out = pool[np.repeat(all_begin - bounds[:-1], all_size) + np.arange(bounds[-1])]
        return out, bounds[np.searchsorted(of, np.arange(len(offsets)))], all_slot, of

    @staticmethod
    def _slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Term slots of units: lower case, without a leading space and a closing mark; -1 for nothing but these."""
        low = starts + SPACE[data[starts]]
        high = ends - ((ends > low) & MARK[data[ends - 1]])
        slots, order = np.full(len(low), -1), np.argsort(low)
        order = order[high[order] > low[order]]
        slots[order] = (word_hashes(data, low[order], high[order]) & np.uint64(SLOTS - 1)).astype(np.int64)
        return slots


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _tokenised(id_col: str, text_col: str, path: str):
    def run(batches):
        encode = encoder(path).encode
        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, text_col):
                out: dict[str, list] = {n.split()[0]: [] for n in _ROW.split(", ")}
                data, offsets = flat(rows.column(text_col))
                tokens, reach, slots, of = encode(data, offsets)
                bounds = np.searchsorted(of, np.arange(len(offsets)))
                for k, doc in enumerate(rows.column(id_col).to_pylist()):
                    raw = tokens[reach[k] : reach[k + 1]].tobytes() + END_BYTES
                    n = len(raw) // 4
                    whole = n // WINDOW * WINDOW
                    own = slots[bounds[k] : bounds[k + 1]]
                    terms, counts = np.unique(own[own >= 0], return_counts=True)
                    for at in range(0, whole, WINDOW):
                        sequence += 1
                        _add(out, doc, at, WINDOW, n, b"", b"", b"", 0, zlib.crc32(raw[4 * at : 4 * (at + WINDOW)]), 2 * sequence)
                    if whole == n:
                        continue
                    crcs, crc = [], 0
                    for at in range(4 * whole, 4 * n, 4 * GRAIN):
                        crc = zlib.crc32(raw[at : at + 4 * GRAIN], crc)
                        crcs.append(crc)
                    _add(
                        out, doc, whole, n - whole, n, np.array(crcs, "<u4").tobytes(), terms.astype("<u2").tobytes(),
                        counts.astype("<u4").tobytes(), int(counts.sum()), None, None,
                    )
                yield _batch(_ROW, out)

    return run


def _add(out: dict[str, list], *values) -> None:
    for column, value in zip(out.values(), values):
        column.append(value)


def _batch(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


# ---- checksums of parts


@functools.lru_cache(maxsize=64)
def _shift(n_bytes: int) -> tuple[int, ...]:
    """How appending ``n_bytes`` zero bytes changes each bit of a CRC-32 register, as 32 columns."""
    if n_bytes == 1:
        columns = []
        for bit in range(32):
            c = 1 << bit
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            columns.append(c)
        return tuple(columns)
    half = _shift(n_bytes // 2)
    twice = tuple(_times(half, c) for c in half)
    return tuple(_times(_shift(1), c) for c in twice) if n_bytes % 2 else twice


def _times(columns: tuple[int, ...], value: int) -> int:
    out = 0
    while value:
        low = value & -value
        out ^= columns[low.bit_length() - 1]
        value ^= low
    return out


def part_crc(prefix: int, whole: int, n_bytes: int) -> int:
    """CRC-32 of the last ``n_bytes`` of a string from those of the string and of what stands before them."""
    while n_bytes:
        low = n_bytes & -n_bytes
        prefix = _times(_shift(low), prefix)
        n_bytes ^= low
    return whole ^ prefix


# ---- retrieval


def _frequencies(batches):
    seen = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for terms in batch.column("terms"):
            seen[np.frombuffer(terms.as_buffer(), "<u2")] += 1
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some])], names=["slot", "n"])


def _weights(terms, counts, n_words: int, idf: np.ndarray, mean: float) -> np.ndarray:
    tf = np.frombuffer(counts, "<u4").astype(np.float32)
    return idf[np.frombuffer(terms, "<u2")] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_words / mean))


def _keyed(idf: np.ndarray, mean: float):
    """The two terms of most weight, which bring related tails together."""

    def run(batches):
        for batch in batches:
            first, second = [], []
            for terms, counts, n in zip(*(batch.column(c).to_pylist() for c in ("terms", "counts", "n_words"))):
                weight = _weights(terms, counts, n, idf, mean)
                own = np.frombuffer(terms, "<u2")
                top = np.lexsort((own, -weight))[:2]
                first.append(int(own[top[0]]) if len(top) else -1)
                second.append(int(own[top[1]]) if len(top) > 1 else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(second, pa.int32())], names=[*batch.schema.names, "key1", "key2"])

    return run


class Shard:
    """The inverted index of some documents: postings by term slot, with BM25 weights."""

    def __init__(self, rows: list[dict], idf: np.ndarray, mean: float):
        self.terms = [np.frombuffer(r["terms"], "<u2") for r in rows]
        size = [len(t) for t in self.terms]
        flat_terms = np.concatenate(self.terms).astype(np.int64) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([_weights(r["terms"], r["counts"], r["n_words"], idf, mean) for r in rows]) if rows else np.zeros(0, np.float32)
        use = idf[flat_terms] > 0
        docs = np.repeat(np.arange(len(rows)), size)[use]
        order = np.argsort(flat_terms[use], kind="stable")
        self.docs, self.weight = docs[order], weight[use][order]
        self.begin = np.searchsorted(flat_terms[use][order], np.arange(SLOTS + 1))
        self.idf, self.n = idf, len(rows)

    def neighbours(self, seed: int) -> np.ndarray:
        """All documents of the shard by falling BM25 score against the seed's terms; ties in the order of the shard."""
        own = self.terms[seed].astype(np.int64)
        low, size = self.begin[own], self.begin[own + 1] - self.begin[own]
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.docs[at], self.weight[at], self.n)
        return np.argsort(-score, kind="stable")


class _Open:
    """A tail, or what is left of it."""

    def __init__(self, row: dict):
        self.doc, self.start, self.left, self.tokens = row["doc_id"], row["start"], row["length"], row["doc_tokens"]
        self.crcs, self.taken = np.frombuffer(row["crcs"], "<u4"), 0

    def take(self, most: int) -> tuple | None:
        """A piece of at most ``most`` tokens from the front, or none if less than a grain fits."""
        n = self.left if self.left <= most else most // GRAIN * GRAIN
        if n == 0:
            return None
        before = int(self.crcs[self.taken // GRAIN - 1]) if self.taken else 0
        whole = int(self.crcs[(self.taken + n + GRAIN - 1) // GRAIN - 1])
        crc = part_crc(before, whole, 4 * n) if self.taken else whole
        piece = (self.doc, self.start + self.taken, n, crc, self.tokens)
        self.taken, self.left = self.taken + n, self.left - n
        return piece


def pack_shard(rows: list[dict], idf: np.ndarray, mean: float, sequence: int, out: dict[str, list], fill: int):
    """Pack the tails of one shard. Each seed's window takes its unused neighbours, best first; the last may be cut and
    what is left of it seeds the next window. Returns the window that is still open at the end."""
    index = Shard(rows, idf, mean)
    open_, used = [_Open(r) for r in rows], np.zeros(len(rows), bool)
    next_seed = 0

    def put(tail: _Open) -> None:
        nonlocal sequence, fill
        while tail.left:
            piece = tail.take(WINDOW - fill)
            if piece is None or fill == WINDOW:
                sequence, fill = sequence + 1, 0
                continue
            _add(out, *piece, 2 * sequence + 1, fill)
            fill += piece[2]

    seed = None
    while True:
        while next_seed < len(rows) and used[next_seed]:
            next_seed += 1
        if next_seed == len(rows):
            return sequence, fill
        if seed is None:
            seed = next_seed
            used[seed] = True
            put(open_[seed])
        window, last = sequence, seed
        for other in index.neighbours(seed):
            if used[other]:
                continue
            used[other] = True
            put(open_[other])
            last = other
            if sequence != window or WINDOW - fill < GRAIN:
                break
        seed = last if sequence != window and fill else None


def _packed(idf: np.ndarray, mean: float):
    def run(batches):
        sequence, fill, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= SHARD:
                out: dict[str, list] = {n.split()[0]: [] for n in _PIECE.split(", ")}
                sequence, fill = pack_shard(held[:SHARD], idf, mean, sequence, out, fill)
                held = held[SHARD:]
                yield _batch(_PIECE, out)
        if held:
            out = {n.split()[0]: [] for n in _PIECE.split(", ")}
            pack_shard(held, idf, mean, sequence, out, fill)
            yield _batch(_PIECE, out)

    return run


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shards_each: int = 8) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens.

    Returns per piece: ``doc_id``, ``start`` and ``length`` in its document's ids, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` and ``offset`` there. A document's whole windows stand alone. The tails of all documents are
    packed shard by shard: a seed queries the shard's BM25 index with all its terms, and its unused neighbours, best
    first, fill the window; the last is cut to fit and its rest seeds the next window. Only windows left over at the
    end of a task, and a few tokens less than GRAIN, are padding. Null and empty texts are the closing id alone; rows
    that repeat are packed each; ties go by id. ``tokenizer`` is the path of a byte-level BPE file.
    """
    rows = written(docs.select(id_col, text_col).mapInArrow(_tokenised(id_col, text_col, tokenizer), _ROW), "tokens")
    tails = rows.where("sequence_id is null")
    seen = tails.agg(F.count("*").alias("n"), F.avg("n_words").alias("mean")).first()
    df = np.zeros(SLOTS)
    for slot, n in tails.select("terms").mapInArrow(_frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        df[slot] = n  # SLOTS rows at most
    idf = np.log1p((seen.n - df + 0.5) / (df + 0.5)).astype(np.float32)
    idf[df > max(COMMON * seen.n, 2)] = 0
    mean = max(float(seen.mean or 0), 1.0)
    keyed = tails.select(*[f.split()[0] for f in _TAIL.split(", ")]).mapInArrow(_keyed(idf, mean), _TAIL + ", key1 int, key2 int")
    order = ["key1", "key2", "doc_id", "start"]
    dealt = keyed.repartitionByRange(max(1, math.ceil(seen.n / (SHARD * shards_each))), *order).sortWithinPartitions(*order)
    whole = rows.where("sequence_id is not null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset")
    )
    return whole.unionByName(dealt.drop("key1", "key2").mapInArrow(_packed(idf, mean), _PIECE)).withColumnRenamed("doc_id", id_col)
