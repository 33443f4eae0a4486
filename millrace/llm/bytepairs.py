"""Byte-pair encoding by an index of pair occurrences, and decoding.

A task takes the distinct words of its partition (a block of it, if it is large), lays their symbols one after another
and maps every mergeable pair to all positions where it occurs. Ranks that occur are applied in ascending order, each
at all of its positions at once; a merge only looks up the pairs to its left and right, whose positions are added to
the lists of their ranks. Texts then get the ids of their words. The file of the tokenizer says how texts are
normalised and split and which pairs merge; only normalising and splitting are done by the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are encoded together; bounds memory. A longer text is a block of its own.
BLOCK = 1 << 24
#: Chunks that are split together, and what they may hold: ASCII signs and Latin letters.
AT_ONCE = 1000
PLAIN = r"^[\x21-\x7E\x{C0}-\x{24F}]+$"
#: Ids whose spelling is put together at once.
SPELT = 1 << 20


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[0], starts[0] + 1, ... (sizes[0] of them), then those of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class PairIndex:
    """Positions of every mergeable pair in a row of symbols; ``words`` are runs of symbols that never merge across."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, merges: Merges):
        self.symbols, self.merges = symbols.copy(), merges
        n = len(symbols)
        self.alive = np.ones(n, bool)
        self.next, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes[sizes > 0])
        self.next[ends - 1] = -1
        self.before[np.append(0, ends[:-1])[: len(ends)]] = -1
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.flatnonzero(self.next >= 0))

    def _add(self, at: np.ndarray) -> None:
        """Enter the pairs that begin at these positions under their ranks."""
        ranks = self.merges.ranks(self.symbols[at], self.symbols[self.next[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, places in zip(ranks[cuts].tolist(), np.split(at, cuts[1:])):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(places)

    def apply(self) -> None:
        """Apply the ranks that occur, the lowest first, until no pair is left that merges."""
        while self.active:
            rank = heapq.heappop(self.active)
            left, right, made = self.merges.rule(rank)
            at = np.unique(np.concatenate(self.places.pop(rank)))
            at = at[self.alive[at] & (self.symbols[at] == left)]
            after = self.next[at]
            still = after >= 0
            still[still] = self.symbols[after[still]] == right
            at, after = at[still], after[still]
            if left == right and len(at) > 1:  # of pairs that share a symbol every other one, from the left
                chained = np.append(False, after[:-1] == at[1:])
                begin = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                first = (np.arange(len(at)) - begin) % 2 == 0
                at, after = at[first], after[first]
            if len(at) == 0:
                continue
            beyond = self.next[after]
            self.symbols[at] = made
            self.alive[after] = False
            self.next[at] = beyond
            self.before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = self.before[at]
            self._add(np.concatenate([ahead[ahead >= 0], at[beyond >= 0]]))


class Merges:
    """Merge rules by rank. Every rule must be made of symbols of the alphabet or of earlier rules, so that applying
    one rank at all positions gives what merging pair by pair gives."""

    def __init__(self, pairs: list[tuple[str, str]], vocab: dict[str, int]):
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(max(vocab.values(), default=0) + 2, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        later = np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))
        if later.any() or len(np.unique(self.made)) < len(pairs):
            raise ValueError("a merge needs the result of a later one, or two merges give one symbol")
        self.base = np.int64(len(born))
        keys = self.left * self.base + self.right
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], np.iinfo(np.int64).max)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.searchsorted(self.keys, keys)
        found = self.keys[at] == keys
        out = np.full(len(keys), -1, np.int64)
        out[found] = self.order[at[found]]
        return out

    def rule(self, rank: int) -> tuple[int, int, int]:
        return int(self.left[rank]), int(self.right[rank]), int(self.made[rank])


class Codec:
    """A byte-pair tokenizer from its file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        odd = [name for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(name)]
        odd += [t["content"] for t in spec["added_tokens"] if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not supported: {model['type']} {odd}")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(pairs, self.vocab)
        letters = max([ord(s[0]) for s in self.vocab if s] + [0]) + 1
        self.inner, self.last = np.full(letters + 1, -1, np.int64), np.full(letters + 1, -1, np.int64)
        for symbol, number in self.vocab.items():
            if len(symbol) == 1:
                self.inner[ord(symbol)] = number
            if len(symbol) == 1 + len(self.suffix) and symbol.endswith(self.suffix):
                self.last[ord(symbol[0])] = number
        if spec.get("decoder") is None:
            spelt = {i: s.encode() + b" " for s, i in (self.vocab | self.special).items()}
            sizes = np.array([len(spelt.get(i, b"")) for i in range(max(spelt) + 1)], np.int64)
            self.spelling = np.frombuffer(b"".join(spelt.get(i, b"") for i in range(max(spelt) + 1)), np.uint8)
            self.spelt_sizes, self.spelt_starts = sizes, np.cumsum(sizes) - sizes
        else:
            self.spelling = None
        probe = [w for w, _ in self._split("a b\tc\nd")]
        self.drops_space = len(probe) == 4 and probe == [w for part in "abcd" for w, _ in self._split(part)]

    def _split(self, text: str) -> list:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return t.pre_tokenizer.pre_tokenize_str(text) if t.pre_tokenizer else [(text, (0, len(text)))]

    def _parts(self, chunk: str) -> Iterator[str | int]:
        """Words of a chunk, and ids of the special tokens that it names."""
        while chunk:
            found = [(chunk.find(s), -len(s), s) for s in self.special if s and s in chunk]
            if not found:
                break
            at, _, name = min(found)
            yield from (w for w, _ in self._split(chunk[:at]))
            yield self.special[name]
            chunk = chunk[at + len(name) :]
        if chunk:
            yield from (w for w, _ in self._split(chunk))

    def _numbered(self, chunks: pa.Array) -> tuple[dict[str | int, int], np.ndarray, np.ndarray]:
        """Distinct words (and special ids) with their numbers, the numbers of each chunk's, and how many it has.

        Chunks of letters that normalising can't turn into white space are split many at a time, the others alone.
        """
        words: dict[str | int, int] = {}
        of, number = [], []
        plain = pc.match_substring_regex(chunks, PLAIN) if self.drops_space else pa.array(np.zeros(len(chunks), bool))
        for name in self.special:
            plain = pc.and_not(plain, pc.match_substring(chunks, name))
        plain = plain.to_numpy(zero_copy_only=False)
        alone = list(np.flatnonzero(~plain))
        together = np.flatnonzero(plain)
        for low in range(0, len(together), AT_ONCE):
            group = together[low : low + AT_ONCE]
            joined = " ".join(chunks.take(pa.array(group)).to_pylist())
            joined = self.tokenizer.normalizer.normalize_str(joined) if self.tokenizer.normalizer else joined
            sizes = [len(part) + 1 for part in joined.split(" ")]
            if len(sizes) != len(group):
                alone.extend(group)
                continue
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str(joined)
            starts = np.array([start for _, (start, _) in found], np.int64)
            of.append(group[np.searchsorted(np.cumsum(sizes), starts, side="right")])
            number.extend(words.setdefault(w, len(words)) for w, _ in found)
        for k in alone:
            before = len(number)
            number.extend(words.setdefault(w, len(words)) for w in self._parts(chunks[int(k)].as_py()))
            of.append(np.full(len(number) - before, k))
        of, number = np.concatenate([np.zeros(0, np.int64), *of]), np.array(number, np.int64)
        return words, number[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(chunks))

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        points = np.minimum(points, len(self.inner) - 1)
        symbols = self.inner[points]
        ends = np.cumsum(sizes[sizes > 0]) - 1
        symbols[ends] = self.last[points[ends]]
        word = np.repeat(np.arange(len(words)), sizes)[symbols >= 0]  # what the vocabulary lacks is left out
        symbols = symbols[symbols >= 0]
        index = PairIndex(symbols, np.bincount(word, minlength=len(words)), self.merges)
        index.apply()
        return index.symbols[index.alive], np.bincount(word[index.alive], minlength=len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.drops_space:
            chunks = pc.ascii_split_whitespace(texts)
            per_text = pc.list_value_length(chunks).to_numpy().astype(np.int64)
            chunks = chunks.flatten().dictionary_encode()
        else:
            per_text, chunks = np.ones(len(texts), np.int64), texts.dictionary_encode()
        words, parts, counts = self._numbered(chunks.dictionary)
        special = [w for w in words if isinstance(w, int)]
        ids, sizes = self._merged([w if isinstance(w, str) else "" for w in words])
        if special:  # a special token is a word of one id
            at = np.array([words[w] for w in special])
            full = sizes.copy()
            full[at] = 1
            out = np.zeros(int(full.sum()), np.int64)
            starts = np.cumsum(full) - full
            plain = np.ones(len(out), bool)
            plain[starts[at]] = False
            out[plain], out[starts[at]] = ids, special
            ids, sizes = out, full
        starts = np.cumsum(sizes) - sizes
        of_chunk = np.add.reduceat(np.append(sizes[parts], 0), np.minimum(np.cumsum(counts) - counts, len(parts))) * (counts > 0) if len(counts) else counts
        chunk_ids = ids[ragged(starts[parts], sizes[parts])]
        chunk_starts = np.cumsum(of_chunk) - of_chunk
        codes = chunks.indices.to_numpy()
        lengths = of_chunk[codes]
        reach = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        return chunk_ids[ragged(chunk_starts[codes], lengths)].astype("<u4"), np.diff(reach[bounds])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included."""
        if self.spelling is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        out = []
        for low in range(0, len(ids), SPELT):
            some = ids[low : low + SPELT]
            if len(some) and int(some.max()) >= len(self.spelt_sizes):
                some = some[some < len(self.spelt_sizes)]
            out.append(self.spelling[ragged(self.spelt_starts[some], self.spelt_sizes[some])].tobytes())
        return b"".join(out)[:-1].decode()


# ---- tables


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]
    for low, high in zip(cuts[:-1], cuts[1:]):
        if high > low:
            yield batch.slice(low, high - low)


def _encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in _joined(batches):
            codec = codec or Codec(path)
            ids, counts = codec.encode(batch.column(1))
            bounds = np.concatenate([[0], np.cumsum(counts * 4)])
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), packed.cast(pa.binary())], ["id", "n_tokens", "ids"])
            pa.default_memory_pool().release_unused()

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BLOCK`` bytes of text, so that a partition's words meet in few indexes."""
    waiting, held = [], 0
    for batch in batches:
        for part in _blocks(batch, batch.schema.names[1]):
            size = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if waiting and held + size > BLOCK:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, held = [], 0
            if part.num_rows:
                waiting.append(part)
                held += size
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _decoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or Codec(path)
            for part in _blocks(batch, "ids"):
                texts = [None if x is None else codec.decode(np.frombuffer(x, "<u4")) for x in part.column("ids").to_pylist()]
                names = [*part.schema.names, "decoded"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names)
            pa.default_memory_pool().release_unused()

    return run


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: the id, ``n_tokens`` and ``ids``, little-endian unsigned 32-bit numbers in bytes.

    The same ids as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, truncation and padding unused;
    special tokens that a text names are one id each. Null and empty texts have no ids; repeated rows each get a row;
    other columns are ignored. Nothing is shuffled. ``path`` must be there on every executor.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(_encoding(path), f"id {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (with ``ids`` as ``encoded`` gives them) and the text ``decoded`` of ids; null ids give null.

    The same text as ``decode(ids, skip_special_tokens=False)``. Ids unknown to the file are left out.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(_decoding(path), f"{fields}, decoded string")
