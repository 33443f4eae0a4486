"""Brute-force versions of operators that SQL cannot express."""

from __future__ import annotations

import hashlib
import html
import re
import zlib

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, width: int) -> set:
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def near(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, smallest id reachable)."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle: dict = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = set()
    for ids in by_shingle.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(rows: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    """doc_id -> (bytes, removed, spans, sha256 of the rest)."""
    seen: set[bytes] = set()
    out = {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def article(page: str) -> str:
    """Main text of the supplied pages, whose articles are marked."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def edited(rows: list[tuple[int, str | None]]) -> dict[int, str]:
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        cut = len(text) // 3
        out[i] = text[: len(text) - cut] + order[(k + 1) % len(order)][1][:cut]
    return out


def check_packing(pieces: list[dict], rows: list[tuple[int, str | None]], tokenizer, window: int = 2048) -> float:
    """Every id lies in exactly one piece, checksums hold, sequences are gapless; returns the share of padding."""
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    by_doc: dict = {}
    by_sequence: dict = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for doc, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[doc])
            part = ids[doc][at : at + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += p["length"]
        assert at == len(ids[doc])
    room = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        room += at if at & (at - 1) == 0 else window
        total += at
    return 1 - total / room
