"""Straightforward versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def tokens(text):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [sp.bos_id(), *sp.encode(text or ""), sp.eos_id()]
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    seen = Counter(grams)
    repeat = {k + i for k, g in enumerate(grams) if seen[g] > 1 for i in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat), len(w) < 10 or 100 * len(repeat) > 20 * len(w)


def quality_kept(text):
    """The verdict: shares of characters in repeated n-grams and lines, and of symbols."""
    text = text or ""
    w = SPACE_WORD.findall(text)
    chars = sum(map(len, w))
    if quality(text)[5]:
        return False
    for n, limit in {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}.items():
        seen = Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
        inside = {k + i for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for i in range(n)}
        if sum(len(w[k]) for k in inside) / chars > limit:
            return False
    lines = [line for line in text.split("\n") if SPACE_WORD.search(line)]
    again = [line for k, line in enumerate(lines) if line in lines[:k]]
    if len(again) > 0.30 * len(lines) or sum(len(x) for line in again for x in SPACE_WORD.findall(line)) > 0.20 * chars:
        return False
    return sum(text.count(c) for c in "#*$%&|<>") <= 0.10 * len(w)


def fingerprint(text):
    import xxhash

    w = SPACE_WORD.findall(ascii_lower(text or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(prints: dict):
    """id -> smallest id reachable over links of at most three bits."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def contamination(text, items: dict):
    w = BENCH_WORD.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for i, t in items.items():
        own = BENCH_WORD.findall(ascii_lower(t or ""))
        for k in range(max(1, len(own) - 9) if own else 0):
            g = own[k : k + 10]
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    found.add(i)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def repeats(rows: list[tuple]):
    """[(id, text)] -> [(id, bytes, removed, spans, sha of the rest, rest)]; null ids are the largest."""
    order = lambda i: float("inf") if i is None else i
    first: dict[bytes, float] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(order(i), first.get(b[k : k + 50], float("inf")))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < order(i):
                gone[k : k + 50] = [True] * 50
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest(), rest))
    return out
