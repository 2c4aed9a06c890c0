"""Operator 6: bytes that repeat from documents with smaller ids, by sorting suffixes.

A byte goes if a 50-byte string over it also starts in a document with a smaller id. Sorting every
suffix of the corpus over the network moves a row for each byte many times (README has figures), so
suffixes are first routed by content: of the 31 20-byte grams of a 50-byte window the one with the
least hash is its anchor, the same wherever the window stands. Neighbouring windows with one anchor
form a run; there is a run for about 16 bytes.

1. Runs are dealt by anchor. A run whose whole string also is a run of a smaller document is
   decided; a run whose anchor no smaller document has is unique.
2. What is left, runs at the ends of repeated passages, comes together as strings by anchor, so
   equal windows meet. There the suffixes are sorted with a difference cover (``difference_cover``:
   sampled triples sorted, recursion on their names, the remaining suffixes merged in), and windows
   next to each other are compared byte by byte. A few anchors are taken at a time; the windows of one
   with very many strings are sorted for each place of the anchor.
3. Decisions go back by document, which cuts its text.

Texts around a passage that very many documents share give its first and last anchors a different
string in each document. Such anchors, told by a bounded sample that decides nothing else, are hot:
their windows are dealt one by one, by hash, so that no part gets all documents of an anchor, and
equal ones of one task are combined before.

Runs travel packed: columns of a few bytes, planes apart, compressed. Equal runs of one task are
combined before they are shuffled, so a passage that a third of all documents share sends one run
for each task to its anchor's part, not one for each document.

Defined results: null and empty texts, and texts under 50 bytes, keep all they have; a null id
counts as larger than all others; rows with the same id do not remove each other's bytes; rows stay.
Text cut inside a character is decoded without the broken rest of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, materialize, release
from .difference_cover import equal_windows
from .hashing import TABLE, Hasher, mix, powers

K = 50
GRAM = 20
#: Bytes of text worked on at once; a longer document is cut into pieces that overlap.
PIECE = 1 << 20
#: Runs that a task packs together.
PACK = 400_000
#: Bytes of strings whose suffixes are sorted together.
SORTED = 1 << 19
#: Parts by anchor and by document for each partition of the input.
PARTS = 4

#: Documents of the sample that tells hot anchors, distinct strings there that make one hot, hot anchors at most.
SAMPLE, HOT, MOST_HOT = 4_000, 64, 50_000

_LAST = np.iinfo(np.int64).max
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces of text laid end to end: first window, further windows, anchor and string of each run."""
    n = len(data)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < K:
        return none
    power, inverse = powers(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(TABLE[data] * power[:n], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    least = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)  # of equal hashes the leftmost
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[:-15], least[15:])  # 16 + 15 = 31 places
    inside = np.repeat(np.cumsum(sizes), sizes)[: len(least)] - np.arange(len(least)) >= K
    window = np.flatnonzero(inside)
    if not len(window):
        return none
    anchor = (least[window] & _LOW).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)) + 1
    first, last = window[np.concatenate([[0], cut])], window[np.concatenate([cut - 1, [len(window) - 1]])]
    anchor = anchor[np.concatenate([[0], cut])]
    more = last - first
    shape = ((anchor - first).astype(np.uint64) << np.uint64(8)) | more.astype(np.uint64)
    whole = mix(((sums[last + K] - sums[first]) * inverse[first]) ^ mix(shape + np.uint64(1)))
    return first, more, mix(gram[anchor] ^ np.uint64(0x5851F42D4C957F2D)), whole


def windows_of(data: np.ndarray, first: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, ...]:
    """For runs of windows: the run of each window, its place in the run and the hash of its bytes."""
    count = more + 1
    of = np.repeat(np.arange(len(first)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = first[of] + place
    return of, place, mix(Hasher(data)(start, start + K))


def joined_windows(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as spans (row, start, stop): those of a row that follow each other are one."""
    by = np.lexsort((start, row))
    row, start = row[by], start[by]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(row))[: len(at)] - 1
    return row[at], start[at], start[last] + K


def lean(work):
    """``work`` over a group, after which its memory goes back to the system: workers live on."""
    if work.__code__.co_argcount == 1:

        def one(table: pa.Table) -> pa.Table:
            out = work(table)
            release()
            return out

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = work(left, right)
        release()
        return out

    return two


def pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of integers as planes of their lowest bytes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a.astype("<i8" if a.dtype.kind == "i" else "<u8")).view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for a, w in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blobs: list[bytes], widths: tuple[int, ...]) -> list[np.ndarray]:
    import zstandard

    d = zstandard.ZstdDecompressor()
    got: list[list[np.ndarray]] = [[] for _ in widths]
    for b in blobs:
        raw = np.frombuffer(d.decompress(b), np.uint8)
        n, at = len(raw) // sum(widths), 0
        for k, w in enumerate(widths):
            col = np.zeros((n, 8), np.uint8)
            col[:, :w] = raw[at : at + n * w].reshape(w, n).T
            got[k].append(col.view("<u8").ravel())
            at += n * w
    return [np.concatenate(g) if g else np.zeros(0, np.uint64) for g in got]


def dealt(part: np.ndarray):
    """(part, indices) for each value of ``part``, in order."""
    if len(part):
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        for idx in np.split(order, cut):
            yield int(part[idx[0]]), idx


def part_of(hashed: np.ndarray, parts: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


#: A prime, so that rows whose numbers follow a pattern still spread over all parts.
_PRIME = 1_000_003


def _by_row(row: np.ndarray, parts: int) -> np.ndarray:
    return np.mod(row, _PRIME) % parts


def _binary(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow column, nulls being empty."""
    col = col.fill_null(b"")
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and len(col.buffers()[2]) else np.zeros(0, np.uint8)
    return data, off


# Widths of the packed columns. Rows and order are 8 bytes of which most planes are empty.
RUN = (5, 7, 8, 8, 6, 1)  # anchor, string, row, order, start, further windows
WINDOW = (5, 8, 8, 8, 6)  # anchor, hash, row, order, start
SPAN = (8, 6, 6, 4, 1)  # row, start, stop, anchor's part, decided
PLACE = (8, 8, 6, 1)  # row, order, start, length


def least_of(a: np.ndarray, c: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The least order among those with the same ``a`` and ``c``."""
    by = np.lexsort((order, c, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[by][1:] != a[by][:-1]) | (c[by][1:] != c[by][:-1])
    least = np.empty(len(a), np.int64)
    least[by] = order[by][new][np.cumsum(new) - 1]
    return least


def _pieces(col):
    """Text of a batch, a megabyte at a time: (bytes, sizes of the pieces laid end to end, document of each, from)."""
    data, off = _binary(col)
    # consecutive pieces of a document share K - 1 bytes
    doc, lo = [], []
    for k, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        if e - s >= K:
            at = range(s, e - K + 1, PIECE)
            doc += [k] * len(at)
            lo += at
    doc, lo = np.array(doc, np.int64), np.array(lo, np.int64)
    hi = np.minimum(lo + PIECE + K - 1, off[1:][doc] if len(doc) else 0)
    for s, e in blocks(hi - lo, PIECE):
        text = np.concatenate([data[x:y] for x, y in zip(lo[s:e].tolist(), hi[s:e].tolist(), strict=True)])
        yield text, hi[s:e] - lo[s:e], doc[s:e], (lo - off[doc])[s:e]


def hot_anchors(rows: DataFrame, n: int) -> np.ndarray:
    """Anchors with many different strings in a sample of the documents, sorted."""

    def pairs(batches):
        for batch in batches:
            for text, sizes, _, _ in _pieces(batch.column(0)):
                _, _, anchor, whole = runs(text, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))], ["a", "c"])

    share = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))
    found = rows.where(share).select("text").mapInArrow(pairs, "a long, c long").distinct().groupBy("a").count().where(F.col("count") >= HOT)
    hot = found.orderBy(F.col("count").desc(), "a").limit(MOST_HOT).collect()
    return np.sort(np.array([r.a for r in hot], np.int64).view(np.uint64))


def _anchors(parts: int, hot: np.ndarray):
    """Texts -> packed runs by anchor, windows of hot anchors by hash, and what another document of the same task decides."""

    def spans(out, row, start, stop):
        for p, i in dealt(_by_row(row, parts)):
            zero = np.zeros(len(i), np.int64)
            out.append((p, 1, pack((row[i], 8), (start[i], 6), (stop[i], 6), (zero, 4), (zero + 1, 1))))

    def flush(held, held_hot):
        out: list[tuple[int, int, bytes]] = []
        if held:
            a, c, row, order, start, more = (np.concatenate(x) for x in zip(*held, strict=True))
            decided = order > least_of(a, c, order)
            own = np.flatnonzero(~decided)
            for p, i in dealt(part_of(a[own], parts)):
                i = own[i]
                out.append((p, 0, pack((a[i], 5), (c[i], 7), (row[i], 8), (order[i], 8), (start[i], 6), (more[i], 1))))
            spans(out, row[decided], start[decided], (start + more + K)[decided])
        if held_hot:
            a, w, row, order, start = (np.concatenate(x) for x in zip(*held_hot, strict=True))
            decided = order > least_of(a, w, order)
            own = np.flatnonzero(~decided)
            for p, i in dealt(part_of(w[own], parts)):
                i = own[i]
                out.append((p, 2, pack((a[i], 5), (w[i], 8), (row[i], 8), (order[i], 8), (start[i], 6))))
            spans(out, *joined_windows(row[decided], start[decided]))
        rows, kinds, blobs = zip(*out, strict=True) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])

    def work(batches):
        held, held_hot, count = [], [], 0
        for batch in batches:
            row, order = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, sizes, doc, lo in _pieces(batch.column(2)):
                first, more, anchor, whole = runs(text, sizes)
                begin = np.cumsum(sizes) - sizes
                piece = np.searchsorted(begin, first, "right") - 1
                of, start = doc[piece], first - begin[piece] + lo[piece]
                cool = np.ones(len(first), bool)
                if len(hot):
                    cool = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] != anchor
                    warm = np.flatnonzero(~cool)
                    if len(warm):
                        k, place, w = windows_of(text, first[warm], more[warm])
                        k = warm[k]
                        held_hot.append((anchor[k], w, row[of[k]], order[of[k]], start[k] + place))
                        count += len(k)
                held.append((anchor[cool], whole[cool] & np.uint64(0xFFFFFFFFFFFFFF), row[of[cool]], order[of[cool]], start[cool], more[cool]))
                count += int(cool.sum())
                if count >= PACK:
                    yield flush(held, held_hot)
                    held, held_hot, count = [], [], 0
        if held:
            yield flush(held, held_hot)
        del held, held_hot
        release()

    return work


def _decide(parts: int):
    """Runs of one part by anchor -> packed spans by row: decided, or to be compared as strings."""

    def work(table: pa.Table) -> pa.Table:
        here = table.column("part")[0].as_py()
        kind, blob = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        a, c, row, order, start, more = unpack([b for k, b in zip(kind, blob, strict=True) if k == 0], RUN)
        row, order, start, more = (x.view(np.int64) for x in (row, order, start, more))
        by = np.lexsort((c, a))
        a, c, row, order, start, more = (x[by] for x in (a, c, row, order, start, more))
        out = [[x.view(np.int64) for x in unpack([b for k, b in zip(kind, blob, strict=True) if k == 1], SPAN)]]
        wa, w, w_row, w_order, w_start = unpack([b for k, b in zip(kind, blob, strict=True) if k == 2], WINDOW)
        if len(w):
            w_row, w_order, w_start = (x.view(np.int64) for x in (w_row, w_order, w_start))
            hit = w_order > least_of(wa, w, w_order)
            r, b, e = joined_windows(w_row[hit], w_start[hit])
            out.append([r, b, e, np.full(len(r), here), np.ones(len(r), np.int64)])
        if len(a):
            new_a = np.concatenate([[True], a[1:] != a[:-1]])
            new_c = new_a | np.concatenate([[True], c[1:] != c[:-1]])
            of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
            least_a, least_c = (np.minimum.reduceat(order, np.flatnonzero(x)) for x in (new_a, new_c))
            decided = order > least_c[of_c]
            asks = ~decided & (order > least_a[of_a])
            open_ = ~decided & np.maximum.reduceat(asks, np.flatnonzero(new_a))[of_a]
            i = np.flatnonzero(decided | open_)
            out.append([row[i], start[i], start[i] + more[i] + K, np.full(len(i), here), decided[i].astype(np.int64)])
        row, start, stop, part, decided = (np.concatenate(x) for x in zip(*out, strict=True))
        rows, blobs = [], []
        for p, i in dealt(_by_row(row, parts)):
            i = i[np.lexsort((start[i], row[i]))]
            rows.append(p), blobs.append(pack((row[i], 8), (start[i], 6), (stop[i], 6), (part[i], 4), (decided[i], 1)))
        return pa.table({"part": pa.array(rows, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return lean(work)


def _spans(blobs: list[bytes]) -> dict[int, np.ndarray]:
    """Row -> its (start, stop, part, decided) lines."""
    row, *rest = (x.view(np.int64) for x in unpack(blobs, SPAN))
    lines = np.stack(rest, 1) if len(row) else np.zeros((0, 4), np.int64)
    return {int(row[i[0]]): lines[i] for _, i in dealt(row)}


def cut(text: bytes, lines: np.ndarray) -> tuple[bytes, np.ndarray]:
    """What is left without the spans (start, stop), and their maximal runs."""
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, lines[:, 0], 1)
    np.add.at(depth, lines[:, 1], -1)
    gone = np.cumsum(depth[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), edges.reshape(-1, 2)


DONE = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept string"


def _finished(text: bytes, lines: np.ndarray | None, want_text: bool) -> tuple:
    left, gone = (text, ()) if lines is None or not len(lines) else cut(text, lines)
    return len(text), len(text) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [{"start": int(a), "stop": int(b)} for a, b in gone], left.decode("utf-8", "ignore") if want_text else None


_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _half(id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("kind", pa.int32()), ("part", pa.int32()), ("row", pa.int64()), ("id", id_type), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
        ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPAN_TYPE), ("kept", pa.string()), ("blob", pa.binary()), ("lines", pa.binary()),
    ])


def _deal(parts: int):
    """Rows -> packs of rows by part: Arrow streams, compressed, as texts of many rows shrink better together."""

    def work(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            places, blobs = [], []
            for p, i in dealt(_by_row(batch.column("row").to_numpy(), parts)):
                own = batch.take(pa.array(i))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                    out.write_batch(own)
                places.append(p), blobs.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(blobs, pa.binary())], ["part", "docs"])
        release()

    return work


def _apply(want_text: bool, schema: pa.Schema):
    """Texts and spans of one part by row -> finished rows (0), rows that wait (1), strings to compare (2)."""
    import zstandard

    def work(docs: pa.Table, spans: pa.Table) -> pa.Table:
        lines = _spans(spans.column("blob").to_pylist())
        press = zstandard.ZstdCompressor(level=1)
        out: list[dict] = []
        strings: dict[int, list] = {}
        done: set[int] = set()
        part = docs.column("part")[0].as_py() if docs.num_rows else 0
        rows = (r for pack in docs.column("docs") for r in pa.ipc.open_stream(pack.as_buffer()).read_all().select(["row", "order", "id", "text"]).to_pylist())
        for row, order, oid, text in (r.values() for r in rows):
            text = text or b""
            own = lines.get(row)
            if own is None or (own[:, 3] == 1).all():
                n, r, s, sha, sp, kept = _finished(text, own, want_text)
                out.append({"kind": 0, "part": part, "row": row, "id": oid, "n_bytes": n, "n_removed": r, "n_spans": s, "kept_sha256": sha, "spans": sp, "kept": kept})
                continue
            keep = own[own[:, 3] == 1, :2]
            out.append({"kind": 1, "part": part, "row": row, "id": oid, "blob": press.compress(text), "lines": pack((keep[:, 0], 6), (keep[:, 1], 6))})
            if row in done:
                continue
            done.add(row)
            for start, stop, at, _ in own[own[:, 3] == 0].tolist():
                strings.setdefault(at, []).append((row, order, start, text[start:stop]))
        for at, found in strings.items():
            row, order, start = (np.array([f[k] for f in found], np.int64) for k in range(3))
            size = np.array([len(f[3]) for f in found], np.int64)
            out.append({"kind": 2, "part": at, "blob": press.compress(b"".join(f[3] for f in found)), "lines": pack((row, 8), (order, 8), (start, 6), (size, 1))})
        return pa.Table.from_pylist(out, schema=schema)

    return lean(work)


def anchored(text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings that are runs, where they begin: the hash of the anchor and how far it stands from the begin."""
    gram, place = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.int64)
    for s in range(0, len(begin), 8192):
        at = begin[s : s + 8192]
        lo = at[0]
        start = (at - lo)[:, None] + np.arange(K - GRAM + 1)
        found = mix(Hasher(text[lo : at[-1] + K])(start, start + GRAM))
        least = (found & _HIGH).argmin(1)  # of equal hashes the leftmost, as in ``runs``
        gram[s : s + 8192], place[s : s + 8192] = found[np.arange(len(at)), least], least
    return gram, place


def equal_strings(strings: np.ndarray) -> np.ndarray:
    """A class for each row of a matrix of bytes: the same for equal rows, told byte by byte."""
    n, size = strings.shape
    words = np.zeros((n, -(-size // 8) * 8), np.uint8)
    words[:, :size] = strings
    words = words.view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        key = mix(key ^ words[:, k]) + np.uint64(1)
    by = np.argsort(key, kind="stable")
    other = (words[by[1:]] != words[by[:-1]]).any(1)
    if (other & (key[by[1:]] == key[by[:-1]])).any():  # different strings with one hash
        by = np.lexsort(words.T)
        other = (words[by[1:]] != words[by[:-1]]).any(1)
    out = np.empty(n, np.int64)
    out[by] = np.concatenate([[0], np.cumsum(other)])
    return out


def repeated_windows(text: np.ndarray, order: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For strings laid end to end, each a run: whether a smaller document has their windows (strings x places).

    Equal windows have the same anchor at the same place, so a few anchors are sorted at a time, up to
    ``SORTED`` bytes; windows of an anchor with more are sorted for one place of the anchor after the other.
    """
    begin = np.cumsum(size) - size
    hit = np.zeros((len(size), K - GRAM + 1), bool)
    if not len(size):
        return hit
    anchor, place = anchored(text, begin)
    by = np.argsort(anchor, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], anchor[by][1:] != anchor[by][:-1]]))
    ends = np.append(cut[1:], len(by))
    for s, e in blocks(np.add.reduceat(size[by], cut), SORTED):
        i = by[cut[s] : ends[e - 1]]
        n = size[i]
        if n.sum() <= SORTED:
            end = np.cumsum(n)
            some = text[np.repeat(begin[i] - (end - n), n) + np.arange(end[-1])]
            count = n - K + 1  # windows of each string
            of = np.repeat(np.arange(len(i)), count)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            same = equal_windows(some, (end - n)[of] + inside, K)
            mine = order[i][of]
            least = np.full(int(same.max()) + 1, _LAST)
            np.minimum.at(least, same, mine)
            hit[i[of], inside] = mine > least[same]
            continue
        view = np.lib.stride_tricks.sliding_window_view(text, K)
        for back in range(K - GRAM + 1):
            inside = place[i] - back
            own = np.flatnonzero((inside >= 0) & (inside <= n - K))
            if len(own):
                j, inside = i[own], inside[own]
                same = equal_strings(view[begin[j] + inside])
                least = np.full(int(same.max()) + 1, _LAST)
                np.minimum.at(least, same, order[j])
                hit[j, inside] = order[j] > least[same]
    return hit


def _compare(parts: int):
    """Strings of one part by anchor -> packed spans by row that a smaller document has."""
    import zstandard

    def work(table: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        text = np.frombuffer(b"".join(d.decompress(b) for b in table.column("blob").to_pylist()), np.uint8)
        row, order, start, size = (x.view(np.int64) for x in unpack(table.column("lines").to_pylist(), PLACE))
        hit = repeated_windows(text, order, size)
        # neighbouring windows of a string become one span
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).view(np.int8), axis=1)
        of, first = np.nonzero(edge == 1)
        last = np.nonzero(edge == -1)[1] - 1
        r, s, e = row[of], start[of] + first, start[of] + last + K
        one = np.ones(len(r), np.int64)
        rows, blobs = [], []
        for p, i in dealt(_by_row(r, parts)):
            rows.append(p), blobs.append(pack((r[i], 8), (s[i], 6), (e[i], 6), (one[i], 4), (one[i], 1)))
        return pa.table({"part": pa.array(rows, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return lean(work)


def _finish(want_text: bool, schema: pa.Schema):
    import zstandard

    def work(waiting: pa.Table, spans: pa.Table) -> pa.Table:
        d = zstandard.ZstdDecompressor()
        lines = _spans(spans.column("blob").to_pylist())
        out = []
        for row, oid, blob, kept_lines in zip(*(waiting.column(c).to_pylist() for c in ("row", "id", "blob", "lines")), strict=True):
            start, stop = (x.view(np.int64) for x in unpack([kept_lines], (6, 6)))
            more = lines.get(row, np.zeros((0, 4), np.int64))[:, :2]
            n, r, s, sha, sp, kept = _finished(d.decompress(blob), np.concatenate([np.stack([start, stop], 1), more]), want_text)
            out.append({"row": row, "id": oid, "n_bytes": n, "n_removed": r, "n_spans": s, "kept_sha256": sha, "spans": sp, "kept": kept})
        names = ["row", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
        return pa.Table.from_pylist(out, schema=pa.schema([schema.field(x) for x in names]))

    return lean(work)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", want_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept`` for every row, and ``carry``.

    Ids are integers. ``kept`` (what remains, as text) is null unless ``want_text``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    base = docs.select(F.struct(id_col, *carry).alias("id"), F.col(id_col).cast("long").alias("order"), F.col(text_col).cast("binary").alias("text"))
    ids = base.groupBy("order").count().agg(F.count("*").alias("n"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count("order").alias("known")).first()
    if ids.n == ids.rows == ids.known:
        rows = base.withColumn("row", F.col("order"))
    else:  # repeated or null ids: rows get numbers of their own, which a table in the shared folder keeps
        rows = materialize(base.withColumn("order", F.coalesce("order", F.lit(_LAST))).withColumn("row", F.monotonically_increasing_id()))
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema["id"].dataType])
    schema = _half(to_arrow_type(kind))
    parts = max(1, PARTS * rows.rdd.getNumPartitions())
    packed = rows.select("row", "order", "text").mapInArrow(_anchors(parts, hot_anchors(rows, ids.rows)), "part int, kind int, blob binary")
    spans = packed.groupBy("part").applyInArrow(_decide(parts), "part int, blob binary")
    dealt_rows = rows.select("row", "order", "id", "text").mapInArrow(_deal(parts), "part int, docs binary")
    fields = lambda ddl: T.StructType.fromDDL(ddl).fields
    done = [*fields("row long"), T.StructField("id", kind), *fields(DONE)]
    half_type = T.StructType([*fields("kind int, part int"), *done, *fields("blob binary, lines binary")])
    half = materialize(dealt_rows.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_apply(want_text, schema), half_type))
    # small in bytes and long in work, so its parts are not to be put together
    found = half.where("kind = 2").select("part", "blob", "lines").repartition(parts, "part").groupBy("part").applyInArrow(_compare(parts), "part int, blob binary")
    waiting = half.where("kind = 1").select("part", "row", "id", "blob", "lines")
    late = waiting.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(_finish(want_text, schema), T.StructType(done))
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    return half.where("kind = 0").select("id.*", *names).union(late.select("id.*", *names))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns."""
    return repeated_bytes(docs, id_col, text_col).drop("kept", "spans")
