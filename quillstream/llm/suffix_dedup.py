"""Removal of repeated passages by suffix sorting.

A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller doc_id. Every such
string picks an anchor, the least-hashed 20-gram inside it; equal strings pick the same one, so only strings with a
common anchor can be equal. Consecutive strings with one anchor form a segment. Three steps:

1. Blocks of documents send, per distinct anchor, the digest of its segment (or a mark for several) and the smallest
   doc_id. One row per block and bucket, one entry per anchor and block, however often a passage repeats.
2. Anchors with one segment everywhere are settled there. Of anchors with several, the blocks send their segments
   again in runs of a few strings, keyed by the bytes common to the run, and most are settled or unique now. Of the
   runs whose key still has several contents the blocks send every run's text once, with the smallest doc_id; a bucket
   sorts the strings in them as suffixes, deep-shallow: multikey quicksort over 8-byte symbols to a shallow depth, then
   blind tries for the groups that still share a prefix. Equality there is that of whole bytes.
3. The blocks mark the repeated strings and return what is left.

Steps 1 and 2 take anchors and runs of strings for equal by 112 bits of hashes, and a block's own strings by 128; what
is sorted is decided and answered without hashes. Every block that holds a passage sends one entry for each of its anchors, so the entries
of a very frequent passage grow with the number of blocks.

All steps read one shuffle of the compressed text. A null doc_id is larger than any other and is returned as null; rows
with equal doc_id never count as earlier for one another. Null text is empty; texts under ``width`` bytes stay whole.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, ragged, setup, text_buffer

GRAM = 20
RUN = 8
#: Kinds of replies from here on are masks of the bucket whose number follows.
MASK = 8
#: Runs that more blocks share send their strings one by one, so no bucket gathers a frequent passage's surroundings.
HOT = 256
LAST = np.iinfo(np.int64).max
U = np.uint64
_mix = [U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)]
_bytes = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes that stand side by side."""
    x = a * _mix[0]
    x += b
    x ^= x >> U(29)
    x *= _mix[1]
    x ^= x >> U(32)
    return x


class Chunk:
    """Hashes of all short byte strings of one run of documents."""

    def __init__(self, raw: np.ndarray):
        h = {1: _bytes[raw]}
        for n in (1, 2, 4, 8, 16):
            h[2 * n] = _join(h[n][:-n], h[n][n:]) if len(h[n]) > n else np.zeros(0, np.uint64)
        self.h = h

    def gram(self) -> np.ndarray:
        return _join(self.h[16][: max(0, len(self.h[16]) - 4)], self.h[4][16:])

    def string(self, at: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the width-byte strings at the given places; width is 32 to 64."""
        return _join(self.h[32][at], self.h[32][at + (width - 32)])


def segments(raw: np.ndarray, off: np.ndarray, width: int):
    """(document, first start, last start, anchor hash, segment digest, anchor place) of all segments, in text order."""
    out = []
    d = 0
    while d < len(off) - 1:
        e = d + 1
        while e < len(off) - 1 and off[e + 1] - off[d] <= 1 << 18:
            e += 1
        out.append(_segments(raw[off[d] : off[e]], off[d : e + 1] - off[d], width, d, off[d]))
        d = e
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))


def _segments(raw, off, width, first, base):
    n = np.diff(off) - width + 1
    has = np.flatnonzero(n > 0)
    if not len(has):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    chunk = Chunk(raw)
    gram = chunk.gram()
    span = width - GRAM + 1
    low = (gram >> U(32) << U(32)) | np.arange(len(gram), dtype=np.uint64)
    done = 1
    while done < span:  # least over a sliding span by doubling; the place breaks ties to the left
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    starts = ragged(off[has], n[has])
    pick = (low[starts] & U(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((np.diff(pick) != 0) | (np.diff(starts) != 1)) + 1
    a = np.concatenate([[0], cut])
    z = np.concatenate([cut, [len(starts)]]) - 1
    s, e = starts[a], starts[z]
    digest = _join(chunk.string(s, width), chunk.string(e, width)) + (e - s).astype(np.uint64) * _mix[3]
    return np.searchsorted(off, s, "right") - 1 + first, s + base, e + base, gram[pick[a]], digest | U(1), pick[a] + base


def _squeezed(batches):
    """The texts in UTF-8, each compressed by itself; null counts as empty."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        raw, off = text_buffer(b.column("text"))
        raw, off = raw.tobytes(), off.tolist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("block"), pa.array([squeeze(raw[i:j]) for i, j in zip(off, off[1:])], pa.binary())], ["doc_id", "block", "text"])


def _block(table):
    table = table.sort_by([("doc_id", "ascending")])
    open_ = zstandard.ZstdDecompressor().decompress
    texts = [open_(v.as_buffer()) for v in table.column("text")]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ids = table.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
    return raw, off, ids


def _grouped(keys, digests, owners):
    """Distinct keys, each row's key number, and per key its digest (0 for several) and smallest owner."""
    uniq, inv = np.unique(keys, return_inverse=True)
    order = np.argsort(inv, kind="stable")
    at = np.searchsorted(inv[order], np.arange(len(uniq)))
    if not len(uniq):
        return uniq, inv, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lo, hi = np.minimum.reduceat(digests[order], at), np.maximum.reduceat(digests[order], at)
    return uniq, inv, np.where(lo == hi, lo, U(0)), np.minimum.reduceat(owners[order], at)


def _anchors(raw, off, ids, width):
    """Segments (document, starts, place) and their grouping by anchor."""
    doc, s, e, h, dg, place = segments(raw, off, width)
    return doc, s, e, place, *_grouped(h, dg, ids[doc])


def _runs(raw, doc, s, e, place, h, mine, width):
    """The segments marked mine in runs of up to ``RUN`` strings at fixed places around the anchor.

    All strings of a run hold its core, the bytes from the last possible start to the end of the first one, so only
    runs with equal anchor, place and core can share a string: (document, first start, last start, key, digest).
    """
    doc, s, e, place, h = (x[mine] for x in (doc, s, e, place, h))
    first, last = (place - e) // RUN, (place - s) // RUN
    n = last - first + 1
    seg, j = np.repeat(np.arange(len(s)), n), ragged(first, n)
    top = place[seg] - RUN * j
    a, z = np.maximum(s[seg], top - RUN + 1), np.minimum(e[seg], top)
    core = _hashes(raw, top, width - RUN + 1)
    key = _join(_join(h[seg], core), j.astype(np.uint64))
    digest = _join(_hashes(raw, a, width), _hashes(raw, z, width)) + ((z - a) * 64 + (top - a)).astype(np.uint64) * _mix[3]
    return doc[seg], a, z, key, digest | U(1)


def _hashes(raw, at, width, seed: int = 7):
    """Hashes of the width bytes at each place, the same wherever they stand."""
    view = np.lib.stride_tricks.sliding_window_view(raw, width) if len(raw) >= width else np.zeros((0, width), np.uint8)
    h = np.zeros(len(at), np.uint64)
    for k in range(0, len(at), 1 << 16):
        x = view[at[k : k + (1 << 16)]]
        words = np.concatenate([x, np.zeros((len(x), -width % 8), np.uint8)], 1).view(np.uint64)
        v = np.full(len(x), seed, np.uint64)
        for c in range(words.shape[1]):
            v = _join(v, words[:, c] * _mix[2])
        h[k : k + (1 << 16)] = v
    return h


def _deal(hashes: np.ndarray, owners: np.ndarray, buckets: int):
    """Order of rows by bucket, runs of equal owners together as these shrink well in the shuffle, and the buckets' edges."""
    b = ((hashes >> U(17)) % U(buckets)).astype(np.int64)
    order = np.lexsort((owners, b))
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def _dealt(block: int, hashes: np.ndarray, buckets: int, columns: list[np.ndarray]):
    """Rows (bucket, block, blobs) of columns, dealt by the hashes."""
    order, edge = _deal(hashes, columns[-1], buckets)
    rows = [[], [], *([] for _ in columns)]
    for k in range(buckets):
        if edge[k] < edge[k + 1]:
            part = order[edge[k] : edge[k + 1]]
            for c, v in zip(rows, (k, block, *(x[part].tobytes() for x in columns))):
                c.append(v)
    kinds = [pa.int64(), pa.int64(), *(pa.binary() for _ in columns)]
    return pa.table([pa.array(c, t) for c, t in zip(rows, kinds)], names=["bucket", "block", "a", "b", "c"][: 2 + len(columns)])


def _short(digest: np.ndarray) -> np.ndarray:
    """The low six bytes; with the key's eight they tell contents apart."""
    return np.ascontiguousarray(digest.view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _entries(width, buckets):
    def run(table):
        raw, off, ids = _block(table)
        *_, uniq, _, dg, least = _anchors(raw, off, ids, width)
        return _dealt(table.column("block")[0].as_py(), uniq, buckets, [uniq, _short(dg), least])

    return run


NONE = ["bucket", "block", "a", "b", "c"], [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _nothing():
    return pa.table([pa.array([], t) for t in NONE[1]], names=NONE[0])


def _cores(width, buckets):
    """Runs of the segments whose anchor has several segments."""

    def run(docs, replies):
        if not len(docs) or not len(replies):
            return _nothing()
        raw, off, ids = _block(docs)
        doc, s, e, place, uniq, inv, _, _ = _anchors(raw, off, ids, width)
        doc, _, _, key, dg = _runs(raw, doc, s, e, place, uniq[inv], _within(uniq, _known(replies, 2))[inv], width)
        uniq, _, dg, least = _grouped(key, dg, ids[doc])
        return _dealt(docs.column("block")[0].as_py(), uniq, buckets, [uniq, _short(dg), least])

    return run


def _stack(table, name, kind):
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _replies(blocks, kinds, values):
    order = np.lexsort((kinds, blocks))
    blocks, kinds, values = blocks[order], kinds[order], values[order]
    cut = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
    edge = [0, *cut.tolist(), len(blocks)] if len(blocks) else [0]
    return pa.table(
        {
            "block": pa.array(blocks[edge[:-1]], pa.int64()),
            "kind": pa.array(kinds[edge[:-1]], pa.int64()),
            "v": pa.array([values[a:b].tobytes() for a, b in zip(edge, edge[1:])], pa.binary()),
        }
    )


def _settle(one: int, several_kind: int, hot_kind: int):
    """Of each key: kind one to blocks without its smallest holder if it has one content everywhere, else several_kind,
    or hot_kind if over HOT blocks hold it."""

    def run(table):
        return _settled(table, one, several_kind, hot_kind)

    return run


def _settled(table, one, several_kind, hot_kind):
    h, least = _stack(table, "a", np.uint64), _stack(table, "c", np.int64)
    dg = np.zeros((len(h), 8), np.uint8)
    dg[:, :6] = _stack(table, "b", np.uint8).reshape(-1, 6)
    dg = dg.view(np.uint64).ravel()
    block = np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in table.column("a").to_pylist()])
    order = np.argsort(h, kind="stable")
    h, dg, least, block = h[order], dg[order], least[order], block[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(at, len(h)))
    several = np.repeat((np.minimum.reduceat(dg, at) != np.maximum.reduceat(dg, at)) | (np.minimum.reduceat(dg, at) == 0), size)
    first = np.repeat(np.minimum.reduceat(least, at), size)
    shared, hot = np.repeat(size > 1, size), np.repeat(size > HOT, size)
    kind = np.where(shared & several, np.where(hot, hot_kind, several_kind), np.where(shared & (least > first), one, 0))
    some = kind > 0
    return _replies(block[some], kind[some], h[some])


def _known(replies, kind):
    got = [x for k, x in zip(replies.column("kind").to_pylist(), replies.column("v").to_pylist()) if k == kind]
    return np.unique(np.frombuffer(b"".join(got), np.uint64))


def _within(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _strings(raw, doc, s, e, mine, width):
    """Places, documents and two hashes of all strings of the runs marked mine."""
    n = e[mine] - s[mine] + 1
    at = ragged(s[mine], n)
    return at, np.repeat(doc[mine], n), _hashes(raw, at, width), _hashes(raw, at, width, 11)


def _smallest(h, g, owner):
    """Of the distinct pairs (h, g) one place and the smallest owner of each, and the number of each row's pair."""
    order = np.lexsort((g, h))
    new = np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)]) if len(h) else np.zeros(0, bool)
    inv = np.zeros(len(h), np.int64)
    inv[order] = np.cumsum(new) - 1
    least = np.full(int(new.sum()), LAST)
    np.minimum.at(least, inv, owner)
    return order[new], inv, least


def _listed(raw, doc, s, e, key, dg, few, hot, ids, width):
    """What a block sends to be sorted: the distinct runs marked few and the strings of those marked hot, one by one.

    (key, first start, last start, smallest doc_id) of each in an order that depends on contents only, the row of each
    marked run, and the row of each string of the hot runs.
    """
    at, owner, h, g = _strings(raw, doc, s, e, hot, width)
    key, dg = np.concatenate([key[few], h]), np.concatenate([dg[few], g])
    s, e, doc = np.concatenate([s[few], at]), np.concatenate([e[few], at]), np.concatenate([doc[few], owner])
    one, row, least = _smallest(key, dg, ids[doc])
    return key[one], s[one], e[one], least, row[: int(few.sum())], row[int(few.sum()) :]


def _suffixes(width, buckets):
    """The runs whose core has several contents, each as the one text that holds its strings, then their number.

    Strings of runs that very many blocks share are runs of their own here, so they are dealt one by one.
    """

    def run(docs, replies):
        if not len(docs) or not len(replies):
            return _nothing()
        raw, off, ids = _block(docs)
        doc, s, e, place, uniq, inv, _, _ = _anchors(raw, off, ids, width)
        doc, s, e, key, dg = _runs(raw, doc, s, e, place, uniq[inv], _within(uniq, _known(replies, 2))[inv], width)
        few, hot = _within(key, _known(replies, 5)), _within(key, _known(replies, 6))
        key, s, e, least, _, _ = _listed(raw, doc, s, e, key, dg, few, hot, ids, width)
        size = e - s + width
        text = np.zeros((len(s), width + RUN), np.uint8)
        text[np.repeat(np.arange(len(s)), size), ragged(np.zeros_like(size), size)] = raw[ragged(s, size)]
        text[:, -1] = size - width + 1
        return _dealt(docs.column("block")[0].as_py(), key, buckets, [key, text.view(f"V{width + RUN}").ravel(), least])

    return run


def multikey_quicksort(words: np.ndarray, depth: int) -> np.ndarray:
    """Order of the rows of words (8-byte symbols) by the first depth symbols.

    All groups are parted at once: each by its own pivot, the middle one of three of its symbols, into smaller, equal
    and larger rows, of which the equal ones go on to the next symbol.
    """
    order = np.arange(len(words))
    at = np.zeros(min(len(words), 1), np.int64)  # where the groups that are not in order yet start, how long they are, and their symbol
    size, symbol = np.full(len(at), len(words)), np.zeros(len(at), np.int64)
    while True:
        open_ = (size > 1) & (symbol < depth)
        at, size, symbol = at[open_], size[open_], symbol[open_]
        if not len(at):
            return order
        places = ragged(at, size)
        group = np.repeat(np.arange(len(at)), size)
        x = words[order[places], symbol[group]]
        first = np.cumsum(size) - size
        low, mid, high = (x[first + k] for k in (0 * size, size // 2, size - 1))
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[group]
        part = group * 3 + (x >= pivot) + (x > pivot)
        moved = np.argsort(part, kind="stable")
        order[places] = order[places[moved]]
        number = np.bincount(part, minlength=3 * len(at))
        at = np.repeat(at, 3) + (np.cumsum(number) - number - np.repeat(first, 3))
        size, symbol = number, np.repeat(symbol, 3) + np.tile([0, 1, 0], len(symbol))


class BlindTrie:
    """Patricia tree over byte strings that keeps only branching places and bytes; leaves hold equal strings."""

    def __init__(self):
        self.root = None

    def insert(self, text: bytes, item) -> None:
        if self.root is None:
            self.root = [text, [item]]
            return
        node = self.root
        while isinstance(node, tuple):  # blind descent to any leaf below
            place, kids = node
            node = kids.get(text[place]) or next(iter(kids.values()))
        other = node[0]
        if other == text:
            node[1].append(item)
            return
        lcp = next(i for i, (a, b) in enumerate(zip(text, other)) if a != b)
        node, up, via = self.root, None, None
        while isinstance(node, tuple) and node[0] < lcp:
            up, via = node, text[node[0]]
            node = node[1][via]
        leaf = [text, [item]]
        if isinstance(node, tuple) and node[0] == lcp:
            node[1][text[lcp]] = leaf
            return
        fork = (lcp, {other[lcp]: node, text[lcp]: leaf})
        if up is None:
            self.root = fork
        else:
            up[1][via] = fork

    def groups(self):
        """Items of equal strings together, in the order of the strings."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def deep_shallow(text: np.ndarray, shallow: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of equal-width byte strings: rows of one group are equal, groups ascend."""
    n, width = text.shape
    words = np.concatenate([text, np.zeros((n, -width % 8), np.uint8)], 1).view(">u8").astype(np.uint64)
    order = multikey_quicksort(words, shallow)
    w = words[order]
    starts = np.flatnonzero(np.concatenate([[True], (w[1:, :shallow] != w[:-1, :shallow]).any(1)])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, n))
    same = np.concatenate([[False], (w[1:] == w[:-1]).all(1)]) if n else np.zeros(0, bool)
    head = np.repeat(starts, size)
    # Groups whose rows are all equal need no trie.
    plain = np.add.reduceat((same | (np.arange(n) == head)).astype(np.int64), starts) == size if n else np.zeros(0, bool)
    mark = np.zeros(n, bool)
    mark[starts] = True
    for g in np.flatnonzero(~plain):
        a, b = starts[g], starts[g] + size[g]
        trie = BlindTrie()
        for r in order[a:b].tolist():
            trie.insert(text[r].tobytes(), r)
        at = a
        for items in trie.groups():
            mark[at] = True
            order[at : at + len(items)] = items
            at += len(items)
    return order, np.cumsum(mark) - 1


def _sorted_groups(width):
    """Answers each block with one byte a run, in the order it sent them: the strings that another block had earlier."""

    def run(table):
        bucket = table.column("bucket")[0].as_py()
        sent = [len(x) // 8 for x in table.column("a").to_pylist()]
        least = _stack(table, "c", np.int64)
        runs = np.frombuffer(b"".join(table.column("b").to_pylist()), np.uint8).reshape(len(least), width + RUN)
        n = runs[:, -1].astype(np.int64)
        row, spot = np.repeat(np.arange(len(n)), n), ragged(np.zeros_like(n), n)
        text = np.lib.stride_tricks.sliding_window_view(runs, width, 1)[row, spot]
        least, block = least[row], np.repeat(np.arange(len(sent)), sent)[row]
        order, group = deep_shallow(text)
        first = np.full(group[-1] + 1 if len(group) else 0, LAST)
        np.minimum.at(first, group, least[order])
        # A block may hold a string in several runs: it hears of it only if none of them has the smallest doc_id.
        at = np.lexsort((least[order], block[order], group))
        order, group = order[at], group[at]
        lead = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(block[order]) != 0)]) if len(order) else np.zeros(0, bool)
        late = (least[order] > first[group])[lead][np.cumsum(lead) - 1]
        mask = np.zeros(len(n), np.uint8)
        np.bitwise_or.at(mask, row[order[late]], np.left_shift(1, spot[order[late]]).astype(np.uint8))
        parts = np.split(mask, np.cumsum(sent)[:-1])
        some = [k for k, m in enumerate(parts) if m.any()]
        blocks = table.column("block").to_pylist()
        return pa.table({"block": pa.array([blocks[k] for k in some], pa.int64()), "kind": pa.array([MASK + bucket] * len(some), pa.int64()), "v": pa.array([parts[k].tobytes() for k in some], pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(width, buckets, with_text: bool):
    def run(docs, replies):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
        if not len(docs):
            return pa.table([pa.array([], t) for t in kinds], names=names)
        raw, off, ids = _block(docs)
        doc, s, e, place, uniq, inv, dg, least = _anchors(raw, off, ids, width)
        # A block's own anchors and runs with several contents are settled like those that other blocks share.
        several = _within(uniq, _known(replies, 2))[inv] | (dg == 0)[inv]
        gone = ~several & (_within(uniq, _known(replies, 1))[inv] | (ids[doc] > least[inv]))
        step = np.zeros(len(raw) + 1, np.int32)
        np.add.at(step, s[gone], 1)
        np.add.at(step, e[gone] + width, -1)
        doc, s, e, key, dg = _runs(raw, doc, s, e, place, uniq[inv], several, width)
        few, hot = _within(key, _known(replies, 5)), _within(key, _known(replies, 6))
        sent, _, _, owner, of_run, of_string = _listed(raw, doc, s, e, key, dg, few, hot, ids, width)
        mask, (order, edge) = np.zeros(len(sent), np.uint8), _deal(sent, owner, buckets)
        for kind, v in zip(replies.column("kind").to_pylist(), replies.column("v").to_pylist()):
            if kind >= MASK:
                mask[order[edge[kind - MASK] : edge[kind - MASK + 1]]] = np.frombuffer(v, np.uint8)
        uniq, inv, dg, least = _grouped(key, dg, ids[doc])
        several = few | hot | (dg == 0)[inv]
        gone = ~several & (_within(uniq, _known(replies, 4))[inv] | (ids[doc] > least[inv]))
        np.add.at(step, s[gone], 1)
        np.add.at(step, e[gone] + width, -1)
        at, owner, h, g = _strings(raw, doc, s, e, several, width)
        _, inv, least = _smallest(h, g, ids[owner])
        # Each string's bit in the mask of the row that it was sent in.
        n = (e - s + 1)[several]
        told = np.zeros(len(at), bool)
        of = np.full(len(key), -1)
        of[few] = of_run
        row, spot = np.repeat(of[several], n), ragged(np.zeros_like(n), n)
        told[row >= 0] = (mask[row[row >= 0]] >> spot[row >= 0].astype(np.uint8)) & 1
        told[np.repeat(hot[several], n)] = mask[of_string] & 1
        later = told | (ids[owner] > least[inv])
        np.add.at(step, at[later], 1)
        np.add.at(step, at[later] + width, -1)
        out = np.cumsum(step[:-1]) > 0
        keep = ~out
        rows = [[], [], [], [], []] + [[]] * with_text
        kept = raw[keep].tobytes()
        ends = np.concatenate([[0], np.cumsum(keep)])[off]
        removed = np.concatenate([[0], np.cumsum(out)])[off]
        # A removed run starts where its byte goes and the one before stays or belongs to another document.
        edge = out & ~np.concatenate([[False], out[:-1]]) if len(out) else out
        if len(out):
            starts = off[:-1][(np.diff(off) > 0)]
            edge[starts] = out[starts]
        spans = np.concatenate([[0], np.cumsum(edge)])[off]
        for i, d in enumerate(ids.tolist()):
            part = kept[ends[i] : ends[i + 1]]
            row = (None if d == LAST else d, int(off[i + 1] - off[i]), int(removed[i + 1] - removed[i]), int(spans[i + 1] - spans[i]), hashlib.sha256(part).hexdigest(), part)
            for c, v in zip(rows, row):
                c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)

    return run


def remove_repeats(docs: DataFrame, width: int = 50, block_bytes: int = 2 << 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, binary) of every document."""
    setup(docs.sparkSession)
    if not 32 <= width <= 64:
        raise ValueError("width must be 32 to 64")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = blocks_for(docs, block_bytes, 64)
    buckets = max(64, n // 6)
    parts = max(n // 4, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = src.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(n)))
    src = src.mapInArrow(_squeezed, "doc_id long, block long, text binary").repartition(parts, "block")
    dealt = "bucket long, block long, a binary, b binary, c binary"
    reply = "block long, kind long, v binary"
    by = src.groupBy("block")
    first = by.applyInArrow(_entries(width, buckets), dealt).groupBy("bucket").applyInArrow(_settle(1, 2, 2), reply)
    second = by.cogroup(first.groupBy("block")).applyInArrow(_cores(width, buckets), dealt).groupBy("bucket").applyInArrow(_settle(4, 5, 6), reply)
    both = first.where("kind = 2").union(second.where("kind in (5, 6)"))
    third = by.cogroup(both.groupBy("block")).applyInArrow(_suffixes(width, buckets), dealt).groupBy("bucket").applyInArrow(_sorted_groups(width), reply)
    schema = RESULT + ", kept_text binary" * with_text
    return src.groupBy("block").cogroup(first.union(second).union(third).groupBy("block")).applyInArrow(_finish(width, buckets, with_text), schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
