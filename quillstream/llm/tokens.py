"""Fast batch encoding with a public tokenizer file.

White space never reaches a token of this tokenizer and no rule looks across it, so a text's ids are those of its
white-space-separated chunks. A batch of texts is split and its chunks are numbered by Arrow, so Python handles each
different chunk of a batch once. Each Python worker keeps a bounded table chunk -> ids; only chunks that it has not
seen are encoded, many at once, split by the end-of-text token. When the table is full, it keeps the chunks that came up
again. Words of letters that the tokenizer's normalizer leaves as they are skip it. Texts with the control characters that Arrow, but
not the tokenizer, takes for white space are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from unicodedata import is_normalized as nfc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
MARK = "<|endoftext|>"
#: A point or comma that ends a word is a token run of its own, so it can be set apart without changing any id.
STOP = r"(\pL)([.,])(\s|\z)"
#: Letters here are the same in every version of Unicode that a tokenizer may be built with.
SETTLED = re.compile("[ -\u04ff]*")
#: What skip_normalizer() knows how to leave out.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def skip_normalizer(path: str):
    """Tokenizers for words of letters and for any chunks, lower-case, in normal form C and with spaces between.

    Both are None if the file's rules are others.
    """
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        parts = json.load(f)
    normal, pre = parts.get("normalizer") or {}, (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    if normal.get("normalizers") != NORMAL or pre[0] != SPLIT or any("<|" not in t["content"] for t in parts["added_tokens"]):
        return None, None
    chunks = Tokenizer.from_str(json.dumps(parts | {"normalizer": None}))
    pre = parts["pre_tokenizer"] | {"pretokenizers": [{"type": "WhitespaceSplit"}, *pre[1:]]}
    return Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": pre})), chunks


class Encoder:
    """ids of texts; ``most`` bounds the chunks remembered."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.words, self.chunks = skip_normalizer(path)
        self.mark = self.tok.token_to_id(MARK)
        self.last = np.zeros(self.tok.get_vocab_size(), bool)  # ids that end a run of letters
        self.last[[v for k, v in self.tok.get_vocab().items() if k.endswith("</w>")]] = True
        self.reset()

    def reset(self):
        self.known = pa.array([], pa.large_string())
        self.start, self.size, self.met = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _put(self, at, ids: np.ndarray, sizes: np.ndarray):
        while len(self.known) > len(self.start):
            self.start, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.met))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.used += len(ids)

    def _forget(self):
        """Keeps the chunks that came up in several batches, at most half of ``most``; of those, the ones met most often."""
        met = self.met[: len(self.known)]
        kept = np.argsort(-met, kind="stable")[: self.most // 2]
        kept = np.sort(kept[met[kept] > 1])
        known, sizes = self.known.take(pa.array(kept)), self.size[kept]
        ids = self.pool[ragged(self.start[kept], sizes)]
        self.reset()
        self.known = known
        self._put(np.arange(len(kept)), ids, sizes)
        self.met[: len(kept)] = 1

    def _ids(self, text: str, quick) -> np.ndarray:
        """The ids of text; quick: a tokenizer that skips the normalizer, if there is one."""
        ready = quick and SETTLED.fullmatch(text) and text == text.lower() and nfc("NFC", text)
        return np.array((quick if ready else self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, fresh: pa.Array):
        """Encodes chunks that are not known yet; they get the next numbers."""
        chunks, base = fresh.to_numpy(zero_copy_only=False).tolist(), len(self.known)
        self.known = pa.concat_arrays([self.known, fresh])
        plain, words = [], []
        for i, c in enumerate(chunks):
            if "<|" not in c:
                (words if c.isalpha() else plain).append(i)
        for i in range(0, len(words), 200):
            part = words[i : i + 200]
            ids = self._ids(" ".join([chunks[j] for j in part]), self.words)
            cuts = np.flatnonzero(self.last[ids])
            if len(cuts) == len(part):  # a word of letters is one run
                self._put(base + np.array(part), ids, np.diff(cuts, prepend=-1))
            else:
                plain += part
        for i in range(0, len(plain), 200):
            part = plain[i : i + 200]
            ids = self._ids(f" {MARK} ".join([chunks[j] for j in part]), self.chunks)
            cuts = np.concatenate([np.flatnonzero(ids == self.mark), [len(ids)]])
            self._put(base + np.array(part), ids[ids != self.mark], np.diff(cuts, prepend=-1) - 1)
        for i, c in enumerate(chunks):
            if "<|" in c:
                ids = np.array(self.tok.encode(c, add_special_tokens=False).ids, np.uint32)
                self._put(np.array([base + i]), ids, np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after another, and how many each text has."""
        if len(self.known) > self.most:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        low = pc.utf8_lower(texts)
        ready = pc.replace_substring_regex(low, STOP, r"\1 \2\3")
        # Special tokens, capitals that lower-case by context or to several letters, and combining marks mind their case.
        plain = pc.invert(pc.match_substring_regex(texts, "<\\||[\u03a3\u0130]")).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(pc.invert(pc.string_is_ascii(texts)).to_numpy(zero_copy_only=False)).tolist():
            if plain[i]:
                plain[i] = nfc("NFC", texts[i].as_py()) and nfc("NFC", low[i].as_py())
        if not plain.all():
            ready = pc.if_else(pa.array(plain), ready, texts)
        odd = {}
        for i in np.flatnonzero(pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)).tolist():
            odd[i] = np.array(self.tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        if odd:
            ready = pc.if_else(pa.array([i in odd for i in range(len(texts))]), pa.scalar("", pa.large_string()), ready)
        words = pc.utf8_split_whitespace(ready)
        edges = words.offsets.to_numpy()
        numbered = words.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        found = pc.index_in(numbered.dictionary, value_set=self.known)
        fresh = found.is_null()
        codes = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        if found.null_count:
            codes[fresh.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(found.null_count)
            self._learn(numbered.dictionary.filter(fresh))
        self.met[codes] += 1
        at = numbered.indices.to_numpy()
        sizes = self.size[codes][at]
        ids = self.pool[ragged(self.start[codes][at], sizes)]
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[edges - edges[0]])
        if odd:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            parts = [odd[i] if i in odd else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, lengths


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches, path: str, end: int = 0, most_bytes: int = 4 << 20):
    """(doc_ids, ids, offsets) of runs of documents of about most_bytes text; each document ends with id ``end``."""
    enc = encoder(path)

    def run(held):
        docs, texts = pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held])
        ids, lengths = enc.encode(texts)
        offs = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(offs[-1], end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[offs[1:] - 1] = False
        out[keep] = ids
        return docs, out, offs

    held, size = [], 0
    for b in batches:
        docs, texts = b.column("doc_id"), b.column("text").cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):  # up to the text that fills the run
            n = int(np.searchsorted(np.cumsum(sizes[at:]), most_bytes - size)) + 1
            held.append((docs.slice(at, n), texts.slice(at, n)))
            size += int(sizes[at : at + n].sum())
            at += n
            if size >= most_bytes:
                yield run(held)
                held, size = [], 0
    if held:
        yield run(held)
    pa.default_memory_pool().release_unused()
