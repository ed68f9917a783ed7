"""Token ids of whole texts with the tokenizers library, with a cache of the words met so far."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in the cache of a worker (as many older ones beside them), and the longest that is kept.
CACHE_WORDS, CACHE_LENGTH = 150_000, 64

MARKS, LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
MARK = f"[{re.escape(MARKS)}]"
#: Latin letters without apostrophes, and then marks; the same with an optional line end before it.
MARKED, PLAIN = f"^{LETTERS}+{MARK}+$", re.compile(f"(\n?)({LETTERS}+)({MARK}*)")


def _visible() -> dict[int, int]:
    """Byte-level tokenizers write a byte as itself where Latin-1 shows it, and else as the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


VISIBLE = _visible()
SPACE = chr(VISIBLE[32])
INSIDE = re.compile(f"(?:^[^{SPACE}]|[A-Za-z]|\u00c3.){SPACE}")
HIDDEN = re.compile("[ \x80-\xa0\xad]")


class Encoder:
    """encode(texts) -> little-endian unsigned 32-bit ids as bytes, one for each text, exactly as the tokenizer gives
    for the whole text with add_special_tokens=False (strings of special tokens are ordinary text).

    Both kinds of file that are known here split a text before merging: a byte-level one never joins a character and
    white space after it, and a word-level one drops white space. So a text can be cut before white space that follows
    a visible character, each part encoded once and kept. Other files, and texts with odd white space, are encoded
    whole.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        self.mode = ""
        if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
            self.mode = "keep"
        elif [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["behavior"] == "Removed" and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.mode = "drop"
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if len(vocab) <= 1 << 16 else 4
        # words in a row can be merged at once where no id holds the sign of a space after a letter or the end of one
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t[0] == SPACE]] = True
        self.joins = self.mode == "keep" and not any(INSIDE.search(t) for t in vocab)
        self.model = self.tokenizer.model
        self.words = words
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text. Parts are told apart in Arrow, so Python meets each different part of a slice once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.mode:
            return self._ids(texts.to_pylist())
        if not len(texts):
            return []
        keep = self.mode == "keep"
        rows = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if keep else " "), " ")
        first = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        coded = rows.flatten().dictionary_encode()
        index, parts = coded.indices.to_numpy(), coded.dictionary
        marked = pc.match_substring_regex(parts, MARKED)
        bare = pc.if_else(marked, pc.utf8_rtrim(parts, MARKS), parts).dictionary_encode()
        tail = pc.if_else(marked, pc.replace_substring_regex(parts, f"^{LETTERS}+", ""), "").dictionary_encode()
        words, tails = bare.dictionary.to_pylist(), ["", *tail.dictionary.to_pylist()]
        both = np.empty((len(index), 2), np.int64)  # a part is a word, or what else is in it, and the marks after it
        both[:, 0] = bare.indices.to_numpy()[index]
        both[:, 1] = tail.indices.to_numpy()[index] + 1
        if keep:  # the first part has no space before it; its key is not the key of any other part
            both[first[:-1], 0] = len(words) + np.arange(len(texts))
            both[first[:-1], 1] = 0
            words += [f"\n {w}" for w in parts.take(coded.indices.take(pa.array(first[:-1]))).to_pylist()]
        both[:, 1] += len(words)
        ids = [*self._of(words), *map(self._tail, tails)]
        size = np.array([len(x or b"") // 4 for x in ids])
        blob, start = np.frombuffer(b"".join(x or b"" for x in ids), "<u4"), np.cumsum(size) - size
        use = both.ravel()
        n = size[use]
        end = np.zeros(len(use) + 1, np.int64)
        np.cumsum(n, out=end[1:])
        out = blob[np.repeat(start[use] - end[:-1], n) + np.arange(end[-1])].tobytes()
        cut = (4 * end[2 * first]).tolist()
        found = [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        odd = np.array([x is None for x in ids])
        if odd.any():  # texts with odd white space are encoded whole
            for i in np.unique(np.searchsorted(first, np.flatnonzero(odd[both[:, 0]]), "right") - 1).tolist():
                found[i] = self._ids([texts[i].as_py()])[0]
        return found

    def _of(self, words: list[str]) -> list[bytes | None]:
        """Ids of words and other parts; None for one that is empty or ends with white space where that matters."""
        if len(self.known) > self.words:  # what is still in use comes over from the older words one by one
            self.known, self.older = {}, self.known
        known, older, keep = self.known, self.older, self.mode == "keep"
        out = list(map(known.get, words))
        new = []
        for i, x in enumerate(out):
            if x is not None:
                continue
            w = words[i]
            x = older.get(w)
            if x is None and w.isalpha() and self.joins and (w.isascii() or PLAIN.fullmatch(w)):
                new.append(i)
                continue
            if x is None and keep and (not w or w[-1].isspace() and w != "\n "):
                continue
            if x is None:
                x = self._part(w)
            if len(w) <= CACHE_LENGTH:
                known[w] = x
            out[i] = x
        for at in range(0, len(new), 256):
            part = new[at : at + 256]
            ids = np.array([t.id for t in self.model.tokenize("".join(SPACE + self._shown(words[i]) for i in part))], "<u4")
            cut = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)]
            for i, a, b in zip(part, cut[:-1], cut[1:], strict=True):
                out[i] = x = ids[a:b].tobytes()
                if len(words[i]) <= CACHE_LENGTH:
                    known[words[i]] = x
        return out

    @staticmethod
    def _shown(word: str) -> str:
        """A word of letters as a byte-level model has it."""
        if word.isascii():
            return word
        word = word.encode().decode("latin-1")
        return word.translate(VISIBLE) if HIDDEN.search(word) else word

    def _part(self, w: str) -> bytes:
        """Ids of a part: Latin letters and then marks are one word and one run for both kinds; other parts go whole."""
        keep = self.mode == "keep"
        if not keep:
            text = w
        else:
            text = w[2:] if w[:2] == "\n " else w if w[0] == "\n" else f" {w}"
        m = PLAIN.fullmatch(text)
        if not m:
            return self._ids([text])[0]
        head, word, tail = m.groups()
        ids = array("I", [t.id for t in self.model.tokenize(self._shown(word if keep else word.lower()))]).tobytes()
        return (self._tail(head) if keep else b"") + ids + self._tail(tail)

    def _tail(self, tail: str) -> bytes:
        ids = self.tails.get(tail)
        if ids is None:
            ids = self._ids([tail])[0] if tail else b""
            if len(self.tails) < self.words and len(tail) <= CACHE_LENGTH:
                self.tails[tail] = ids
        return ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, words: int = CACHE_WORDS) -> Encoder:
    """The Encoder of a file, one for each Python worker, so that its words stay known from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].words = words
    return _ENCODERS[path]
