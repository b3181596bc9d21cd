"""Token ids of whole texts by the tokenizers library, encoding each distinct word once.

Both public vocabularies split a text into words before merging and merge within a word
only, so the ids of a text are the ids of its words in order. Invented prose repeats its words
often: looking a word up is many times cheaper than merging it again. Arrow cuts the texts of a batch and
numbers their distinct words, so that Python sees each of them once. Where a text can't be cut safely
(unusual white space), the library encodes it whole.
"""

from __future__ import annotations

import functools
import itertools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words a worker remembers; beyond that it drops those least used. Bounds memory to about 150 MB.
REMEMBERED_WORDS = 700_000

# White space other than the space and the line feed, by any library's reckoning.
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# Marks other than the apostrophe between a letter or digit and a space: always words of their own.
_MARKS = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+)([ \n]|$)"
# Letters that no library composes with a neighbour or spells otherwise in lower case than one by one.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u052f]+")
# What the vocabulary that composes and lowers letters may read as another word once its capitals are lowered or the marks
# behind it are cut off: capitals that a mark follows, and letters that end in a mark when composed or lowered.
_DELICATE = (
    "[A-Z]\\pM|[\u0130\u0958-\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c\u0b5d\u0f43\u0f4d\u0f52\u0f57"
    "\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40\ufb41\ufb43\ufb44\ufb46-\ufb4e]"
)
# How byte-level vocabularies write each byte: printable ones as they are, the others from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LETTERS = dict(zip((b for b in range(256) if b not in _PRINTABLE), itertools.count(0x100)))
_SPACE_LETTER = chr(_BYTE_LETTERS[0x20])
# Texts of byte-level vocabularies whose runs of white space belong to tokens, as do those at either end.
_SPACED = r"[ \n][ \n]|\x00|^[ \n]|[ \n]$"
# Key prefixes: a word after a space has none, any other string is kept as it is behind this mark.
_AS_IS = "\x00"


class Encoder:
    """``ids(texts)``: for each text the ids ``Tokenizer.encode(text, add_special_tokens=False)`` gives.

    Strings that spell a special token are ordinary text. ``spaces_matter`` is True for
    byte-level vocabularies whose words keep the space before them, False for those that
    drop white space.
    """

    def __init__(self, path: str, spaces_matter: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaces_matter = spaces_matter
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)
        self.uses = np.zeros(1 << 12, np.int64)

    def _drop_rare(self) -> None:
        """Keep the more used half of the words, none that was used once only; uses count half from then on."""
        n = len(self.code)
        uses = self.uses[:n]
        keep = uses >= max(2, np.partition(uses, n // 2)[n // 2])
        if keep.sum() > 3 * n // 4:
            keep = uses > uses.min()
        words, first, count = list(self.code), self.first[:n][keep], self.count[:n][keep]
        stored = np.maximum(count, 0)
        stops, flat = np.cumsum(stored), _runs(self.flat, first, stored)
        self._forget()
        self.code = {w: i for i, w in enumerate(w for w, k in zip(words, keep.tolist(), strict=True) if k)}
        self.flat, self.used = np.concatenate([flat, self.flat]), len(flat)
        self.first, self.count = np.concatenate([stops - stored, self.first]), np.concatenate([count, self.count])
        self.uses = np.concatenate([uses[keep] // 2, self.uses])

    def _encode(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _remember(self, words: list[str]) -> np.ndarray:
        """Encode new words, append their ids to the flat store and return their numbers there.

        A count of -1 marks words with odd spaces.
        """
        letters, rest, ids, counts = [], [], [], []
        # A word of such letters is one word to both vocabularies: the library's model alone gives its ids.
        tokenize = self.tokenizer.model.tokenize
        for i, w in enumerate(words):
            spelt = self._letters(w)
            if spelt is None:
                rest.append(i)
                continue
            found = [t.id for t in tokenize(spelt)]
            letters.append(i)
            ids += found
            counts.append(len(found))
        for found in self._encode([self._plain(words[i]) for i in rest]):
            ids += found
            counts.append(len(found))
        counts, total, at = np.array(counts, np.int64), len(ids), len(self.code)
        stop = at + len(counts)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), total), np.uint32)])
        if stop > len(self.first):
            more = np.zeros(max(len(self.first), len(counts)), np.int64)
            self.first, self.count = np.concatenate([self.first, more]), np.concatenate([self.count, more])
            self.uses = np.concatenate([self.uses, more])
        self.flat[self.used : self.used + total] = ids
        self.first[at:stop] = self.used + np.cumsum(counts) - counts
        self.count[at:stop] = counts
        if self.spaces_matter:
            odd = [_ODD_SPACE.search(words[i]) is not None for i in rest]
            self.count[stop - len(rest) : stop][odd] = -1
        self.uses[at:stop] = 0
        self.used += total
        order = letters + rest
        self.code.update(zip([words[i] for i in order], range(at, stop)))
        codes = np.empty(len(words), np.int64)
        codes[order] = np.arange(at, stop)
        return codes

    def _letters(self, word: str) -> str | None:
        """How the vocabulary spells a key that is a word of plain letters; None for any other."""
        if word.isalpha():
            bare, before = word, _SPACE_LETTER if self.spaces_matter else ""
        elif self.spaces_matter and word[:1] == _AS_IS and word[1:].isalpha():
            bare, before = word[1:], ""
        elif self.spaces_matter and word[:2] == _AS_IS + " " and word[2:].isalpha():
            bare, before = word[2:], _SPACE_LETTER
        else:
            return None
        if not self.spaces_matter:
            bare = bare.lower()
        if bare.isascii():
            return before + bare
        return before + bare.encode().decode("latin-1").translate(_BYTE_LETTERS) if _LETTERS.fullmatch(bare) else None

    def _plain(self, word: str) -> str:
        """What a key stands for."""
        if not self.spaces_matter or word[0] == "\n":
            return word
        return word[1:] if word[0] == _AS_IS else " " + word

    def _join(self, words: pa.DictionaryArray, keys: list[str], ends: np.ndarray) -> list[np.ndarray | None]:
        """Ids of texts, None for those to be encoded whole.

        ``words`` are those of all texts in order, ``keys`` the distinct ones; ``ends`` says where each text's words end.
        """
        at = words.indices.to_numpy()
        codes = np.fromiter(map(self.code.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            codes[missing] = self._remember([keys[i] for i in missing.tolist()])
        self.uses[codes] += np.bincount(at, minlength=len(keys))
        counts = self.count[codes]
        odd = counts < 0
        np.maximum(counts, 0, out=counts)
        # The ids of this batch's words side by side: near each other in memory for what follows.
        near = _runs(self.flat, self.first[codes], counts)
        lengths = counts[at]
        bounds = np.concatenate([[0], np.cumsum(lengths)])[ends]
        out: list = np.split(_runs(near, (np.cumsum(counts) - counts)[at], lengths), bounds[:-1])
        if odd.any():
            for i in set(np.searchsorted(ends, np.flatnonzero(odd[at]), side="right").tolist()):
                out[i] = None
        return out

    def _by_words(self, texts: pa.Array) -> list[np.ndarray | None]:
        """Ids of texts that are cut at each space and line feed, and before marks at a word's end where that is safe."""
        if self.spaces_matter:
            texts = pc.replace_substring_regex(texts, _MARKS, f"\\1 {_AS_IS}\\2\\3")
            first = pc.binary_join_element_wise(_text(_AS_IS), texts, _text(""))
            texts = pc.replace_substring(first, "\n", " \n")
        else:
            apart = pc.replace_substring_regex(pc.ascii_lower(texts), _MARKS, r"\1 \2\3")
            texts = pc.if_else(pc.match_substring_regex(texts, _DELICATE), texts, apart)
            texts = pc.replace_substring(texts, "\n", " ")
        cut = pc.split_pattern(texts, " ")
        words = cut.values.dictionary_encode()
        distinct = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        keys = pc.binary_join(distinct, _text(" "))[0].as_py().split(" ")
        return self._join(words, keys, cut.offsets.to_numpy()[1:])

    def _by_runs(self, texts: pa.Array) -> list[np.ndarray | None]:
        """Ids of texts whose white space is kept: each word with all of it that stands before."""
        runs = [_RUNS.findall(t) for t in texts.to_pylist()]
        words = pa.array([_AS_IS + r for r in itertools.chain.from_iterable(runs)], pa.large_string()).dictionary_encode()
        return self._join(words, words.dictionary.to_pylist(), np.cumsum([len(r) for r in runs]))

    def ids(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Token ids of each text, a null one counting as empty."""
        if len(self.code) > REMEMBERED_WORDS:
            self._drop_rare()
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        texts = texts.fill_null("")
        spaced = pc.match_substring_regex(texts, _SPACED) if self.spaces_matter else pa.repeat(False, len(texts))
        out: list = [None] * len(texts)
        for cut, which in ((self._by_words, pc.invert(spaced)), (self._by_runs, spaced)):
            places = np.flatnonzero(which.to_numpy(zero_copy_only=False))
            if len(places):
                for i, found in zip(places.tolist(), cut(texts.filter(which)), strict=True):
                    out[i] = found
        whole = [i for i, found in enumerate(out) if found is None]
        for i, found in zip(whole, self._encode([texts[i].as_py() for i in whole]), strict=True):
            out[i] = np.array(found, np.uint32)
        return out


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _runs(store: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The entries of ``store`` in runs of ``counts`` entries from ``first`` on, one run after the other."""
    stops = np.cumsum(counts)
    return store[np.repeat(first - (stops - counts), counts) + np.arange(stops[-1] if len(stops) else 0)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, spaces_matter: bool) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path, spaces_matter)
