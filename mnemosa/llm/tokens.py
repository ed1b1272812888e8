"""Token ids of whole texts for tokenizers whose words are independent, by way of a cache of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

from .textkit import LOWER, Words, span_hashes

#: The pattern that the vocabulary's file gives for its words.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks of these characters only are lower-cased and cut here; they are composed and each has one lower-case form.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-įı-ɏ]*")
MOST_CHUNKS, MOST_TEXTS, AT_ONCE = 1 << 20, 1 << 16, 1000
#: Signs that often end a chunk of letters; each is a word of its own.
TAILS = b".,"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Known:
    """Numbers by 64-bit hash in sorted arrays: 16 bytes for each, where a dict takes over 100."""

    def __init__(self):
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 if there is none."""
        at = np.searchsorted(self.keys, keys)
        found = np.append(self.numbers, -1)[at]
        found[np.append(self.keys, np.uint64(0))[at] != keys] = -1
        return found

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """keys: new ones, in order."""
        at = np.searchsorted(self.keys, keys)
        self.keys, self.numbers = np.insert(self.keys, at, keys), np.insert(self.numbers, at, numbers)


class WordIds:
    """Ids of texts by a tokenizer that drops white space and never joins characters across it.

    A text's ids are those of its chunks between white space, one after another.
    The chunks of a run of texts are told apart by 64-bit hashes.  A chunk of ASCII
    letters, with or without one of TAILS behind, is known by the hash of its letters
    in lower case; others are cut into words here, or go to the tokenizer whole if
    they have unusual characters or the strings of special tokens.  What is known is
    kept up to a bound on chunks; beyond it the cache starts anew.
    """

    _open: dict[str, WordIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tails = np.array([0, *(self.tokenizer.encode(chr(t), add_special_tokens=False).ids[0] for t in TAILS)], "<u4")
        self._empty()

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One for each worker process and file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _empty(self) -> None:
        self.ids, self.first = np.zeros(1 << 16, "<u4"), np.zeros(1, np.int64)  # entry k has ids[first[k]:first[k+1]]
        self.letters = Known()  # entries of words of letters
        self.texts: dict[str, bytes] = {}  # ids of other words
        self.chunks = Known()  # places of chunks in entry and tail
        self.entry, self.tail = np.zeros(0, np.int64), np.zeros(0, np.int8)

    def _add(self, new: list[bytes]) -> np.ndarray:
        """The numbers of new entries."""
        size = np.array([len(x) // 4 for x in new], np.int64)
        used, n = int(self.first[-1]), len(self.first) - 1
        end = used + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(2 * end, "<u4")])
        self.ids[used:end] = np.frombuffer(b"".join(new), "<u4")
        self.first = np.concatenate([self.first, used + np.cumsum(size)])
        return np.arange(n, n + len(new))

    def _encode(self, words: list[str]) -> list[bytes]:
        """The packed ids of words, some at a time: the tokenizer tells which word an id is of."""
        out = []
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, cuts = np.array(found.ids, "<u4"), np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            out += [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def _other(self, missing: list[bytes]) -> list[bytes]:
        """The packed ids of chunks that aren't letters only."""
        plain, odd = {}, []
        for chunk in missing:
            text = chunk.decode()
            if PLAIN.fullmatch(text) and not ("<" in text and any(s in text for s in self.special)):
                plain[chunk] = PATTERN.findall(text.lower())
            else:
                odd.append((chunk, text))
        if len(self.texts) > MOST_TEXTS:
            self.texts.clear()
        new = list({w for ws in plain.values() for w in ws if w not in self.texts})
        self.texts.update(zip(new, self._encode(new), strict=True))
        found = {chunk: b"".join([self.texts[w] for w in ws]) for chunk, ws in plain.items()}
        for i in range(0, len(odd), AT_ONCE):
            some = odd[i : i + AT_ONCE]
            for (chunk, _), e in zip(some, self.tokenizer.encode_batch([t for _, t in some], add_special_tokens=False), strict=True):
                found[chunk] = np.array(e.ids, "<u4").tobytes()
        return [found[c] for c in missing]

    def _learn(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and tail of the chunks data[a:b]."""
        tail = np.zeros(len(a), np.int8)
        for k, sign in enumerate(TAILS, 1):
            tail[(data[b - 1] == sign) & (b - a > 1)] = k
        core = b - (tail > 0)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        plain = letters[core] - letters[a] == core - a
        tail[~plain] = 0
        entry = np.zeros(len(a), np.int64)
        low = LOWER[data]
        hashes, first, which = np.unique(span_hashes(low, a[plain], core[plain]), return_index=True, return_inverse=True)
        at = self.letters.find(hashes)
        if len(new := np.flatnonzero(at < 0)):
            text, begin, end = low.tobytes(), a[plain][first[new]].tolist(), core[plain][first[new]].tolist()
            at[new] = self._add(self._encode([text[x:y].decode() for x, y in zip(begin, end, strict=True)]))
            self.letters.add(hashes[new], at[new])
        entry[plain] = at[which]
        if not plain.all():
            text = data.tobytes()
            entry[~plain] = self._add(self._other([text[x:y] for x, y in zip(a[~plain].tolist(), b[~plain].tolist(), strict=True)]))
        return entry, tail

    def packed(self, column: pa.Array) -> list[bytes]:
        """The ids of each row's text, as little-endian unsigned 32-bit numbers."""
        words = Words(column)
        hashes, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.chunks) > MOST_CHUNKS:
            self._empty()
        at = self.chunks.find(hashes)
        if len(new := np.flatnonzero(at < 0)):
            entry, tail = self._learn(words.data, words.starts[first[new]], words.ends[first[new]])
            at[new] = np.arange(len(self.entry), len(self.entry) + len(new))
            self.entry, self.tail = np.concatenate([self.entry, entry]), np.concatenate([self.tail, tail])
            self.chunks.add(hashes[new], at[new])
        entry, tail = self.entry[at][which], self.tail[at][which]
        begin = self.first[entry]
        own = self.first[entry + 1] - begin
        ends = np.cumsum(own + (tail > 0))
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, "<u4")
        behind = np.zeros(len(ids), bool)
        behind[ends[tail > 0] - 1] = True
        ids[behind] = self.tails[tail[tail > 0]]
        ids[~behind] = self.ids[np.arange(own.sum()) + np.repeat(begin - (np.cumsum(own) - own), own)]
        edges = np.concatenate([[0], ends])[words.bounds].tolist()
        return [ids[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
