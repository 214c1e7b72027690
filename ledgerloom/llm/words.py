"""Splitting texts into the words that the public BPE tokenizers encode one by one.

A splitter gives exactly the pre-tokens of the tokenizers library. ASCII texts and texts
of Latin letters and common punctuation are split by patterns of our own; texts with any
other character, whose classes may depend on a Unicode version, by the library itself.
Strings of special tokens are words of their own, as the library has it.

Where no word holds white space, texts are cut there first: `Encoded.texts` lets Arrow
number the different pieces of many texts, looks each of them up once and puts the ids of
the texts together by number.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters whose classes are the same in all Unicode versions of the last decades.
PLAIN = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]*")
#: Words encoded so far that a task keeps at most (about 200 bytes each).
CACHE = 300_000


class Splitter:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        specials = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.marks = specials
        self.special_ids = {w: [self.tokenizer.token_to_id(w)] for w in specials}
        self.tokenize = self.tokenizer.model.tokenize
        self.shown = dict(enumerate(_byte_chars()))
        self.normal = self.tokenizer.normalizer
        self.pre = self.tokenizer.pre_tokenizer
        if self.normal is None:
            parts = r"'(?:[stmd]|re|ve|ll)| ?{L}+| ?{N}+| ?[^{S}{X}]+|[{S}]+(?![^{S}])|[{S}]+"
        else:
            # Words are normal already, and normal forms of normal forms could differ.
            self.tokenizer.normalizer = normalizers.Sequence([])
            parts = r"'(?:[stmd]|re|ve|ll)|{L}+|{N}|[^{S}{X}]+"
        put = lambda letter, digit, space, both: parts.replace("{L}", letter).replace("{N}", digit).replace("{S}", space).replace("{X}", both)
        self.ascii = re.compile(put("[A-Za-z]", "[0-9]", "\\t-\\r ", "A-Za-z0-9")).findall
        self.latin = regex.compile(put(r"\p{L}", r"\p{N}", SPACE, r"\p{L}\p{N}")).findall

    def words(self, text: str) -> list[str]:
        if self.special and any(m in text for m in self.marks):
            return [w for i, part in enumerate(self.special.split(text)) for w in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text if self.normal is None else text.lower())
        if PLAIN.fullmatch(text):
            # Composed already; white space, which normal forms squeeze, is in no word.
            return self.latin(text if self.normal is None else text.lower())
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def lowered(self, text: str) -> str | None:
        """A text whose words are those of its pieces between white space, one after the other; None if that doesn't hold for it."""
        if self.normal is None or any(m in text for m in self.marks) or not PLAIN.fullmatch(text):
            return None
        return text.lower()

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: of a special token its own, else the model's for the word's bytes, written as the vocabulary writes them."""
        return list(map(self.word, words))

    def word(self, word: str) -> list[int]:
        return self.special_ids.get(word) or [t.id for t in self.tokenize(self._shown(word))]

    def _shown(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return word.encode().decode("latin-1").translate(self.shown)

    def pieces(self) -> list[bytes]:
        """The bytes that each id stands for."""
        byte = {c: b for b, c in enumerate(_byte_chars())}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            out[i] = bytes(byte[c] for c in token)
        return out


def _byte_chars() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it is visible, else the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    """The worker's splitter of this file."""
    return Splitter(path)


class Encoded(dict):
    """Words met so far with their ids as bytes of 32-bit numbers; a new word is encoded when it is asked for."""

    def __init__(self, split: Splitter, most: int = CACHE):
        self.split, self.most = split, most

    def __missing__(self, word: str) -> bytes:
        self[word] = out = array("I", self.split.word(word)).tobytes()
        return out

    def ids(self, words: list[str]) -> bytes:
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, words))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        lowered = [self.split.lowered(t) for t in texts]
        # Other white space than ASCII's stays in pieces; no word holds it.
        cut = pc.ascii_split_whitespace(pa.array([t or "" for t in lowered], pa.large_string()))
        coded = cut.values.dictionary_encode()
        if len(self) > self.most:
            self.clear()
        own, plain, latin, join = self.__getitem__, self.split.ascii, self.split.latin, b"".join
        each = [own(p) if p.isalpha() else join(map(own, plain(p) if p.isascii() else latin(p))) for p in coded.dictionary.to_numpy(zero_copy_only=False)]
        n = np.fromiter(map(len, each), np.int64, len(each)) // 4
        number = coded.indices.to_numpy()
        run = n[number]
        ends = np.cumsum(run)
        at = np.repeat((np.cumsum(n) - n)[number] - (ends - run), run)
        at += np.arange(len(at))
        flat = np.frombuffer(b"".join(each), "<u4")[at]
        cuts = np.concatenate(([0], ends))[cut.offsets.to_numpy()].tolist()
        return [
            flat[a:b] if low is not None else np.frombuffer(self.ids(self.split.words(t)), "<u4")
            for t, low, a, b in zip(texts, lowered, cuts, cuts[1:], strict=False)
        ]
