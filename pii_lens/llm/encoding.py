"""Token ids by the tokenizers library, with what repeats encoded once.

A text is cut at single spaces and line feeds, which are borders of the tokenizer's own pre-tokens, and the ids of each
part are kept in a bounded cache. Parts of plain letters go straight to the library's BPE model; all others, and texts
with a part that ends in white space or with the string of an added token, go through the library whole. Texts that come
together are cut together: each of their distinct parts is looked up once, and their ids are laid out by number. New
words after a space go to the library's model many in a call, where no merge of it can join a word to the next one's
space. Tests hold the ids against the library's.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Parts kept by a worker, and the longest one that is kept. A full cache goes on with those met lately.
CACHE, LONGEST = 500_000, 100
#: Characters of texts that are cut together, unless one alone has more.
TOGETHER = 4 << 20
#: Words in a call of the model; the model keeps short sequences in a cache of its own, and so many words are longer.
CALL = 48

#: Letters of words, signs that may follow them (ASCII's but the apostrophe), and a word, at the start of a line perhaps.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = "^\n?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
ALONE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


BYTE_CHARS = _byte_chars()
BYTE_TABLE = dict(enumerate(BYTE_CHARS))


def _apart(spec: dict) -> bool:
    """Whether a byte-level model gives for words of letters that follow each other, each after a space, the ids of each alone."""
    model = spec["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    space = BYTE_CHARS[32]
    ends = re.compile(f"{space}?[A-Za-z{''.join(BYTE_CHARS[b] for b in (0xC3, *range(0x80, 0xC0)))}]+")
    pairs = (x.split(" ") if isinstance(x, str) else x for x in model["merges"])
    return not any(b[0] == space and ends.fullmatch(a) for a, b in pairs)


class OddSpace(Exception):
    """White space that can't be told apart part by part."""


class Parts(dict):
    """From a part of a text to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, before: str = "", lower: bool = False, cache: int | None = None):
        self.tokenizer, self.tokenize, self.before, self.lower = tokenizer, tokenizer.model.tokenize, before, lower
        self.byte_before = "".join(BYTE_CHARS[b] for b in before.encode())
        self.after, self.old, self.cache = self, {}, cache or CACHE

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        if self.lower:
            word = word.lower()
        if not word.isascii():
            word = "".join(map(BYTE_CHARS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenize(self.byte_before + word)]).tobytes()

    def odd(self, part: str) -> bytes:
        m = LETTERS.fullmatch(part)
        if m is None:
            return self.encoded(self.before + part) if part else b""
        return self[m[1]] + self.after[m[2]] if m[2] else self.letters(part)

    def look(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each part; None for white space that can't be told apart."""
        found = list(map(self.get, parts))
        for k, ids in enumerate(found):
            if ids is None:
                try:
                    found[k] = self[parts[k]]
                except OddSpace:
                    pass
        return found

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.letters(part) if part.isascii() and part.isalpha() else self.odd(part)
        if len(part) <= LONGEST:
            if len(self) >= self.cache // 2:  # what is in use comes back from the old ones
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Spaced(Parts):
    """Parts after a space, or after the line feed that they begin with."""

    def __init__(self, tokenizer, plain: Parts, apart: bool):
        super().__init__(tokenizer, " ", cache=plain.cache)
        self.after, self.feed, self.apart = plain, plain.encoded("\n"), apart
        self.begins = np.zeros(max(tokenizer.get_vocab().values(), default=0) + 1, bool)  # ids that begin with a space
        self.begins[[k for token, k in tokenizer.get_vocab().items() if token.startswith(self.byte_before)]] = True

    def look(self, parts: list[str]) -> list[bytes | None]:
        if not self.apart:
            return super().look(parts)
        found = list(map(self.get, parts))
        gone = [k for k, ids in enumerate(found) if ids is None]
        if self.old:
            for k, ids in zip(gone, list(map(self.old.get, [parts[k] for k in gone]))):
                found[k] = ids
        words: tuple[list[int], list[int]] = [], []  # of ASCII, and others
        rest = []
        for k in gone:
            part = parts[k]
            if found[k] is not None:
                continue
            if part.isascii():
                (words[0] if part.isalpha() else rest).append(k)
            else:
                (words[1] if ALONE.fullmatch(part) else rest).append(k)
        for some in words:
            for k, ids in zip(some, self.in_calls([parts[k] for k in some])):
                found[k] = ids
        for k in rest:
            try:
                found[k] = self.odd(parts[k])
            except OddSpace:
                pass
        full = len(self) + len(self.old) + len(gone) > self.cache
        kept = {parts[k]: found[k] for k in (range(len(parts)) if full else gone) if found[k] is not None and len(parts[k]) <= LONGEST}
        if full:  # what is in use stays, and some of what came last
            self.old = {}
            self.trim(self.cache // 4)
        self.update(islice(kept.items(), self.cache // 2) if full else kept)
        return found

    def trim(self, most: int) -> None:
        late = dict(islice(self.items(), max(0, len(self) - most), None))
        self.clear()
        self.update(late)

    def __missing__(self, part: str) -> bytes:
        if len(self) > self.cache // 2:  # parts that came together take all the room, one by one they leave half to old ones
            self.trim(self.cache // 2)
        return super().__missing__(part)

    def in_calls(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone."""
        whole = len(words) // CALL * CALL
        got: array = array("I")
        for lo in range(0, whole, CALL):
            text = " " + " ".join(words[lo : lo + CALL])
            text = text.replace(" ", self.byte_before) if text.isascii() else text.encode().decode("latin-1").translate(BYTE_TABLE)
            got.extend([t.id for t in self.tokenize(text)])
        ids = got.tobytes()
        starts = (4 * np.flatnonzero(self.begins[np.array(got, np.intp)])).tolist()
        if len(starts) != whole:  # the vocabulary has no space
            return list(map(self.letters, words))
        return [ids[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])] + list(map(self.letters, words[whole:]))

    def odd(self, part: str) -> bytes:
        if not part or part[-1].isspace():
            raise OddSpace
        if part[0] == "\n":
            if part[1].isspace():
                raise OddSpace
            return self.feed + self.after[part[1:]]
        return super().odd(part)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """``ids(text)`` as bytes, for a tokenizer file."""

    def __init__(self, path: str, cache: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        #: Strings that the library takes for tokens of their own, whatever stands around them.
        self.added = [t["content"].lower() for t in spec["added_tokens"]]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = spec["pre_tokenizer"] or {}
        split = pre.get("pretokenizers", [{}])[0]
        self.plain = Parts(self.tokenizer, lower="Lowercase" in kinds, cache=cache)
        if kinds == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert"):
            self.parts = self._words
        elif spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.spaced = Spaced(self.tokenizer, self.plain, _apart(spec))
            self.parts = self._bytes
        else:
            self.parts = self.plain.encoded

    def ids(self, text: str) -> bytes:
        return self.plain.encoded(text) if self.added and self._has_added(text) else self.parts(text)

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        group: list[str] = []
        chars = 0
        for text in texts:
            if group and chars + len(text) > TOGETHER:
                yield from self._group(group)
                group, chars = [], 0
            group.append(text)
            chars += len(text)
        yield from self._group(group)

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        if self.parts in (self._words, self._bytes):
            plain = [k for k, text in enumerate(texts) if 0 < len(text) <= TOGETHER and not (self.added and self._has_added(text))]
            for k, ids in zip(plain, self._together(pa.array([texts[k] for k in plain], pa.string())) if plain else ()):
                out[k] = ids
        return [np.frombuffer(self.ids(text), "<u4") if ids is None else ids for text, ids in zip(texts, out)]

    def _together(self, texts: pa.Array) -> list[np.ndarray | None]:
        """Ids of texts that aren't empty; None for those that must go through the library whole."""
        by_space = self.parts == self._bytes
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if by_space else " "), " ")
        starts = cut.offsets.to_numpy()[:-1]
        coded = cut.values.dictionary_encode()
        codes, parts = coded.indices.to_numpy(), coded.dictionary
        # A word and the signs after it are looked up apart; all else whole.
        word = pc.utf8_rtrim(parts, SIGNS)
        known = pc.match_substring_regex(word, WORD)
        word = pc.if_else(known, word, parts).dictionary_encode()
        signed = pc.and_(known, pc.not_equal(pc.binary_length(pc.utf8_rtrim(parts, SIGNS)), pc.binary_length(parts)))
        signs = pc.replace_substring_regex(parts.filter(signed), WORD[:-1], "").dictionary_encode()
        found = pa.array((self.spaced if by_space else self.plain).look(_strings(word.dictionary)), pa.binary())
        after = np.zeros(len(parts), np.int32)
        after[signed.to_numpy(zero_copy_only=False)] = signs.indices.to_numpy() + 1
        ends = pa.array([b"", *self.plain.look(_strings(signs.dictionary))], pa.binary())
        ids = pc.binary_join_element_wise(found.take(word.indices), ends.take(pa.array(after)), b"")  # null for white space as before
        if by_space:
            firsts = _strings(parts.take(pa.array(codes[starts])))
            ids = pa.concat_arrays([ids, pa.array([None if not x or x[-1].isspace() else self.plain[x] for x in firsts], pa.binary())])
            codes = codes.copy()
            codes[starts] = np.arange(len(firsts)) + len(parts)
        laid = ids.take(pa.array(codes))
        whole = ~np.logical_or.reduceat(laid.is_null().to_numpy(zero_copy_only=False), starts)
        ends = np.frombuffer(laid.buffers()[1], np.int32)[: len(laid) + 1] // 4
        data = np.frombuffer(laid.buffers()[2] or b"", "<u4", ends[-1])
        cuts = ends[np.append(starts, len(laid))].tolist()
        return [data[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], whole.tolist())]

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(t in low for t in self.added)

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))

    def _bytes(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        if not first or first[-1].isspace():
            return self.plain.encoded(text)
        try:
            return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))
        except OddSpace:
            return self.plain.encoded(text)


@lru_cache(maxsize=2)
def encoder(path: str, cache: int | None = None) -> Encoder:
    """One for each worker and file."""
    return Encoder(path, cache)
