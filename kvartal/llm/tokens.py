"""Token ids of whole texts with a public tokenizer, each distinct word encoded once per worker.

A text is cut into units at white space, where the tokenizer cuts as well; the ids of a
text are those of its units, one after another. Units seen lately come from memory. A text
that holds the string of a special token goes to the tokenizer whole, which then gives
that token, as the library does by default.
"""

from __future__ import annotations

import functools
import gc
import operator
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

#: Unicode white space, as the tokenizers' \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Units of byte-level vocabularies, which keep white space: a word with the space before it.
SPACED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Units of vocabularies that drop white space.
BARE = re.compile("[^ \\t\\n\\r]+")
WHITE = re.compile(f"[{SPACE}]")
#: Units kept per worker; longer ones are encoded each time.
KEPT_UNITS, LONGEST_UNIT = 400_000, 48
#: A run of these at a unit's end, after a Latin letter, is encoded apart from it.
MARKS = ".,!?;:*$%&#|)"
#: Letters below this code point are composed already and lower-cased one by one, but for
#: DOTTED, whose lower case ends in a mark.
LATIN_END, DOTTED = "\u0250", "\u0130"
_ID = operator.attrgetter("id")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> list[str]:
    """Letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Ids of units, made when first asked for; the last KEPT_UNITS to twice as many are kept."""

    def __init__(self, make: Callable[[str], bytes | None]) -> None:
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.before.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= LONGEST_UNIT:
            self[unit] = ids
        return ids

    def age(self) -> None:
        if len(self) > KEPT_UNITS:
            self.before = dict(self)
            self.clear()


class _Words(_Known):
    """Ids of what stands between two spaces; parts that hold other white space aren't kept."""

    def __init__(self, make: Callable[[str], bytes], cut: Callable[[str], bytes]) -> None:
        super().__init__(make)
        self.cut = cut

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)  # the usual case: a word that was known before the last ageing
        if ids is None:
            if not part.isalpha() and WHITE.search(part):
                return self.cut(part)
            ids = self.make(part)
        if len(part) <= LONGEST_UNIT:
            self[part] = ids
        return ids


class Encoder:
    """Ids of texts as bytes (little-endian, 32 bits each).

    Parts between single spaces are looked up as they are; a part stands for itself and, where
    the vocabulary keeps white space, for the space before it.
    """

    def __init__(self, path: str, spaced: bool) -> None:
        self.tokenizer, self.spaced = _tokenizer(path), spaced
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = (SPACED if spaced else BARE).findall
        self.units = _Known(self._bare)
        self.words = _Words(self._word, self._cut) if spaced else _Words(self._bare, self._units)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _model(self, letters: str) -> bytes:
        return array("I", list(map(_ID, self.model.tokenize(letters)))).tobytes()

    def _letters(self, word: str) -> str | None:
        """A Latin word as the model reads it, its cut and case being sure; else None."""
        if word.isalpha():
            if word.isascii():
                return word if self.spaced else word.lower()
            if max(word) < LATIN_END and (self.spaced or DOTTED not in word):
                return (word if self.spaced else word.lower()).encode().decode("latin-1").translate(self.letters)
        return None

    def _marked(self, unit: str) -> int:
        """Length of a unit without the marks behind its last letter; 0 without such marks."""
        if unit and unit[-1] in MARKS:
            stem = unit.rstrip(MARKS)
            if stem and stem[-1].isalpha() and stem[-1] < LATIN_END and stem[-1] != DOTTED:
                return len(stem)
        return 0

    def _bare(self, unit: str) -> bytes:
        """A unit without a space before it."""
        if not unit:
            return b""
        if (letters := self._letters(unit)) is not None:
            return self._model(letters)
        if end := self._marked(unit):
            return self.units[unit[:end]] + self.units[unit[end:]]
        return self._library(unit)

    def _word(self, part: str) -> bytes:
        """A part with the space before it."""
        if (letters := self._letters(part)) is not None:
            return self._model(self.letters[32] + letters)
        if end := self._marked(part):
            return self.words[part[:end]] + self.units[part[end:]]
        return self._library(" " + part)

    def _units(self, text: str) -> bytes:
        return b"".join(map(self.units.__getitem__, self.find(text)))

    def _cut(self, part: str) -> bytes:
        """A part with white space in it, and the space before it."""
        first, *units = self.find(" " + part)
        spaced = len(first) > 1 and not WHITE.match(first, 1)  # only the first unit can begin with that space
        head = self.words[first[1:]] if spaced else self.units[first]
        return head + b"".join(map(self.units.__getitem__, units))

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text; a null text has none."""
        gc.disable()  # there are no cycles to find, only millions of strings to look through
        try:
            for text in texts:
                if not text:
                    yield b""
                elif any(s in text for s in self.specials):
                    yield self._library(text)
                elif not self.spaced:
                    yield b"".join(map(self.words.__getitem__, text.split(" ")))
                elif "  " in text:  # runs of spaces are cut in another way
                    yield self._units(text)
                else:
                    first, *parts = text.split(" ")
                    yield self._units(first) + b"".join(map(self.words.__getitem__, parts))
                self.units.age()
                self.words.age()
        finally:
            gc.enable()


@functools.lru_cache(maxsize=2)
def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker, so its memory serves all tasks there. ``spaced``: the vocabulary keeps white space."""
    return Encoder(path, spaced)
