"""Token ids of whole texts through the tokenizers library, one library call per distinct word.

Both vocabularies cut a text at white space before any merge, so the ids of a text are the ids of
its words in a row, and words repeat.  Texts are cut into words in Arrow, where equal words of
neighbouring texts become one, and each distinct word goes through the library once per process:
Latin letters, which are one unit for the merges whatever marks follow them, through its merge model
alone, many at a time, all other words through the whole tokenizer.  Marks behind letters are a unit
too, so such a word is put together from two known ones.  A text whose white space could make a cut
inexact is encoded whole.  A test holds the ids against plain calls.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END = 0
#: Words that a process remembers; beyond it those stay that came more than once.
MOST_WORDS = 1_000_000
#: Texts that are encoded together are at most this many characters, or a single one.
TOGETHER = 3_000_000
#: Words whose ids are put in a row at once, or those of a single text.
GATHERED = 100_000
#: Units of letters that go through the merge model in one call.
UNITS = 400
#: Fewer go through it one at a time.
FEW_UNITS = 200

#: White space other than the four that every vocabulary here treats alike.
ODD_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: For vocabularies that keep white space: anything but single blanks and single line breaks.
ODD_RUNS = rf"  |\n\n| \n|\n |\A[ \n]|[ \n]\z|[\t\r]|{ODD_SPACE}"
#: The same for single texts.
FIND_SPACE, FIND_RUNS = re.compile(ODD_SPACE), re.compile(r"[^\S \n]")
#: What stands in front, Latin letters, ASCII marks or none (no apostrophe): units for every vocabulary here.
PLAIN = re.compile(r"([\n ]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte -> the printable character that stands for it in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: Units on lines of their own, byte by byte, to byte letters; blanks then part the units.
LETTERS = byte_letters() | {ord("\n"): " "}


class _Words(dict):
    """Key -> number of its entry; an unknown key gets the next number and waits in ``fresh``.

    Where white space is kept, the key of a word has the line break before it, if there is one; a
    blank in front of a key says that nothing stands before the word, no such blank that a blank does.
    """

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Encoder:
    """Ids of texts for one vocabulary file."""

    def __init__(self, path: str, keeps_spaces: bool) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        # The merge model alone, over units between blanks.
        self.model = self.library.model
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = CharDelimiterSplit(" ")
        suffix = self.model.end_of_word_suffix or ""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        #: Bytes that an id stands for.
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.n_bytes[k] = len(token.removesuffix(suffix))
        self.keeps_spaces = keeps_spaces
        self.forget()

    def forget(self) -> None:
        """Lets go of all known words; they are looked up again when they come."""
        self.words = _Words()
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int32)
        #: Times that each word came, where equal words of texts that are split together are one.
        self.seen = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _make_room(self) -> None:
        """Beyond `MOST_WORDS`, forgets all words but those that came again since the last time."""
        if len(self.words) <= MOST_WORDS:
            return
        again = self.seen[: len(self.words)] > 1
        if np.count_nonzero(again) > MOST_WORDS // 2:
            self.forget()
            return
        stay = list(compress(self.words, again.tolist()))
        ids, ends = self._gather(np.flatnonzero(again))
        self.forget()
        self.words.update(zip(stay, range(len(stay)), strict=True))
        self._more_room()
        self._keep(range(len(stay)), ids, np.diff(ends))

    def _more_room(self) -> None:
        """Room in the figures of words for all of them."""
        n = len(self.words)
        self.starts, self.lengths, self.seen = (
            _room(x, n) for x in (self.starts, self.lengths, self.seen)
        )

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _split(self, text: str) -> list[str] | None:
        """Words whose ids in a row are those of the text; None if that is not certain."""
        if not self.keeps_spaces:
            return None if FIND_SPACE.search(text) else text.split()
        runs = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        if runs or not text or text[0] in " \n" or text[-1] in " \n" or FIND_RUNS.search(text):
            return None
        words = text.replace("\n", " \n").split(" ")
        words[0] = " " + words[0]
        return words

    def _numbers(self, words: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self._more_room()
        self.seen[numbers] += 1
        return numbers

    def _split_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `_split` for many texts at once: which are certain, numbers of their words, and where each one's begin."""
        odd = pc.match_substring_regex(texts, ODD_RUNS if self.keeps_spaces else ODD_SPACE)
        certain = pc.invert(odd)
        if self.keeps_spaces:
            certain = pc.and_(certain, pc.not_equal(texts, ""))
        if not pc.all(certain).as_py():
            texts = texts.filter(certain)
        if self.keeps_spaces:
            texts = pc.replace_substring(texts, "\n", " \n")
            lists = pc.split_pattern(texts, " ")
        else:
            lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = coded.indices.to_numpy()
        numbers = self._numbers(different)[places]
        begins = np.asarray(lists.offsets, np.int64)
        if self.keeps_spaces:  # the first word has no blank before it
            firsts = begins[:-1]
            numbers[firsts] = [self.words[" " + different[k]] for k in places[firsts]]
        return certain.to_numpy(zero_copy_only=False), numbers, begins

    def _units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units of Latin letters, all in a row, and how many each has."""
        ids, counts = [], []
        if len(units) < FEW_UNITS:
            for unit in units:
                found = self.model.tokenize(unit.encode().decode("latin-1").translate(LETTERS))
                ids += [x.id for x in found]
                counts.append(len(found))
            return np.array(ids, np.uint32), np.array(counts)
        for k in range(0, len(units), UNITS):
            data = "\n".join(units[k : k + UNITS]).encode()
            line = data.decode("latin-1").translate(LETTERS)
            found = self.merges.encode_batch_fast([line], add_special_tokens=False)[0]
            ids.append(np.array(found.ids, np.uint32))
            # The ids of a unit cover its bytes, so its last one ends where the unit does.
            breaks = np.flatnonzero(np.frombuffer(data + b"\n", np.uint8) == ord("\n"))
            stops = breaks - np.arange(len(breaks))
            ends = np.cumsum(self.n_bytes[ids[-1]])
            last = np.searchsorted(ends, stops)
            if len(ends) != last[-1] + 1 or not np.array_equal(ends[last], stops):
                raise ValueError("the vocabulary lacks some byte")
            counts.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self) -> None:
        words, blank = self.words, self.keeps_spaces
        if not words.fresh:
            return
        # Numbers, ids and counts of words by the way they are looked up, in flat lists:
        # lists of lists would keep the garbage collector busy.
        odd, odd_ids, odd_counts = [], [], []
        units, unit_texts = [], []
        joined, parts, part_counts = [], [], []
        # Parts of words are words too: unknown ones join the list while it is read.
        for number, word in enumerate(words.fresh, len(words) - len(words.fresh)):
            if word.isascii() and word.isalpha() and (blank or word == word.lower()):  # most words
                units.append(number)
                unit_texts.append(" " + word if blank else word)
                continue
            plain = PLAIN.fullmatch(word)
            if plain is None:
                text = word[1:] if word[:1] == " " else " " + word if blank and word[:1] != "\n" else word
                ids = self.library.encode(text, add_special_tokens=False).ids
                odd.append(number)
                odd_ids += ids
                odd_counts.append(len(ids))
                continue
            front, letters, marks = plain.groups()
            letters = letters if blank else letters.lower()
            base = " " + letters if front else letters
            if base == word:
                units.append(number)
                unit_texts.append(" " + letters if blank and not front else letters)
                continue
            before = len(parts)
            if front == "\n":
                parts.append(words[" \n"])
            parts.append(words[base])
            if marks:
                parts.append(words[" " + marks])
            joined.append(number)
            part_counts.append(len(parts) - before)
        words.fresh = []
        self._more_room()
        if odd:
            self._keep(odd, np.array(odd_ids, np.uint32), np.array(odd_counts))
        if units:
            self._keep(units, *self._units(unit_texts))
        if joined:
            ids, ends = self._gather(np.array(parts))
            self._keep(joined, ids, np.diff(ends[np.cumsum([0, *part_counts])]))

    def _keep(self, numbers: Sequence[int], ids: np.ndarray, counts: np.ndarray) -> None:
        """The ids, ``counts`` of them for each number."""
        at, self.used = self.used, self.used + len(ids)
        self.flat = _room(self.flat, self.used)
        self.flat[at : self.used] = ids
        numbers = np.asarray(numbers, np.int64)
        self.lengths[numbers] = counts
        self.starts[numbers] = at + np.cumsum(counts) - counts

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many there are before each word and in all."""
        lengths = self.lengths[numbers]
        ends = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        kind = np.int32 if max(self.used, ends[-1]) < 1 << 31 else np.int64
        at = np.repeat((self.starts[numbers] - ends[:-1]).astype(kind), lengths)
        at += np.arange(ends[-1], dtype=kind)
        return self.flat[at], ends

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text as unsigned 32-bit numbers, without an end id."""
        words = self._split(text)
        if words is None:
            return self.whole(text)
        self._make_room()
        numbers = self._numbers(words)
        self._learn()
        return self._gather(numbers)[0]

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; what is new in any of them is looked up at once."""
        self._make_room()
        certain, numbers, begins = self._split_all(pa.array(texts, pa.large_string()))
        self._learn()
        k = start = stop = 0
        for text, sure in zip(texts, certain, strict=True):
            if not sure:
                yield self.whole(text)
                continue
            if k == stop:  # the next texts, of about `GATHERED` words
                start = k
                stop = max(k + 1, np.searchsorted(begins, begins[k] + GATHERED, "right") - 1)
                ids, ends = self._gather(numbers[begins[start] : begins[stop]])
                ends = ends[begins[start : stop + 1] - begins[start]]
            yield ids[ends[k - start] : ends[k - start + 1]]
            k += 1


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy with room for ``size`` and as much again."""
    if size <= len(array):
        return array
    larger = np.zeros(2 * size, array.dtype)
    larger[: len(array)] = array
    return larger


@lru_cache(maxsize=4)
def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """One encoder per process and vocabulary; Spark's tasks are the only parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, keeps_spaces)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents_ids(
    rows: Iterable[tuple[object, str | None]], path: str, keeps_spaces: bool
) -> Iterator[tuple[object, np.ndarray]]:
    """(key, ids with the end id) of (key, text) rows in their order; NULL reads as empty."""
    coder = encoder(path, keeps_spaces)
    keys, texts, size = [], [], 0

    def done() -> Iterator[tuple[object, np.ndarray]]:
        for key, ids in zip(keys, coder.encode_all(texts), strict=True):
            yield key, np.append(ids, np.uint32(END))

    for key, text in rows:
        text = text or ""
        if texts and size + len(text) > TOGETHER:
            yield from done()
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(text)
        size += len(text)
    if texts:
        yield from done()


def little_endian(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()
