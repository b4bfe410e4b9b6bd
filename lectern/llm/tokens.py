"""Token ids of whole texts with a public vocabulary, as the tokenizers library gives them.

Byte-pair merges stay inside a word, and most words have been seen before. So each worker splits
a run of plain Latin texts at white space, cuts the different pieces of the run into words the way
the vocabulary's own pattern does, has the library encode every word that is new to it, and puts
texts together from the places of words in pieces and of pieces in texts, all in whole columns.
Texts with other characters, control characters or a special token's marks go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of one generation kept per worker. When it is full it becomes the older one, whose words
#: move back when they are met; the older one's rest is forgotten. This only saves time.
KEPT_WORDS = 350_000
#: Characters of a run of texts, and of texts or words that the library encodes at once.
RUN_CHARS, WHOLE_CHARS = 4_000_000, 50_000
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")  # the dotted I has two lower-case letters
# Fixed patterns of the two vocabularies, as they are inside a piece; ends of words become \0.
_LOWER_WORDS = r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}\x00]+"
_BYTE_LEVEL = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+"
#: The last line end before a word stands alone.
_LAST_BREAK = r"([\t\n\r])([^\t\n\r])"
#: White space that pieces split at single spaces would cut in two: these texts go to the library whole.
_LONE_SPACE = re.compile(r"[ \t\n\r] (?:[ \t\n\r]|$)|^ [ \t\n\r]")
_encoders: dict = {}


def _has_lone_space(text: str) -> bool:
    near = "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " "
    return near and _LONE_SPACE.search(text) is not None


class Encoder:
    """``drops_space``: the vocabulary is of lower-case words without white space. ``kept``: words of a generation."""

    def __init__(self, path: str, drops_space: bool, kept: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space, self.kept = Tokenizer.from_file(path), drops_space, kept
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        """The library's encodings are many times as large as the ids, so few are there at once."""
        out = []
        for run in batches_of(texts, WHOLE_CHARS):
            out += [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
        return out

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        texts = list(texts)
        out = [b""] * len(texts)
        whole, plain = [], []
        for at, text in enumerate(texts):
            if text:
                odd = "<|" in text or _OTHER.search(text) or not self.drops_space and _has_lone_space(text)
                (whole if odd else plain).append(at)
        for found, chosen in ((self._whole, whole), (self._from_pieces, plain)):
            for at, ids in zip(chosen, found([texts[at] for at in chosen]) if chosen else (), strict=True):
                out[at] = ids
        return out

    def _from_pieces(self, texts: list[str]) -> list[bytes]:
        """Between a piece and the next one the vocabulary's pattern always cuts."""
        split = pc.ascii_split_whitespace if self.drops_space else lambda x: pc.split_pattern(x, " ")
        in_texts = split(pa.array(texts, pa.string()))
        coded, ends = in_texts.flatten().dictionary_encode(), in_texts.offsets.to_numpy()
        codes, pieces = coded.indices.to_numpy(), coded.dictionary
        alike = pc.utf8_is_alpha(pieces)
        if self.drops_space:
            pieces = pc.utf8_lower(pieces)
        else:  # a space goes with the word that follows; the first piece of a text has none
            first = pieces.take(pa.array(codes[ends[:-1]]))
            codes = codes.copy()
            codes[ends[:-1]] = np.arange(len(pieces), len(pieces) + len(first))
            pieces = pa.concat_arrays([pc.binary_join_element_wise("", pieces, " "), first])
            alike = pa.concat_arrays([alike, pc.utf8_is_alpha(first)])
        # Pieces of letters are words as they are; they come first from here on.
        letters = alike.to_numpy(zero_copy_only=False)
        turned = np.argsort(~letters, kind="stable")
        place = np.empty(len(turned), np.int64)
        place[turned] = np.arange(len(turned))
        n, mixed = int(letters.sum()), pieces.filter(pc.invert(alike))
        if self.drops_space:
            marked = pc.replace_substring_regex(mixed, _LOWER_WORDS, "\\0\0")
        else:
            marked = pc.replace_substring_regex(pc.replace_substring_regex(mixed, _LAST_BREAK, "\0\\1\0\\2"), _BYTE_LEVEL, "\0\\0\0")
        in_mixed = pc.split_pattern(marked, "\0")
        words = pa.concat_arrays([pieces.filter(alike), in_mixed.flatten()]).dictionary_encode()
        in_pieces = np.concatenate([np.arange(n), n + in_mixed.offsets.to_numpy()])
        ids = self._learn(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, after = _put_together(np.frombuffer(b"".join(ids), "<u4"), sizes, words.indices.to_numpy())
        codes = place[codes]
        flat, after = _put_together(flat, np.diff(after[in_pieces]), codes)
        bounds = after[ends]
        return [flat[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Their ids."""
        known, older = self.known, self.older
        found = list(map(known.get, words))
        new = []
        for at, ids in enumerate(found):
            if ids is None:
                found[at] = older.get(words[at])
                if found[at] is None:
                    new.append(at)
                else:
                    known[words[at]] = found[at]
        if new:
            for at, ids in zip(new, self._whole([words[at] for at in new]), strict=True):
                found[at] = known[words[at]] = ids
        if len(known) > self.kept:
            self.known, self.older = {}, known
        return found


def _put_together(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat`` holds runs of ``sizes``; the runs named by ``codes`` side by side, and where each begins."""
    starts, taken = np.cumsum(sizes) - sizes, sizes[codes]
    after = np.concatenate([[0], np.cumsum(taken)])
    return flat[np.repeat(starts[codes] - after[:-1], taken) + np.arange(after[-1])], after


def encoder(path: str, drops_space: bool, kept: int = KEPT_WORDS) -> Encoder:
    """One per worker process."""
    key = (path, drops_space, kept)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        _encoders[key] = Encoder(path, drops_space, kept)
    return _encoders[key]


def batches_of(texts: Iterable[str | None], chars: int = RUN_CHARS) -> Iterable[list[str | None]]:
    """Runs of texts of about so many characters, one at least."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text or "")
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
