"""Token ids of whole texts with a public tokenizer, for use inside Spark tasks.

A byte-pair tokenizer cuts a text into pre-tokens first and encodes each alone, so ids of a part that
begins and ends at a certain pre-token border don't depend on its surroundings. Such parts (words, mostly)
repeat, and each is handed to the library once per worker and remembered up to a bound.
"""

from __future__ import annotations

import os
import re
import struct
import sys
from collections.abc import Callable, Iterator

#: Words remembered per worker process, and the longest one worth remembering. Where there are more, those met first stay,
#: as frequent words are met early, and room is made for a fifth.
REMEMBERED, LONGEST = 700_000, 64
#: Words with marks or digits, of which there is no end, that are remembered for a while.
BRIEF = 60_000
#: A space or none, Latin letters, ASCII punctuation without the apostrophe or none: pre-tokens under either tokenizer.
WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: A space that white space neither precedes nor follows always begins a pre-token.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


#: Punctuation that is a pre-token of its own behind a letter or digit.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Words(dict):
    """Words and their ids; a missing one is learned when it is looked up."""

    def __init__(self, meet: Callable[[str], bytes | None]):
        super().__init__()
        self.meet = meet

    def __missing__(self, x: str) -> bytes | None:
        return self.meet(x)


class Encoder:
    """``spaced``: a space belongs to the pre-token after it (byte-level BPE); else white space is dropped.

    ``narrow`` gives ids in ``width`` = 2 bytes where the vocabulary allows it; otherwise they have 4.
    """

    def __init__(self, path: str, spaced: bool, narrow: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.width = 2 if narrow and max(self.tokenizer.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
        self.signs: dict[str, bytes] = {}
        self.known = Words(self._meet)  # words after a lone space; None: white space at an end
        self.brief: list[str] = []

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def library(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pre_token(self, text: str) -> bytes:
        """Ids of what certainly is one pre-token: one space at most, then letters or marks alone."""
        text = text.replace(" ", "\u0120") if text.isascii() and "\n" not in text else text.encode().decode("latin-1").translate(BYTE_LETTERS)
        return self.packed([t.id for t in self.model.tokenize(text)])

    def word(self, letters: str) -> bytes:
        """Ids of letters after a space, remembered."""
        if (ids := self.known.get(letters)) is None:
            self.known[letters] = ids = self.pre_token(" " + letters if self.spaced else letters.lower())
        return ids

    def marks(self, text: str) -> bytes:
        if (ids := self.signs.get(text)) is None:
            ids = self.pre_token(text)
            if len(text) <= 4:  # few of those
                self.signs[text] = ids
        return ids

    def learn(self, text: str) -> bytes:
        """Ids of a string that begins and ends at borders of pre-tokens."""
        if m := WORD.fullmatch(text):
            space, letters, marks = m.groups()
            ids = self.word(letters) if space or not self.spaced else self.pre_token(letters)
            return ids + self.marks(marks) if marks else ids
        if self.spaced and "\n" in text:
            lines = text.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in (lines[0].lstrip(" "), *lines[1:])):
                return self.marks("\n").join(map(self.learn, lines))
        return self.library(text)

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned integers of ``width`` bytes."""
        for text in texts:
            if len(self.brief) > BRIEF or len(self.known) > REMEMBERED + BRIEF:
                self._forget()
            yield self._joined(text, text.split(" ") if self.spaced else text.replace("\n", " ").split(" "))

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def _forget(self) -> None:
        """Drop words met with marks, and where too many are left, those met last."""
        known = self.known
        for x in self.brief:
            del known[x]
        self.brief.clear()
        if len(known) > REMEMBERED:
            for x in list(known)[REMEMBERED * 4 // 5 :]:
                del known[x]

    def _meet(self, x: str) -> bytes | None:
        """Learn a word that follows a lone space; all but plain ones are to be forgotten soon."""
        known, stem = self.known, x.rstrip(MARKS)
        if len(x) > LONGEST:
            # Kept for its text alone, however long it is.
            return None if self.spaced and (x[0].isspace() or x[-1].isspace()) else self.learn(" " + x if self.spaced else x)
        # Lower case may end in a mark of its own, which the library joins with those that follow.
        if len(stem) < len(x) and (stem if self.spaced else stem.lower())[-1:].isalnum() and known.get(stem) is not None:
            ids = known[stem] + self.marks(x[len(stem) :])
        elif not x or self.spaced and (x[0].isspace() or x[-1].isspace()):
            ids = None if self.spaced else b""
        else:
            ids = self.learn(" " + x if self.spaced else x)
            if x.isalpha():
                known[x] = ids
                return ids
        known[x] = ids
        self.brief.append(x)
        return ids

    def _joined(self, text: str, words: list[str]) -> bytes:
        first, rest = words[0], words[1:] if self.spaced else words
        if self.spaced and rest and (not first or first[-1].isspace()):
            return self._with_odd_space(text)
        try:
            ids = b"".join(map(self.known.__getitem__, rest))
        except TypeError:
            return self._with_odd_space(text)
        return self.learn(first) + ids if self.spaced and first else ids

    def _with_odd_space(self, text: str) -> bytes:
        first, *rest = LONE_SPACE.split(text)
        return b"".join(map(self.learn, [first, *[" " + x for x in rest]])) if text else b""


def worker_encoder(path: str, spaced: bool, narrow: bool = False) -> Encoder:
    """This worker's encoder, kept over tasks with the words it knows.

    It hangs on the library's module: functions travel by value, so this one's own globals are new in each task.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_encoders", {})
    if (path, spaced, narrow) not in held:
        held.clear()
        held[path, spaced, narrow] = Encoder(path, spaced, narrow)
    return held[path, spaced, narrow]


def release_encoders() -> None:
    """Let go of the words this worker remembers, in a step that needs its memory for something else."""
    if tokenizers := sys.modules.get("tokenizers"):
        tokenizers.__dict__.pop("_encoders", None)
