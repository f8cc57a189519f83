"""Token ids of whole texts, with what a task has seen kept for the next ones."""

from __future__ import annotations

import re
import struct

#: Words kept in a worker; beyond this the table starts anew.
MOST_WORDS = 400_000
MOST_RUNS = 600_000

#: Letters whose lower case and normal form are one letter each, and marks after them. Such a
#: word is a run of letters and a run of marks to the tokenizer; all else goes to it whole.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")

#: Characters that Python may take for white space and a tokenizer not, or the reverse.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
_WORDS = re.compile(r"[^ \t-\r]+")

_OPEN: dict[str, WordIds] = {}


class WordIds(dict):
    """Bytes of the ids (little-endian, 32 bits) of each word between white space.

    The tokenizer drops white space before it looks for tokens, so the ids of a text are
    those of its words in order.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self._all = Tokenizer.from_file(path)
        self._model = self._all.model
        self._runs: dict[str, bytes] = {}
        self._as_char = str.maketrans({b: c for b, c in enumerate(_byte_characters())})

    def __missing__(self, word: str) -> bytes:
        parts = _PLAIN.fullmatch(word)
        if parts:
            ids = self._run(parts[1].lower())
            if parts[2]:
                ids += self._run(parts[2])
        else:
            found = self._all.encode(word, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = ids
        return ids

    def _run(self, run: str) -> bytes:
        ids = self._runs.get(run)
        if ids is None:
            found = [t.id for t in self._model.tokenize(run.encode().decode("latin-1").translate(self._as_char))]
            ids = struct.pack(f"<{len(found)}I", *found)
            if len(self._runs) >= MOST_RUNS:
                self._runs.clear()
            self._runs[run] = ids
        return ids

    def of(self, text: str) -> bytes:
        words = _WORDS.findall(text) if _UNSURE.search(text) else text.split()
        return b"".join([self[w] for w in words])


def _byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others
    from U+0100 on in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def word_ids(path: str) -> WordIds:
    """The table of this worker; a reused worker keeps it from task to task."""
    if path not in _OPEN:
        _OPEN[path] = WordIds(path)
    return _OPEN[path]
