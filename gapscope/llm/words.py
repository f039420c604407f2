"""Word hashes of texts by a per-worker dictionary of white-space separated chunks.

A chunk's words are its runs of letters, digits and underscores, lower-cased;
each word is its XXH64.  The dictionary only saves work: it is emptied when it
has grown to ``ENTRIES`` chunks, and a miss is computed anew.

``unit_hashes`` differs in scripts written without blanks between words
(``UNSPACED``): there each letter is a word of its own.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

ENTRIES = 200_000
#: Thai, Lao, Myanmar, Khmer, kana and Han blocks
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
            (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF))
_UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_WORD = re.compile(r"\w+")
_UNIT = re.compile(rf"(?:(?![{_UNSPACED}])\w)+|[{_UNSPACED}](?<=\w)")


class _Chunks(dict):
    def __init__(self, word: re.Pattern):
        super().__init__()
        self.word = word

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= ENTRIES:
            self.clear()
        found = b"".join(xxhash.xxh64_digest(w.encode()) for w in self.word.findall(chunk.lower()))
        if len(chunk) < 64:
            self[chunk] = found
        return found


_CHUNKS, _UNITS = _Chunks(_WORD), _Chunks(_UNIT)


def word_hashes(text: str | None) -> np.ndarray:
    """One unsigned 64-bit hash per word, in text order."""
    return np.frombuffer(b"".join(map(_CHUNKS.__getitem__, (text or "").split())), np.uint64)


def unit_hashes(text: str | None) -> np.ndarray:
    """As ``word_hashes``, with single letters as the words of scripts without blanks."""
    return np.frombuffer(b"".join(map(_UNITS.__getitem__, (text or "").split())), np.uint64)


def forget() -> None:
    """Empty the dictionaries: the worker may go on with other work."""
    _CHUNKS.clear()
    _UNITS.clear()


def unit_sql(text: str) -> str:
    """DuckDB list of the words that ``unit_hashes`` hashes."""
    spaced = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED)
    return f"regexp_extract_all(regexp_replace(lower(coalesce({text}, '')), '([{spaced}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_]+')"
