"""Token ids of whole texts by a public byte-level BPE file, as unsigned 16-bit arrays.

The pre-tokenizer splits at white space first and inside a run of other characters by
character class; no token crosses from one run into the next, nor from letters into marks that end a run. So a text is cut into
units (a run with the blank before it, its last marks apart, or white space), each distinct unit is encoded
once per worker, and the ids of a text are the joined ids of its units. Units are kept
in a bounded table; when it is full it becomes the old one, from which units come back as they are met, and the old one before it goes, so
frequent units stay. The vocabulary is read from the
``tokenizers`` JSON file; units are encoded from its ranks (in this kind of file a
merge's rank is the order of its id), which the tests hold against ``tokenizers``. With
``added_tokens`` a text is first cut at the file's added tokens, which stand for their ids
(the default of ``tokenizers``); without, they are spelled (``encode_special_tokens``).
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa

from trellis.llm.common import slices, texts_of

_SPACE = "\t-\r\x85 \xa0  -     　"  # fixed: Unicode White_Space
_LETTER = "A-Za-zÀ-ÖØ-öø-ʯ"  # some of the letters, in ranges without anything else
# a word before white space or before marks that end the run, those marks, any other run, white space
_UNIT = re.compile(f" ?[{_LETTER}]+(?=[{_SPACE}]|[.,;:!?]*(?![^{_SPACE}]))|[.,;:!?]+(?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
UNITS = 150_000


# The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    """Character -> byte of the vocabulary's spelling: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    a = array("H", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class _Units(dict):
    """Unit -> its ids as little-endian 16-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        byte = _byte_characters()
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take blanks along or stand alone")
        self.added = {t["content"]: _packed([t["id"]]) for t in spec["added_tokens"] if t["id"] < 1 << 16}
        if max(ranks.values()) >= 1 << 16 or len(self.added) < len(spec["added_tokens"]):
            raise ValueError("ids do not fit 16 bits")
        bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.encode_piece = bpe.encode_ordinary, bpe._core_bpe.encode_single_piece
        self.old: dict[str, bytes] = {}

    def grow_old(self) -> None:
        if len(self) > UNITS:
            self.old = dict(self)
            self.clear()

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is not None:
            pass
        elif unit.removeprefix(" ").isalpha():  # letters are one piece to the pre-tokenizer
            ids = _packed(self.encode_piece(unit.encode()))
        elif len(unit) > 2 and unit[-1] in ".,!?;:" and unit[1:-1].isalpha():
            ids = self[unit[:-1]] + self[unit[-1]]  # letters and the mark are different classes
        else:
            ids = _packed(self.encode(unit))
        if len(unit) <= 64:
            self[unit] = ids
        return ids


@cache
def _units(path: str) -> _Units:
    return _Units(path)


def encoder(path: str, added_tokens: bool = False):
    """text -> bytes of its ids (unsigned 16 bit, little-endian)."""
    units = _units(path)

    def spelled(text: str) -> bytes:
        units.grow_old()
        return b"".join(map(units.__getitem__, _UNIT.findall(text)))

    if not added_tokens or not units.added:
        return spelled
    added = units.added
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> bytes:
        if not any(t in text for t in added):
            return spelled(text)
        return b"".join(added[part] if i % 2 else spelled(part) for i, part in enumerate(cut.split(text)))

    return encode


def encoded(batches: Iterator[pa.RecordBatch], path: str, name: str = "text", added_tokens: bool = False) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches with the id bytes of each of their texts (null: none)."""
    encode = encoder(path, added_tokens)
    for b in slices(batches, name):
        yield b, [encode(t) for t in texts_of(b, name)]
