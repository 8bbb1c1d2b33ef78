"""Token ids of texts by a public byte-level BPE vocabulary.

The ids are those of the vocabulary's own tokenizer (``Tokenizer.encode`` without
special tokens). A space between two non-space characters always starts a new
piece of the split pattern, so a text is cut there and the ids of each cut are
remembered. Cuts seen for the first time are encoded from the rank file of the same
vocabulary, which takes a third of the time; a text that names a special token goes
to the tokenizer itself.
"""

from __future__ import annotations

import base64
import json
import re
import struct

REMEMBERED = 300_000  # cuts held by one worker: about 60 MB
LONGEST = 64  # longer cuts are not remembered

#: A space that is not between two non-space characters.
_UNSAFE = re.compile(r"(?<!\S) | (?!\S)")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def _bytes(ids: list[int]) -> bytes:
    return struct.pack("<%dI" % len(ids), *ids)


class _Cuts(dict):
    """From a cut, without its leading space, to the bytes of its ids."""

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.old = encode, lead, {}

    def __missing__(self, cut: str) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            ids = _bytes(self.encode(self.lead + cut))
        if len(cut) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[cut] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(tokenizer_path, "rb") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.path, self.whole = tokenizer_path, None
        self.first = _Cuts(plain.encode_ordinary, "")
        self.later = _Cuts(plain.encode_ordinary, " ")

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._by_tokenizer(text)
        cuts = _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        return self.first[cuts[0]] + b"".join(map(self.later.__getitem__, cuts[1:]))

    def _by_tokenizer(self, text: str) -> bytes:
        if self.whole is None:  # rarely needed, and large
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer_path: str, ranks_path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    key = (tokenizer_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = Encoder(*key)
    return _loaded[key]
