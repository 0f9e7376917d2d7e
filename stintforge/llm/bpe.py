"""Byte-level BPE ids of whole texts, equal to the ``tokenizers`` library's.

Where the vocabulary also stands beside its file as ranks (``.tiktoken``), texts of plain characters are encoded from
these, which is several times faster and gives the same ids: the split pattern and the merges are the same.  Any
other text, or one that holds an added token's string, goes to the library.
"""

from __future__ import annotations

import array
import base64
import os
import re
from pathlib import Path

#: Characters on whose classes both libraries agree in any version: ASCII and Latin letters.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u017f]*")
#: Fixed value: the split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.ranked = None
        if (ranks := Path(path).with_suffix(".tiktoken")).exists():
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranked is not None and PLAIN.fullmatch(text) and not any(x in text for x in self.added):
            return self.ranked.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        out = array.array("I", self.ids(text))
        if out.itemsize != 4:
            raise OSError("no 32-bit unsigned array here")
        return out.tobytes()


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
