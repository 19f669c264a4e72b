"""Token ids of whole texts under a byte-level vocabulary file of the `tokenizers` library.

The ids are those of Tokenizer.from_file(path).encode(text, add_special_tokens=False); the same vocabulary and merge
order run in tiktoken's matcher, which takes a fifth of the time (the tests hold the two against each other). Texts that
this matcher can't take, with runs of white space beyond its stack, the `tokenizers` library encodes itself.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: How the byte-level pre-tokenizer splits a text (fixed, published with the vocabulary).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_LONG_BLANK = re.compile(r"\s{2000}")


def _bytes_of() -> dict[str, int]:
    """Printable bytes stand for themselves in the file, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["normalizer"] or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        of = _bytes_of()
        ranks = {bytes(of[c] for c in k): i for k, i in file["model"]["vocab"].items() if k not in special}
        self._path, self._slow = path, None
        self._encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    @property
    def largest(self) -> int:
        return self._encoding.max_token_value

    def encode(self, text: str) -> np.ndarray:
        if _LONG_BLANK.search(text) is None:
            return self._encoding.encode_to_numpy(text, allowed_special="all")
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
