"""Token ids of the public byte-level BPE, in tasks.

The ids are those of the tokenizers file ``byte_bpe_50k.json`` with
``add_special_tokens=False``: no id is added, and an added token of the file
that stands in a text (``<|endoftext|>``) is its own id. The same vocabulary
read as ranks gives the same ids at about five times the speed, so the tasks
use that form with the added tokens of the file (``tests/llm`` holds the two
against each other). The paths are parameters; nothing is copied.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np

_ENCODERS: dict = {}
LONG = 1 << 20  # characters of a text encoded at once


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str) -> dict[str, int]:
    """Text -> id of the added tokens in the tokenizers file beside a rank file (none without one)."""
    file = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(file):
        return {}
    with open(file, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"]]
    if odd:
        raise ValueError(f"added tokens that match more than their text: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def encoder(path: str | None = None):
    """``text -> uint32 ids``, built once in a worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        file = path or default_path()
        with open(file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        added = added_tokens(file)
        enc = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        allowed = set(added)

        def encode(text: str) -> np.ndarray:
            if len(text) <= LONG:
                return enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
            return np.concatenate([enc.encode_to_numpy(x, allowed_special=allowed, disallowed_special=()) for x in _cut(text)])

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def _cut(text: str):
    """Parts that encode like the whole: cut only between a letter and a space
    that is followed by a letter, where the pattern always starts a new piece
    (and no added token lies across, as none holds a space)."""
    lo = 0
    while lo < len(text):
        hi = min(len(text), lo + LONG)
        while hi < len(text) and not (text[hi] == " " and text[hi - 1].isalpha() and text[hi + 1 : hi + 2].isalpha()):
            hi += 1
        yield text[lo:hi]
        lo = hi
