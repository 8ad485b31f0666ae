"""Vocabulary files, read by each worker from a path that is a parameter, and kept for its life."""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable

#: What splits a text into pre-tokens before byte-level merges (fixed value: the published pattern of this tokenizer family).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    """Bytes of every token and its rank, from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(2)
def json_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level tokenizer file, or None where ids do not follow the order of its merges."""
    model = json.load(open(path, encoding="utf-8"))
    own, byte = model["model"], _byte_of()
    special = {t["content"] for t in model.get("added_tokens", [])}
    try:
        out = {bytes(byte[c] for c in token): k for token, k in own["vocab"].items() if token not in special}
    except KeyError:
        return None
    first = len(out) - len(own["merges"])
    for k, m in enumerate(own["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        if own["vocab"].get(a + b) != first + k:
            return None
    pre = json.dumps(model.get("pre_tokenizer"))
    plain = '"ByteLevel"' in pre and '"add_prefix_space": false' in pre and not model.get("normalizer")
    return out if first == 256 and plain else None


@functools.lru_cache(2)
def fast_encoder(path: str, added: bool = False) -> Callable[[str], bytes]:
    """Text to ids (little-endian 32-bit), as the tokenizers library gives them for the file at path, with none put around the text.

    Added tokens of the file that a text spells out are one id each where
    `added` is set, as the library has them by default, and spelt out else.

    Where the ids of a byte-level file are its merge ranks, the rank encoder
    gives the same ids in a third of the time; other files go through the
    tokenizers library itself.
    """
    if (own := json_ranks(path)) is not None:
        import tiktoken

        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=own, special_tokens={}).encode_to_numpy
        plain = lambda text: encode(text).astype("<u4", copy=False).tobytes()
        names = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        if not (added and names):
            return plain
        holds = re.compile("|".join(map(re.escape, names))).search
        return lambda text: _library(path, True)(text) if holds(text) else plain(text)
    return _library(path, added)


@functools.lru_cache(2)
def _library(path: str, added: bool) -> Callable[[str], bytes]:
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = not added
    return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
