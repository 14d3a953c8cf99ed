"""Byte-level BPE of whole texts."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

#: Pre-tokenization of byte-level BPE (a public, fixed pattern).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space in a row beyond which the quick encoder's pattern may run out of stack.
LONG_RUN = " " * 4096


def unusual(text: str) -> bool:
    """Whether a text may hold special tokens, control characters, rare or very long white space."""
    lines = text.replace("\n", " ")
    return "<|" in text or not lines.isprintable() or LONG_RUN in lines


def byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them, as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.quick = self._ranked(path)

    @staticmethod
    def _ranked(path: str):
        """The same vocabulary as ranks, if merges are in the order of ids and the pattern is the public one; else none."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        if not plain or model.get("end_of_word_suffix") or model.get("dropout"):
            return None
        vocab, alphabet = model["vocab"], byte_alphabet()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged) or not all(c in alphabet for t in vocab for c in t):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.quick is None or unusual(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(array("I", self.quick.encode_ordinary(text)), np.uint32)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One encoder a Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
