"""Byte-level BPE vocabularies in the ``tokenizers`` JSON form, encoded in the workers."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import regex
import tiktoken

# The pre-token pattern that the ByteLevel pre-tokenizer uses, and the same over ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


#: Blank runs from this length on are encoded as pieces of their own; the encoder's pattern backtracks over them otherwise.
LONG_BLANK = 50_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encodes as ``tokenizers`` does for a byte-level BPE without normalizer and template.

    Special strings inside a text become their ids, which is that library's default.
    Vocabularies whose merges aren't in the order of their ids, or that use settings beyond
    the plain ones, are refused, so that the library itself can be used for them.
    """

    def __init__(self, source: bytes):
        spec = json.loads(source)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level vocabulary")
        if spec.get("normalizer") or spec.get("post_processor") or model.get("type") != "BPE":
            raise ValueError("normalizers and templates are not supported")
        if any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("this setting of the model is not supported")
        added = spec.get("added_tokens", [])
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")) or any(not t.get("special") for t in added):
            raise ValueError("added tokens with rules of their own are not supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get("".join(m), -1) for m in merges]
        if any(a >= b for a, b in zip(made, made[1:])):
            raise ValueError("merges must be in the order of their ids")
        special = {t["content"]: t["id"] for t in added}
        alphabet = byte_alphabet()
        self.ranks = {bytes(alphabet[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens=special)
        self.n_vocab = max([*self.ranks.values(), *special.values()], default=0) + 1
        self._ascii, self._unicode = re.compile(ASCII_PATTERN, re.ASCII), regex.compile(PATTERN)
        self._blank = regex.compile(r"\s{%d,}" % LONG_BLANK)

    def pretokens(self, text: str):
        """The text's pre-tokens; an iterator where a list could grow large."""
        pattern = self._ascii if text.isascii() else self._unicode
        return pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in pattern.finditer(text))

    def encode_array(self, text: str) -> np.ndarray:
        """All ids of the text as an array of uint32."""
        if len(text) < LONG_BLANK or not self._blank.search(text):
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        parts = []
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            parts += [*self._between(text[at : found.start()]), self.encoding.encode_to_numpy(found.group(), allowed_special="all")]
            at = found.end()
        return np.concatenate([*parts, *self._between(text[at:])]).astype(np.uint32)

    def _between(self, text: str):
        """The ids of a text without special strings, part by part.

        A long blank run is a pre-token, less its last character if something follows it.
        """
        at = 0
        for found in self._blank.finditer(text):
            end = found.end() - (found.end() < len(text))
            yield self.encoding.encode_to_numpy(text[at : found.start()])
            yield np.array(self.encoding._core_bpe.encode_single_piece(text[found.start() : end].encode()), np.uint32)
            at = end
        yield self.encoding.encode_to_numpy(text[at:])

    def piece_length(self, pretoken: str) -> int:
        return len(self.encoding._core_bpe.encode_single_piece(pretoken.encode()))


@lru_cache(maxsize=4)
def load(source: bytes) -> ByteBpe:
    return ByteBpe(source)
