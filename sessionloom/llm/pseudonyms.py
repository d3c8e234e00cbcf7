"""Keyed permutations that keep a value's format.

A Feistel network permutes the digits of a value among all digit strings of
that length, and the letters among all letter strings of theirs; everything
else stays. Equal values get equal pseudonyms under one key, in any document,
and the holder of the key can invert them.
"""

from __future__ import annotations

import hashlib
import string

ROUNDS = 10


def _prf(key: bytes, tweak: bytes, step: int, value: int, modulus: int) -> int:
    digest = hashlib.blake2b(b"%b|%d|%d" % (tweak, step, value), key=key, digest_size=16).digest()
    return int.from_bytes(digest, "big") % modulus


def permute(key: bytes, tweak: bytes, number: int, radix: int, length: int, inverse: bool = False) -> int:
    """A keyed permutation of ``range(radix ** length)``."""
    if length < 2:  # one symbol: a keyed shift
        shift = _prf(key, tweak, 0, length, radix)
        return (number - shift if inverse else number + shift) % radix**length
    left_len = length // 2
    size = (radix**left_len, radix ** (length - left_len))
    a, b = divmod(number, size[1])
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if i % 2 == 0:
            a = (a + (-1 if inverse else 1) * _prf(key, tweak, i, b, size[0])) % size[0]
        else:
            b = (b + (-1 if inverse else 1) * _prf(key, tweak, i, a, size[1])) % size[1]
    return a * size[1] + b


def _pass(key: bytes, tweak: str, text: str, alphabet: str, inverse: bool) -> str:
    at = {c: i for i, c in enumerate(alphabet)}
    places = [i for i, c in enumerate(text) if c in at]
    if not places:
        return text
    number = 0
    for i in places:
        number = number * len(alphabet) + at[text[i]]
    number = permute(key, f"{tweak}{len(places)}{alphabet[0]}".encode(), number, len(alphabet), len(places), inverse)
    out = list(text)
    for i in reversed(places):
        number, k = divmod(number, len(alphabet))
        out[i] = alphabet[k]
    return "".join(out)


def pseudonym(key: bytes, kind: str, value: str, inverse: bool = False) -> str:
    """``value`` with its digits, small and capital letters permuted, each class among itself.

    Letters outside ASCII stay as they are; callers fold them first.
    """
    for alphabet in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        value = _pass(key, kind, value, alphabet, inverse)
    return value
