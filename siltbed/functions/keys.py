"""Key material: three keys and a chunker nonce, and its form wrapped by a password (driver side, never a column)."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
from dataclasses import dataclass


class KeyError_(Exception):
    """A wrapped key that the password does not open."""


@dataclass(frozen=True)
class Key:
    key: bytes
    hmac_key: bytes
    id_key: bytes
    chunker_nonce: int

    @classmethod
    def from_bytes(cls, raw: bytes, nonce: int) -> Key:
        """Deals bytes in turn to the three keys."""
        return cls(raw[0::3], raw[1::3], raw[2::3], nonce)

    @classmethod
    def random(cls, size: int = 32) -> Key:
        return cls.from_bytes(os.urandom(3 * size), int.from_bytes(os.urandom(8), "little"))

    def _dump(self) -> bytes:
        return json.dumps([base64.b64encode(x).decode() for x in (self.key, self.hmac_key, self.id_key)] + [self.chunker_nonce]).encode()

    def wrap(self, password: str, n: int = 1 << 14, r: int = 8, p: int = 1) -> dict:
        """scrypt stands in for a memory-hard password hash; the key stream is SHA-256 in counter mode, checked by a MAC."""
        salt = os.urandom(32)
        derived = hashlib.scrypt(password.encode(), salt=salt, n=n, r=r, p=p, dklen=64)
        body = _stream(derived[:32], self._dump())
        return {"salt": salt.hex(), "n": n, "r": r, "p": p, "body": body.hex(), "tag": hmac.new(derived[32:], body, "sha256").hexdigest()}

    @classmethod
    def unwrap(cls, wrapped: dict, password: str) -> Key:
        derived = hashlib.scrypt(password.encode(), salt=bytes.fromhex(wrapped["salt"]), n=wrapped["n"], r=wrapped["r"], p=wrapped["p"], dklen=64)
        body = bytes.fromhex(wrapped["body"])
        if not hmac.compare_digest(hmac.new(derived[32:], body, "sha256").hexdigest(), wrapped["tag"]):
            raise KeyError_("wrong password or damaged key")
        *keys, nonce = json.loads(_stream(derived[:32], body))
        return cls(*map(base64.b64decode, keys), nonce)


def _stream(key: bytes, data: bytes) -> bytes:
    pad = b"".join(hashlib.sha256(key + i.to_bytes(8, "big")).digest() for i in range(len(data) // 32 + 1))
    return bytes(a ^ b for a, b in zip(data, pad, strict=False))
