"""Keyed names and convergent encryption, as expressions; keys are derived on the driver.

The key of an expression stands as a literal in its plan. Alias the result, and set
spark.sql.redaction.string.regex where plans are logged.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandkeep import settings

# Fixed values of the sealed blob: version byte, nonce and tag sizes; the key alphabet, and letters read as others.
SEAL_VERSION, NONCE, TAG = 1, 12, 16
OVERHEAD = 1 + NONCE + TAG
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
READ_AS = {"O": "0", "I": "1", "L": "1", "U": "V"}
KEY_BYTES = 32


def derive(master: bytes, purpose: str) -> bytes:
    """HKDF-SHA256 without salt, 32 bytes, for "enc" or "id"."""
    if len(master) != KEY_BYTES:
        raise ValueError(f"a workspace key is {KEY_BYTES} bytes")
    extracted = hmac.digest(bytes(32), master, "sha256")
    return hmac.digest(extracted, f"{settings.NAMESPACE}/{purpose}/v1".encode() + b"\x01", "sha256")


def show_key(master: bytes) -> str:
    """The key as people copy it: base32 in groups of eight behind the namespace."""
    bits = "".join(f"{b:08b}" for b in master)
    text = "".join(ALPHABET[int(bits[k : k + 5].ljust(5, "0"), 2)] for k in range(0, len(bits), 5))
    return "-".join([settings.NAMESPACE, *(text[k : k + 8] for k in range(0, len(text), 8))])


def read_key(text: str) -> bytes:
    """The reverse: separators go before the prefix does, and letters outside the alphabet are read as those meant."""
    bare = "".join(c for c in text if not c.isspace() and c not in "-_")
    if bare.lower().startswith(settings.NAMESPACE):
        bare = bare[len(settings.NAMESPACE) :]
    values = [ALPHABET.find(READ_AS.get(c, c)) for c in bare.upper()]
    if -1 in values:
        raise ValueError(f"{bare[values.index(-1)]!r} is not part of a workspace key")
    bits = "".join(f"{v:05b}" for v in values)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits) - 7, 8))
    if len(data) != KEY_BYTES:
        raise ValueError(f"a workspace key decodes to {KEY_BYTES} bytes, this one gave {len(data)}")
    return data


def fingerprint(master: bytes) -> str:
    return hashlib.sha256(f"{settings.NAMESPACE}/fingerprint/v1".encode() + master).hexdigest()[:12]


def _bytes(data: bytes) -> Column:
    return F.unhex(F.lit(data.hex()))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 (binary) of a binary column, composed of two SHA-256."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(_bytes(bytes(b ^ 0x36 for b in key)), message), 256))
    return F.unhex(F.sha2(F.concat(_bytes(bytes(b ^ 0x5C for b in key)), inner), 256))


def remote_id(master: bytes, chunk_id: Column | str) -> Column:
    """The name under which a chunk is stored remotely."""
    chunk_id = F.col(chunk_id) if isinstance(chunk_id, str) else chunk_id
    return F.lower(F.hex(hmac_sha256(derive(master, "id"), F.unhex(chunk_id))))


def _nonce(master: bytes, chunk_id: Column) -> Column:
    domain = f"{settings.NAMESPACE[0]}nonce".encode() + b"\0\0"
    return F.substring(hmac_sha256(derive(master, "id"), F.concat(_bytes(domain), F.unhex(chunk_id))), 1, NONCE)


def _aad(remote: Column) -> Column:
    return F.concat(_bytes(SEAL_VERSION.to_bytes(4, "little")), F.encode(remote, "US-ASCII"))


def seal(master: bytes, content: Column | str) -> Column:
    """version, nonce, tag, ciphertext: the same content and key always give the same blob, so stores can deduplicate it."""
    content = F.col(content) if isinstance(content, str) else content
    chunk_id = F.sha2(content, 256)
    nonce = _nonce(master, chunk_id)
    sealed = F.aes_encrypt(content, _bytes(derive(master, "enc")), F.lit("GCM"), F.lit("DEFAULT"), nonce, _aad(remote_id(master, chunk_id)))
    body = F.octet_length(sealed) - NONCE - TAG
    return F.concat(_bytes(bytes([SEAL_VERSION])), F.substring(sealed, 1, NONCE), sealed.substr(F.octet_length(sealed) - TAG + 1, F.lit(TAG)), sealed.substr(F.lit(NONCE + 1), body))


def unseal(master: bytes, blob: Column | str, remote: Column | str) -> Column:
    """The content of a blob by its remote name. Null if version, key, name or bytes are not right, the name of the plaintext included."""
    blob, remote = (F.col(x) if isinstance(x, str) else x for x in (blob, remote))
    nonce, tag = F.substring(blob, 2, NONCE), F.substring(blob, 2 + NONCE, TAG)
    body = blob.substr(F.lit(OVERHEAD + 1), F.greatest(F.octet_length(blob) - OVERHEAD, F.lit(0)))
    plain = F.try_aes_decrypt(F.concat(nonce, body, tag), _bytes(derive(master, "enc")), F.lit("GCM"), F.lit("DEFAULT"), _aad(remote))
    right = (F.octet_length(blob) >= OVERHEAD) & (F.hex(F.substring(blob, 1, 1)) == f"{SEAL_VERSION:02X}")
    return F.when(right & (remote_id(master, F.sha2(plain, 256)) == remote), plain)
