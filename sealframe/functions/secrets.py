"""Keys and random bytes: Arrow UDFs, since no built-in function gives them.

The password lives in the UDF's closure and keys are columns, so neither is part of a plan's text.
Random columns are nondeterministic: materialise what is sealed before reading it twice.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import CHECKSUM_BYTES, KEY_BYTES, NONCE_BYTES, SALT_BYTES, key_pads

# Fixed values of the format.
ITERATIONS = 100_000
MIN_PASSWORD = 8
FRAME_HEADER_BYTES = 32
HEADER_PADDING = (1_024, 4_096)
TRAILER_PADDING = (512, 2_048)
INTERBLOCK_PADDING = (256, 1_024)
VARIANCE = 8_192

#: Source of random bytes: a function of their number.
Random = Callable[[int], bytes]


def check_password(password: str) -> str:
    """The password, if it is long enough to seal with."""
    if len(password.encode()) < MIN_PASSWORD:
        raise ValueError(f"a password has at least {MIN_PASSWORD} bytes")
    return password


def seeded(seed: int) -> Random:
    """Repeatable bytes, for tests only."""
    state = np.random.Generator(np.random.PCG64(seed))
    return lambda n: state.bytes(n)


def derive(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, KEY_BYTES)


def derived_key(salt: Column, password: str, iterations: int = ITERATIONS) -> Column:
    """PBKDF2-HMAC-SHA256 of each salt: a struct of ``key`` and its HMAC pads ``ipad`` and ``opad``."""

    @F.pandas_udf("key binary, ipad binary, opad binary")
    def derive_all(salts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[bytes, bytes, bytes]] = {}
        for batch in salts:
            rows = []
            for raw in batch:
                if raw is None:
                    rows.append((None, None, None))
                    continue
                if raw not in known:
                    if len(known) > 1000:
                        known.clear()
                    key = derive(password, raw, iterations)
                    known[raw] = (key, *key_pads(key))
                rows.append(known[raw])
            yield pd.DataFrame(rows, columns=["key", "ipad", "opad"])

    return derive_all(salt)


def random_length(low: int, high: int, random: Random = os.urandom) -> int:
    """A length in [low, high] from two random bytes, the first the higher."""
    return low + int.from_bytes(random(2), "big") % (high - low + 1)


def random_delta(most: int, random: Random = os.urandom) -> int:
    """A chunk's deviation in [-most, most] from two random bytes."""
    return random_length(-most, most, random) if most > 0 else 0


def random_bytes(row: Column, count: int, seed: int | None = None) -> Column:
    """``count`` random bytes for each row."""
    if count <= 0:
        raise ValueError("a positive number of bytes is needed")
    return _drawn(row, "binary", lambda random, _: random(count), seed)


def random_padding(row: Column, bounds: tuple[int, int], seed: int | None = None) -> Column:
    """Random bytes of a random length within the bounds, for each row."""
    return _drawn(row, "binary", lambda random, _: random(random_length(*bounds, random)), seed)


def random_deltas(chunks: Column, most: int = VARIANCE, seed: int | None = None) -> Column:
    """As many chunk deviations as ``chunks`` says, for each row."""
    return _drawn(chunks, "array<int>", lambda random, n: [random_delta(most, random) for _ in range(int(n))], seed)


def nonces(count: Column, seed: int | None = None) -> Column:
    """``count`` nonces for each row."""
    return _drawn(count, "array<binary>", lambda random, n: [random(NONCE_BYTES) for _ in range(int(n))], seed)


def _drawn(column: Column, kind: str, draw: Callable[[Random, object], object], seed: int | None) -> Column:
    @F.pandas_udf(kind)
    def drawn(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        random = os.urandom if seed is None else seeded(seed)
        for batch in values:
            yield pd.Series([draw(random, v) for v in batch], dtype=object)

    return drawn.asNondeterministic()(column)


def entry_draws(chunks: Column, variance: int = VARIANCE, seed: int | None = None) -> Column:
    """All that is random in an entry of up to ``chunks`` chunks, drawn in one pass: a struct of entry_salt, frame_header,
    interblock_pad, trailer_pad, entry_checksum, deltas (one per chunk) and nonces (three more than chunks)."""

    def draw(random: Random, n: object) -> tuple:
        pads = [random(random_length(*b, random)) for b in (INTERBLOCK_PADDING, TRAILER_PADDING)]
        deltas = [random_delta(variance, random) for _ in range(int(n))]
        return random(SALT_BYTES), random(FRAME_HEADER_BYTES), *pads, random(CHECKSUM_BYTES), deltas, [random(NONCE_BYTES) for _ in range(int(n) + 3)]

    names = ["entry_salt", "frame_header", "interblock_pad", "trailer_pad", "entry_checksum", "deltas", "nonces"]

    @F.pandas_udf(", ".join(f"{n} binary" for n in names[:5]) + ", deltas array<int>, nonces array<binary>")
    def drawn(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        random = os.urandom if seed is None else seeded(seed)
        for batch in values:
            yield pd.DataFrame([draw(random, n) for n in batch], columns=names)

    return drawn.asNondeterministic()(chunks)


def salts(row: Column, seed: int | None = None) -> Column:
    return random_bytes(row, SALT_BYTES, seed)
