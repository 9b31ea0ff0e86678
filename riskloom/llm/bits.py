"""A Bloom filter sized by the number of its keys, up to a fixed bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: At most 2**27 bits, which are 16 MB; some 16 bits a key up to there.
LOG_BITS, LEAST_LOG_BITS = 27, 20
#: Keys for which the largest filter still keeps most others out.
MOST_KEYS = 20_000_000
_PAGE = 32768


def slots(key: np.ndarray, log_bits: int, which: int) -> np.ndarray:
    """key: well mixed 64-bit values."""
    return (key >> np.uint64(which * log_bits)) & np.uint64((1 << log_bits) - 1)


def log_bits_for(n: int) -> int:
    return min(LOG_BITS, max(LEAST_LOG_BITS, (16 * n).bit_length()))


def pages(keys: DataFrame, column: str, log_bits: int = LOG_BITS) -> DataFrame:
    """The filter over a bigint column of mixed hashes as rows page, bits; they are combined before the shuffle."""
    mask = (1 << log_bits) - 1
    slot = F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, log_bits).bitwiseAND(F.lit(mask))))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.expr(f"slot div {_PAGE}").alias("page"))
        .agg(F.expr(f"bitmap_construct_agg(cast(pmod(slot, {_PAGE}) as bigint))").alias("bits"))
    )


def build(keys: DataFrame, column: str, log_bits: int = LOG_BITS) -> np.ndarray:
    """The filter over a bigint column of mixed hashes."""
    out = np.zeros((1 << log_bits) // 8, np.uint8)
    for page, bits in pages(keys, column, log_bits).collect():  # the whole filter at most
        out[page * (_PAGE // 8) : (page + 1) * (_PAGE // 8)] = np.frombuffer(bytes(bits), np.uint8)
    return out


def page_of(h: Column, log_bits: int, which: int) -> tuple[Column, Column]:
    """Of a hash's slot, the page and the place there."""
    slot = F.shiftrightunsigned(h, which * log_bits).bitwiseAND(F.lit((1 << log_bits) - 1))
    return F.shiftright(slot, _PAGE.bit_length() - 1), slot.bitwiseAND(F.lit(_PAGE - 1)).cast("int")


def bit(bits: Column, place: Column) -> Column:
    """Whether a page has the bit; false without a page."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def holds(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    log_bits = (8 * len(bits)).bit_length() - 1
    found = np.ones(len(key), bool)
    for which in (0, 1):
        slot = slots(key, log_bits, which)
        found &= ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
    return found
