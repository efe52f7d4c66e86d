"""Vector expressions on array columns, JVM-side, and their NumPy forms for Arrow batches.

Arithmetic is DOUBLE and sums run from the first component to the last, so that results are reproducible bit by bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

IP, L2, COSINE, HAMMING = "ip", "l2", "cosine", "hamming"
DISTANCES = (IP, L2, COSINE, HAMMING)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(u: Column, v: Column) -> Column:
    return total(F.zip_with(doubles(u), doubles(v), lambda a, b: a * b))


def l2(u: Column, v: Column) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(doubles(u), doubles(v), lambda a, b: (a - b) * (a - b)))


def sqnorm(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def normalised(v: Column) -> Column:
    """Unit length; the zero vector becomes the one of equal components."""
    n = F.sqrt(sqnorm(v))
    return F.transform(doubles(v), lambda x: F.when(n == 0, 1 / F.sqrt(F.size(v))).otherwise(x / n))


def hamming(u: Column, v: Column) -> Column:
    """Differing bits of packed vectors."""
    return F.aggregate(F.zip_with(u, v, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x).cast("double")


def dissimilarity(u: Column, v: Column, distance: str) -> Column:
    if distance == IP:
        return -dot(u, v)
    if distance == COSINE:
        return -dot(normalised(u), normalised(v))
    return {L2: l2, HAMMING: hamming}[distance](u, v)


def unpack_bits(b: Column) -> Column:
    """Bytes to bits, the most significant first."""
    bit = lambda x, j: F.call_function("shiftright", x.cast("int"), j).bitwiseAND(F.lit(1))
    places = F.sequence(F.lit(7), F.lit(0), F.lit(-1))
    return F.flatten(F.transform(b, lambda x: F.transform(places, lambda j: bit(x, j))))


def pack_bits(bits: Column) -> Column:
    """Bits to bytes, the most significant first; a last incomplete byte is filled with zeros."""
    byte = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda s, j: s * 2 + F.coalesce(F.get(bits, i * 8 + j).cast("int"), F.lit(0)))
    n = F.ceil(F.size(bits) / 8).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), byte))


def quantization_factor(v: Column, bits: int) -> Column:
    """(2^(bits-1) - 1) over the largest magnitude; 0 for a zero vector."""
    most = F.array_max(F.transform(doubles(v), F.abs))
    return F.when(most > 0, F.lit(float(2 ** (bits - 1) - 1)) / most).otherwise(0.0)


def quantized(v: Column, bits: int, unsigned: bool = False) -> Column:
    """Codes: to the nearest, halves to even; unsigned ones are moved by 128, those of 4 bits round halves up."""
    f = quantization_factor(v, bits)
    if unsigned and bits == 4:
        return F.transform(doubles(v), lambda x: F.least(F.lit(15), F.floor(f * x + 8.5).cast("int")))
    return F.transform(doubles(v), lambda x: F.rint(f * x).cast("int") + (128 if unsigned else 0))


def from_half(raw: bytes, kind: str = "f16") -> np.ndarray:
    """float16 or bfloat16 bytes, little-endian, as float32."""
    if kind == "f16":
        return np.frombuffer(raw, "<f2").astype(np.float32)
    return (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)


#: Exponent bits and mantissa bits of the two formats of half the size.
HALVES = {"f16": (5, 10), "bf16": (8, 7)}


def from_bits(v: Column, kind: str) -> Column:
    """Arrays of 16-bit patterns as numbers. They may be signed or not; every value is exact in double."""
    width, mantissa = HALVES[kind]
    top, bias = 2**width - 1, 2 ** (width - 1) - 1

    def value(x: Column) -> Column:
        x = x.cast("int").bitwiseAND(F.lit(0xFFFF))
        e, m = F.shiftright(x, mantissa).bitwiseAND(F.lit(top)), x.bitwiseAND(F.lit(2**mantissa - 1)).cast("double")
        normal = (1 + m / 2**mantissa) * F.pow(F.lit(2.0), (e - bias).cast("double"))
        special = F.when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        size = F.when(e == 0, m * 2.0 ** (1 - bias - mantissa)).when(e == top, special).otherwise(normal)
        return F.when(F.shiftright(x, 15) == 1, -size).otherwise(size)

    return F.transform(v, value)


def numbers(v: Column, dtype: str) -> Column:
    """A vector column of one of ``DTYPES`` as the numbers it stands for; binary vectors stay bytes."""
    return from_bits(v, dtype).cast("array<float>") if dtype in HALVES else v


DTYPES = ("f32", "f16", "bf16", "u8", "binary")


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of one width as a matrix of doubles; null lists, other widths and what isn't a number are errors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width or 0))
    widths = column.value_lengths()
    lo, hi = pc.min_max(widths).values()
    if column.null_count or lo != hi or width not in (None, lo.as_py()):
        raise ValueError(f"vectors must have {width or 'the same number of'} components")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("vectors must hold numbers")
    return flat.reshape(len(column), -1)


def pair_distance(q: np.ndarray, v: np.ndarray, distance: str) -> np.ndarray:
    """Row by row, summed in the order of components, equal to ``dissimilarity`` in every bit."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += (q[:, j] - v[:, j]) ** 2 if distance in (L2, HAMMING) else q[:, j] * v[:, j]
    return out if distance in (L2, HAMMING) else -out


def unit(m: np.ndarray) -> np.ndarray:
    total = np.zeros(len(m))
    for j in range(m.shape[1]):
        total += m[:, j] * m[:, j]
    n = np.sqrt(total)[:, None]
    return np.where(n == 0, 1 / np.sqrt(max(m.shape[1], 1)), m / np.where(n == 0, 1, n))


def bits_of(m: np.ndarray) -> np.ndarray:
    return np.unpackbits(m.astype(np.uint8), axis=1).astype(np.float64)


class Codes:
    """Rows of a matrix in 4 or 8 bits: the first component as it is, the others as codes with one scale a row.

    A code is the nearest integer to the component times its row's factor, moved by ``offset`` to be positive. Products of
    codes are sums of integers; what the offset adds to them is taken off again before scaling (``product``). Codes of 4
    bits are packed by twos, the first in the low half.
    """

    def __init__(self, codes: np.ndarray, scale: np.ndarray, fix: np.ndarray, bits: int) -> None:
        self.codes, self.scale, self.fix, self.bits = codes, scale, fix, bits

    @classmethod
    def of(cls, m: np.ndarray, bits: int) -> Codes:
        rest, most = m[:, 1:], 2 ** (bits - 1) - 1
        largest = np.abs(rest).max(1) if rest.shape[1] else np.zeros(len(m))
        scale = np.where(largest > 0, most / np.where(largest > 0, largest, 1), 0)
        moved = rest * scale[:, None]
        codes = np.rint(moved) + 128 if bits == 8 else np.minimum(15, np.floor(moved + 8.5))
        return cls(codes.astype(np.uint8), scale.astype(np.float32), m[:, 0].astype(np.float32), bits)

    @property
    def offset(self) -> int:
        return 2 ** (self.bits - 1)

    def packed(self) -> np.ndarray:
        if self.bits == 8:
            return self.codes
        even = np.pad(self.codes, ((0, 0), (0, self.codes.shape[1] % 2)))
        return even[:, ::2] | even[:, 1::2] << 4

    @classmethod
    def unpacked(cls, raw: np.ndarray, scale: np.ndarray, fix: np.ndarray, bits: int, width: int) -> Codes:
        """width: the number of codes of a row."""
        if bits == 4:
            raw = np.stack([raw & 15, raw >> 4], 2).reshape(len(raw), -1)[:, :width]
        return cls(raw, scale, fix, bits)

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.codes[rows], self.scale[rows], self.fix[rows], self.bits)

    def product(self, other: Codes) -> np.ndarray:
        """Scores of all rows of self (queries, in 8 bits) with all rows of other. Sums of integers below 2^53 are exact in
        doubles, whatever their order, so the fast product of matrices serves."""
        q = self.codes.astype(np.float64) - self.offset
        total = q @ other.codes.T.astype(np.float64) - other.offset * q.sum(1)[:, None]
        by = self.scale[:, None].astype(np.float64) * other.scale
        return np.where(by > 0, total / np.where(by > 0, by, 1), 0) + self.fix[:, None].astype(np.float64) * other.fix


def prepared(m: np.ndarray, distance: str) -> np.ndarray:
    """Vectors such that cosine becomes an inner product and Hamming a squared distance."""
    return unit(m) if distance == COSINE else bits_of(m) if distance == HAMMING else m
