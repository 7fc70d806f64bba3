"""Vectors, intervals, confidences and signatures as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; of unlike lengths, or with a zero vector: 0."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def interval_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over joined length of two half-open intervals; apart: 0."""
    shared = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(shared <= 0, 0.0).otherwise(shared / ((e1 - s1) + (e2 - s2) - shared))


def box_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The same of two boxes (x, y, width, height)."""
    wide = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    shared = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))
    return F.when(shared == 0, 0.0).otherwise(shared / (a[2] * a[3] + b[2] * b[3] - shared))


def combined_confidence(linkage: Column, kind: Column, boundary: Column) -> Column:
    """Geometric mean of three confidences."""
    return F.pow(linkage * kind * boundary, F.lit(1 / 3))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct lower-case runs of n characters; a shorter text is one."""
    low = F.lower(text)
    return F.when(F.length(low) < n, F.array(low)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, F.lit(n)))))


def minhash(grams: Column, hashes: int = 15) -> Column:
    """Least hash of the grams under each of so many seeds."""
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda s: F.array_min(F.transform(grams, lambda g: F.xxhash64(s, g))))


def band_hashes(signature: Column, bands: int = 5, rows: int = 3) -> Column:
    """A struct (band, hash) for each run of rows of the signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice(signature, b * rows + 1, F.lit(rows))).alias("hash")))


def signature_similarity(a: Column, b: Column) -> Column:
    """Share of equal places."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def support_bin(score: Column) -> Column:
    """high from 0.7, medium from 0.4, else low."""
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def column_tokens(schema: Column, prompt: Column) -> Column:
    """A quarter of the bytes of each, rounded down, and 20."""
    return F.floor(F.octet_length(schema) / 4) + F.floor(F.octet_length(prompt) / 4) + 20


def document_tokens(text: Column) -> Column:
    """(bytes + 32) / 4, rounded down; to be summed over chunks."""
    return F.floor((F.octet_length(text) + 32) / 4)


def segments_length(segments: Column) -> Column:
    """Sum of the lengths of (start, end) pieces."""
    return F.aggregate(segments, F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)


def segments_bounds(segments: Column) -> Column:
    """Least start and greatest end of (start, end) pieces."""
    return F.struct(F.array_min(F.transform(segments, lambda x: x.start)).alias("start"), F.array_max(F.transform(segments, lambda x: x.end)).alias("end"))


def sample_std_share(scores: Column) -> Column:
    """min(sample deviation / 0.5, 1) of an array; one score or none: 0."""
    n = F.size(scores)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n
    spread = F.aggregate(scores, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(n <= 1, 0.0).otherwise(F.least(F.sqrt(spread / (n - 1)) / 0.5, F.lit(1.0)))


def wilson_interval(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Bounds of the share of successes."""
    p, zz = successes / n, z * z
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.struct(((p + zz / (2 * n) - half) / (1 + zz / n)).alias("low"), ((p + zz / (2 * n) + half) / (1 + zz / n)).alias("high"))
