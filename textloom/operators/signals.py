"""Filters and checks over mentions (signals), their tracks and identities, and enriched chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matching(label: str | None = None, text: str | None = None, least: float | None = None, span: tuple[int, int] | None = None, negated: bool | None = None, quantifier: str | None = None, modality: str | None = None) -> Column:
    """A conjunction of the filters given; text is a part of the surface, case apart; a span must contain the signal."""
    tests = [F.lit(True)]
    for column, value in (("label", label), ("negated", negated), ("quantifier", quantifier), ("modality", modality)):
        if value is not None:
            tests.append(F.col(column) == value)
    if text is not None:
        tests.append(F.lower("surface").contains(text.lower()))
    if least is not None:
        tests.append(F.col("confidence") >= least)
    if span is not None:
        tests.append((F.col("start") >= span[0]) & (F.col("end") <= span[1]))
    return reduce(lambda a, b: a & b, tests)


def untracked(signals: DataFrame, track_signals: DataFrame) -> DataFrame:
    """Signals of no track."""
    return signals.join(track_signals.select("signal_id").distinct(), "signal_id", "left_anti")


def track_stats(signals: DataFrame, track_signals: DataFrame) -> DataFrame:
    """For each track its length, surface variants, spread of starts, first and last place and confidences."""
    c = F.col("confidence")
    return track_signals.join(signals, "signal_id").groupBy("track_id").agg(
        F.count(F.lit(1)).alias("length"), F.countDistinct("surface").alias("variants"), (F.max("start") - F.min("start")).alias("spread"), F.min("start").alias("first"), F.max("end").alias("last"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.avg(c).alias("mean")
    )


def legal_filter(equal: dict[str, str] | None = None, member: dict[str, list[str]] | None = None, dates: tuple[str, str] | None = None, least: float | None = None) -> Column | None:
    """Predicate over enriched chunks: equalities, lists with any of the values, a range of document_date, a least confidence_min. Nothing given: None."""
    tests = [F.col(c) == v for c, v in (equal or {}).items()]
    tests += [F.arrays_overlap(c, F.array(*map(F.lit, vs))) for c, vs in (member or {}).items()]
    if dates is not None:
        tests.append(F.col("document_date").between(*dates))
    if least is not None:
        tests.append(F.col("confidence_min") >= least)
    return reduce(lambda a, b: a & b, tests) if tests else None


def validate_entities(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities (doc_id, text, start, end, confidence) with the list of what is wrong with each; those without a document have `no document`."""
    met = entities.join(docs.select("doc_id", F.col("text").alias("__doc")), "doc_id", "left")
    issue = lambda test, name: F.when(test, name)
    issues = F.array_compact(
        F.array(
            issue(F.col("__doc").isNull(), "no document"), issue(F.coalesce(F.trim("text"), F.lit("")) == "", "empty text"), issue(F.col("start") >= F.col("end"), "inverted span"), issue(F.col("end") > F.length("__doc"), "out of bounds"),
            issue((F.col("start") < F.col("end")) & (F.col("end") <= F.length("__doc")) & (F.substring("__doc", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text")), "text mismatch"), issue(~F.col("confidence").between(0.0, 1.0), "confidence"),
        )
    )
    return met.withColumn("issues", issues).drop("__doc")


def dangling(signals: DataFrame, tracks: DataFrame, track_signals: DataFrame, identities: DataFrame) -> DataFrame:
    """(kind, id) of references to nothing: a track's signal, a link's track, a track's identity."""
    lost = lambda df, key, to, kind: df.join(to.select(key).distinct(), key, "left_anti").select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
    return lost(track_signals, "signal_id", signals, "signal").unionByName(lost(track_signals, "track_id", tracks, "track")).unionByName(lost(tracks.filter("identity_id is not null"), "identity_id", identities, "identity"))


def map_labels(df: DataFrame, mapping: dict[str, str], label: str = "label") -> DataFrame:
    """df with the canonical type of each label; unknown labels stay."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return df.withColumn("type", F.coalesce(table[F.col(label)], F.col(label)))


def information_loss(mapping: dict[str, str]) -> dict[str, list[str]]:
    """Types to which several labels collapse, with those labels."""
    back: dict[str, list[str]] = {}
    for a, b in sorted(mapping.items()):
        back.setdefault(b, []).append(a)
    return {b: labels for b, labels in back.items() if len(labels) > 1}
