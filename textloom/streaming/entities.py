"""Coreference as mentions arrive: a memory of entities for each stream of text, with state that survives restarts and a policy of what to forget.

A mention (stream_id, seq, text) joins the remembered entity that it fits best or
begins one. The memory is state of ``transformWithState``: a map of entities, the
lists of recent and of frequent ones, a counter, and a timer that clears a stream
that has been idle. ``replayed`` applies the same rule to a finished table.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a mention scores against an entity: its name, another of its forms, one within the other, last word, first word, a pronoun; weight of shared trigrams. Fixed values.
NAME, FORM, WITHIN, LAST, FIRST, PRONOUN, TRIGRAMS = 1.0, 0.95, 0.85, 0.8, 0.75, 0.6, 0.7
#: The score from which a mention joins an entity; mentions of one window of the memory's clock. Fixed values.
LEAST, WINDOW = 0.7, 1500
PRONOUNS = frozenset("he him his himself she her hers herself they them their theirs themself themselves it its itself i me my mine myself we us our ours you your yours".split())
OUT = "stream_id string, seq long, text string, entity long, score double"


@dataclass(frozen=True)
class Policy:
    """What is kept: everything (kind unbounded), the most recently or most frequently used `most` entities (lru, lfu), or the `most` last used and the `frequent` most used (dual)."""

    kind: str = "unbounded"
    most: int = 0
    frequent: int = 0

    def __post_init__(self):
        if self.kind not in ("unbounded", "lru", "lfu", "dual") or (self.kind != "unbounded" and self.most < 1) or (self.kind == "dual" and self.frequent < 1):
            raise ValueError("kind must be unbounded, lru, lfu or dual, with room for at least one entity")


@dataclass
class Entity:
    """An entity: its name (the longest form that is no pronoun), the keys of its forms, the window of its last use, its number of uses."""

    name: str
    forms: list[str]
    seen: int
    uses: int


class Places:
    """Where a mention's key finds entities by what ``fit`` asks, the best fit first, without asking each: numbers by name, form, last word, first word and trigram of the name.

    The order of the fits is that of their scores; what scores under LEAST (a
    pronoun, unlike trigrams) joins nothing.
    """

    def __init__(self, entities: dict[int, Entity]):
        self.name, self.form, self.last, self.first, self.grams, self.lengths = ({} for _ in range(6))
        self.known: dict[int, str] = {}
        for i, e in entities.items():
            for f in e.forms:
                self.form.setdefault(f, set()).add(i)
            self.named(i, e.name)

    def named(self, i: int, text: str) -> None:
        """An entity has this name from now on."""
        self._unnamed(i)
        name = self.known[i] = form(text)
        holders = self.name.setdefault(name, set())
        if not holders:
            self.lengths[len(name)] = self.lengths.get(len(name), 0) + 1
            for g in trigrams(name):
                self.grams.setdefault(g, set()).add(name)
        holders.add(i)
        for table, word in self._ends(name):
            table.setdefault(word, set()).add(i)

    def _ends(self, name: str) -> list:
        words = name.split()
        return [(self.last, words[-1]), (self.first, words[0])] if words else []

    def _unnamed(self, i: int) -> None:
        name = self.known.pop(i, None)
        if name is None:
            return
        for table, word in [(self.name, name), *self._ends(name)]:
            table[word].discard(i)
            if not table[word]:
                del table[word]
        if name not in self.name:
            self.lengths[len(name)] -= 1
            if not self.lengths[len(name)]:
                del self.lengths[len(name)]
            for g in trigrams(name):
                self.grams[g].discard(name)
                if not self.grams[g]:
                    del self.grams[g]

    def forgotten(self, i: int, forms: list[str]) -> None:
        self._unnamed(i)
        for f in forms:
            self.form[f].discard(i)
            if not self.form[f]:
                del self.form[f]

    def _within(self, key: str) -> set[str]:
        """Names that hold the key or that it holds."""
        if len(self.name) <= len(key):
            return {n for n in self.name if key in n or n in key}
        own = trigrams(key)
        holding = min((self.grams.get(g, ()) for g in own), key=len) if own else self.name
        found = {n for n in holding if key in n}
        lengths = [n for n in self.lengths if n < len(key)]
        if sum(len(key) - n + 1 for n in lengths) < len(self.name):
            found.update(part for n in lengths for k in range(len(key) - n + 1) if (part := key[k : k + n]) in self.name)
        else:
            found.update(n for n in self.name if n in key)
        return found

    def best(self, key: str) -> tuple[int | None, float]:
        """The entity that fits the key best, of equals the first, and its score; none that scores LEAST: None."""
        for found, score in ((self.name.get(key), NAME), (self.form.get(key), FORM)):
            if found:
                return min(found), score
        if key in PRONOUNS:
            return None, 0.0
        if within := self._within(key):
            return min(min(self.name[n]) for n in within), WITHIN
        words = key.split()
        if words:
            for found, score in ((self.last.get(words[-1]), LAST), (self.first.get(words[0]), FIRST)):
                if found:
                    return min(found), score
        own = trigrams(key)
        alike = [n for n in min((self.grams.get(g, ()) for g in own), key=len) if trigrams(n) == own] if own else []
        score = TRIGRAMS * len(own) / len(own) if own else 0.0
        return (min(min(self.name[n]) for n in alike), score) if alike and score >= LEAST else (None, 0.0)


@dataclass
class Memory:
    """The entities of a stream, by number."""

    policy: Policy = Policy()
    entities: dict[int, Entity] = field(default_factory=dict)
    recent: list[int] = field(default_factory=list)
    frequent: list[int] = field(default_factory=list)
    count: int = 0
    number: int = 0
    places: Places | None = None

    def take(self, text: str) -> tuple[int, float]:
        """The entity that a mention joins or begins, and the score (0: begun)."""
        key, window = form(text), self.count // WINDOW
        self.count += 1
        if self.places is None:
            self.places = Places(self.entities)
        best, score = self.places.best(key)
        if best is None:
            best, score = self.number, 0.0
            self.number += 1
            self.entities[best] = Entity(text, [key], window, 1)
            self.places.form.setdefault(key, set()).add(best)
            self.places.named(best, text)
        else:
            e = self.entities[best]
            e.seen, e.uses = window, e.uses + 1
            if best not in self.places.form.get(key, ()):
                e.forms.append(key)
                self.places.form.setdefault(key, set()).add(best)
            if len(text) > len(e.name) and key not in PRONOUNS:
                e.name = text
                self.places.named(best, text)
        self._forget(best)
        return best, score

    def _forget(self, used: int) -> None:
        kind = self.policy.kind
        if kind == "dual":
            self.recent = [used, *(i for i in self.recent if i != used)][: self.policy.most]
            rest = [i for i in self.frequent if i != used]
            at = next((k for k, i in enumerate(rest) if self.entities[i].uses < self.entities[used].uses), len(rest))
            self.frequent = [*rest[:at], used, *rest[at:]][: self.policy.frequent]
            kept = {*self.recent, *self.frequent}
            for i in [i for i in self.entities if i not in kept]:
                self._drop(i)
        elif kind != "unbounded":
            rank = (lambda i: (self.entities[i].seen, i)) if kind == "lru" else (lambda i: (self.entities[i].uses, i))
            while len(self.entities) > self.policy.most:
                self._drop(min((i for i in self.entities if i != used), key=rank, default=used))

    def _drop(self, i: int) -> None:
        self.places.forgotten(i, self.entities.pop(i).forms)


@lru_cache(maxsize=1 << 16)
def form(text: str) -> str:
    """A mention's key: composed characters, lower case, single spaces, no byte-order or direction marks."""
    plain = re.sub("[\ufeff\u200e\u200f\u202a-\u202e\u2066-\u2069]", "", unicodedata.normalize("NFC", text))
    return " ".join(plain.lower().split())


@lru_cache(maxsize=1 << 14)
def trigrams(key: str) -> frozenset[str]:
    return frozenset(key[k : k + 3] for k in range(len(key) - 2))


def fit(key: str, entity: Entity) -> float:
    """How well a mention's key fits an entity."""
    name = form(entity.name)
    if key == name:
        return NAME
    if key in entity.forms:
        return FORM
    if key in PRONOUNS:
        return PRONOUN
    if key in name or name in key:
        return WITHIN
    a, b = key.split(), name.split()
    if a and b and a[-1] == b[-1]:
        return LAST
    if a and b and a[0] == b[0]:
        return FIRST
    x, y = trigrams(key), trigrams(name)
    return TRIGRAMS * len(x & y) / len(x | y) if x and y else 0.0


def _rows(memory: Memory, stream: str | None, rows: pd.DataFrame) -> pd.DataFrame:
    ordered = rows[rows["text"].notna() & (rows["text"].fillna("").str.strip() != "")].sort_values(["seq", "text"], kind="stable")
    taken = [memory.take(t) for t in ordered["text"]]
    return pd.DataFrame({"stream_id": [stream] * len(ordered), "seq": ordered["seq"].astype("Int64"), "text": ordered["text"], "entity": [i for i, _ in taken], "score": [s for _, s in taken]})


def replayed(mentions: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Rows (stream_id, seq, text, entity, score) of a finished table of mentions (stream_id, seq, text): each in order of seq, then text, within its stream.

    Entities are numbered from 0 in each stream. Null and blank texts have no row;
    null streams are one. A stream is one task's, its memory as the policy bounds
    it; streams are sorted and read batch by batch.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, memory = None, Memory(policy)
        for batch in batches:
            keep, entity, score = [], [], []
            for k, (stream, text) in enumerate(zip(batch.column("stream_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                if stream != now:
                    now, memory = stream, Memory(policy)
                if text.strip():
                    i, s = memory.take(text)
                    keep.append(k)
                    entity.append(i)
                    score.append(s)
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(entity, pa.int64()), pa.array(score, pa.float64())], names=["stream_id", "seq", "text", "entity", "score"])

    rows = mentions.selectExpr("cast(stream_id as string) as stream_id", "cast(seq as long) as seq", "text").filter("text is not null")
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", F.asc_nulls_last("seq"), "text").mapInArrow(told, OUT)


def remembered(mentions: DataFrame, policy: Policy = Policy(), idle_ms: int | None = None) -> DataFrame:
    """The same for a stream of mentions, batch by batch; with idle_ms, a stream of text that has been idle so long is forgotten.

    Mentions of one batch are put in order of seq; what arrives later comes later.
    So any cut into batches gives the same entities as ``replayed`` if mentions
    arrive in order. Needs the RocksDB state store. Timers make Spark run batches
    without data for as long as a stream is remembered, so a query with idle_ms
    does not end by itself under an availableNow trigger.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Remembering(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.entities = handle.getMapState("entities", "entity long", "name string, forms array<string>, seen long, uses long")
            self.recent = handle.getListState("recent", "entity long")
            self.frequent = handle.getListState("frequent", "entity long")
            self.counts = handle.getValueState("counts", "mentions long, entities long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            memory = Memory(policy)
            if self.counts.exists():
                memory.count, memory.number = map(int, self.counts.get())
                stored = {int(k[0]): v for k, v in self.entities.iterator()}
                memory.entities = {i: Entity(stored[i][0], list(stored[i][1]), int(stored[i][2]), int(stored[i][3])) for i in sorted(stored)}
                memory.recent, memory.frequent = ([int(x[0]) for x in s.get()] if s.exists() else [] for s in (self.recent, self.frequent))
            before = {i: (e.name, len(e.forms), e.seen, e.uses) for i, e in memory.entities.items()}
            yield _rows(memory, key[0], pd.concat(list(rows)))
            for i, e in memory.entities.items():
                if before.get(i) != (e.name, len(e.forms), e.seen, e.uses):
                    self.entities.updateValue((i,), (e.name, e.forms, e.seen, e.uses))
            for i in before.keys() - memory.entities.keys():
                self.entities.removeKey((i,))
            for state, order in ((self.recent, memory.recent), (self.frequent, memory.frequent)):
                if order:
                    state.put([(i,) for i in order])
            self.counts.update((memory.count, memory.number))
            if idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + idle_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            for state in (self.entities, self.recent, self.frequent, self.counts):
                state.clear()
            yield from ()

        def close(self) -> None:
            pass

    keyed = mentions.selectExpr("cast(stream_id as string) as stream_id", "cast(seq as long) as seq", "text").groupBy("stream_id")
    return keyed.transformWithStateInPandas(Remembering(), OUT, "append", "none" if idle_ms is None else "processingTime")
