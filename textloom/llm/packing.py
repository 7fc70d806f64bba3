"""Variable-capacity best-fit packing of token sequences.

Pieces, longest first, go to the open bin that they fill best. If none has
room, a bin opens. For each permitted size it is looked ahead what would come
into the bin: the longest pieces still to place that fit, one after another.
The size opens whose sequence, cut down to those contents, costs least for
each token of them. So a size above the smallest that fits opens where it is
going to be filled. In the end each bin is cut down to the smallest size that
holds what it got. Documents longer than the greatest size are cut into pieces
of that size and a rest. Rows are dealt to shards of bounded size that are
packed on their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stash
from textloom.llm.tokens import with_token_counts

SIZES = (512, 1024, 2048, 4096, 8192)
#: Documents of a shard.
SHARD = 20_000
#: What a sequence costs whatever its length (starting it, its share of a batch's gaps), in tokens.
SEQUENCE = 96
#: Sequence length at which attention costs as much as the rest of a model.
ATTENTION = 32_768


def cost(size: int) -> float:
    """What a sequence of this length costs, in tokens of a model without attention."""
    return SEQUENCE + size + size * size / ATTENTION


class Lengths:
    """The lengths of pieces still to place, with how many there are of each."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.count = np.bincount(lengths).tolist() if len(lengths) else [0]
        self.held = 0  # bit n: some piece has n tokens
        for n, k in enumerate(self.count):
            if k:
                self.held |= 1 << n

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.held ^= 1 << n

    def fill(self, room: int) -> int:
        """Tokens that come into this room if the longest piece that fits is placed again and again."""
        left, most = room, room
        while most > 0:
            n = (self.held & ((2 << min(left, most)) - 1)).bit_length() - 1
            if n <= 0:
                break
            left -= n * min(self.count[n], left // n)
            most = n - 1
        return room - left


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, costs: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pieces of 1 to max(sizes) tokens: number of the bin and place in it of each, the size of each bin, and the size it was opened with.

    costs: of a sequence of each of the sizes as given, ``cost`` by default.
    Ties: equal pieces in the order given, equal bins the one opened first,
    sizes of equal cost the greater.
    """
    prices = dict(zip(sizes, costs or map(cost, sizes), strict=True))
    sizes = sorted(prices)
    own = np.asarray(lengths, np.int64)
    order = np.argsort(-own, kind="stable")
    coming = Lengths(own)
    bins, places = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    used: list[int] = []
    opened: list[int] = []
    room: dict[int, list[int]] = defaultdict(list)  # free tokens -> heap of bins
    free = 0  # bit k: some bin has k free tokens

    def cut(held: int) -> int:
        return next(s for s in sizes if s >= held)

    for i in order.tolist():
        n = int(own[i])
        coming.take(n)
        fits = free >> n
        if fits:
            k = n + (fits & -fits).bit_length() - 1
            at = heappop(room[k])
            if not room[k]:
                free ^= 1 << k
        else:
            held = {s: n + coming.fill(s - n) for s in sizes if s >= n}
            size = min(held, key=lambda s: (prices[cut(held[s])] / held[s], -s))
            at, k = len(opened), size
            opened.append(size)
            used.append(0)
        bins[i], places[i] = at, used[at]
        used[at] += n
        if k > n:
            heappush(room[k - n], at)
            free |= 1 << (k - n)
    return bins, places, np.array([cut(u) for u in used], np.int64), np.array(opened, np.int64)


def pack_documents(docs: DataFrame, n_tokens: str = "n_tokens", doc_id: str = "doc_id", sizes: Sequence[int] = SIZES, costs: Sequence[float] | None = None, shard: int = SHARD) -> DataFrame:
    """Rows (doc_id, piece, start, n_tokens, bin_id, place, bin_size), one for each piece of each row of docs.

    start: the piece's first token in its document; place: in its bin. A null
    or zero count has one row with no bin. Repeated rows are packed each on
    its own; a null id is kept; extra columns are left out; an empty table
    gives no rows. The shards, and so the bins, depend on how the rows lie in
    files; the bins' contents never exceed their size.
    """
    greatest = max(sizes)
    counts = stash(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)).alias("n")), "lengths")
    shards = max(1, -(-counts.count() // shard))
    id_type = counts.schema["doc_id"].dataType.simpleString()
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable", na_position="last")
        n = rows["n"].to_numpy()
        pieces = np.maximum(1, -(-n // greatest))
        at = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[at] - piece * greatest, greatest)
        held = size > 0
        bins, places, cut, _ = pack(size[held], sizes, costs)
        first = int(rows["shard"].iloc[0]) << 32
        number, place, bin_size = (pd.array([pd.NA] * len(at), "Int64") for _ in range(3))
        number[held], place[held], bin_size[held] = first + bins, places, cut[bins] if len(cut) else bins
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[at], "piece": piece, "start": piece * greatest, "n_tokens": size, "bin_id": number, "place": place, "bin_size": bin_size})

    return dealt.groupBy("shard").applyInPandas(one, f"doc_id {id_type}, piece long, start long, n_tokens long, bin_id long, place long, bin_size long")


def pack_texts(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", sizes: Sequence[int] = SIZES) -> DataFrame:
    """``pack_documents`` by the token counts of the texts; a null text has no tokens."""
    counted = with_token_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), tokenizer, "n_tokens")
    return pack_documents(counted, "n_tokens", sizes=sizes)
