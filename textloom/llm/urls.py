"""URL filters: rules, and for all other addresses a ratio of two character models.

Addresses that a rule accepts or rejects teach two variable-order Markov
models. A character's probability is that of the longest context, smoothed
into the next shorter one:

    P(c | context) = (n(context c) + MU * P(c | shorter context)) / (n(context) + MU)

and 1 / alphabet below the empty context. A context that was never seen adds
nothing, so the order varies with what is known. The score of an address is
the difference of its log-likelihoods, rejected minus accepted, divided by
its number of characters. One part in HELD_OUT of the taught addresses does
not teach but calibrates: the threshold is the one at which as large a share
of the accepted is above it as of the rejected below.

All of it is DataFrame operations. Grams are counted over distinct addresses
weighted by their copies, so a hot address is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import stash

#: Longest context, weight of the shorter context, one part in so many that calibrates.
ORDER, MU, HELD_OUT = 4, 2.0, 5
#: Characters that are told apart; a digit is 0, any other *. Fixed values.
SIGNS = "abcdefghijklmnopqrstuvwxyz0./_?=&#%:@-*"
START, END = "^", "$"
#: Steps to one in which scores are counted, and the greatest that is told apart.
STEPS, REACH = 100, 20
#: Contexts up to which the model is broadcast to where addresses are read; a larger one is joined by shuffles.
BROADCAST_CONTEXTS = 300_000
#: (verdict, host, path) of the registered query. Fixed values of the contract.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased) and path (from there up to a question mark, hash or the end); both empty without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one, and its verdict; else nulls. Equally long: the first given."""
    rule = verdict = F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])) if rules else ():
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def signs(url: Column) -> Column:
    """What the models read of an address: all after the scheme, in the characters of SIGNS."""
    low = F.translate(F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    at = F.locate("://", low)
    return F.regexp_replace(F.when(at > 0, F.substring(low, at + 3, F.length(low))).otherwise(low), r"[^a-z0./_?=&#%:@-]", "*")


def _places(addresses: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of column `signs` and for its end: c, and g, the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), "signs", F.lit(END))
    return addresses.select(*keep, padded.alias("s"), F.explode(F.sequence(F.lit(0), F.length("signs"))).alias("i")).select(
        *keep, F.substring(F.col("s"), F.col("i") + 1, F.lit(ORDER)).alias("g"), F.substring(F.col("s"), F.col("i") + 1 + ORDER, F.lit(1)).alias("c")
    )


def train(taught: DataFrame) -> DataFrame:
    """Rows (context, n_accepted, n_rejected, followers): followers maps a character to its two counts. taught: signs, rejected, copies.

    A context has at most one follower for each character told apart.
    """
    counted = _places(taught, "rejected", "copies").groupBy("g", "c").agg(F.sum(F.when(~F.col("rejected"), F.col("copies")).otherwise(0)).alias("a"), F.sum(F.when(F.col("rejected"), F.col("copies")).otherwise(0)).alias("r"))
    contexts = counted.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda k: F.substring("g", F.lit(ORDER + 1) - k, k))).alias("context"), "c", "a", "r")
    grams = contexts.groupBy("context", "c").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    return grams.groupBy("context").agg(
        F.sum("a").alias("n_accepted"), F.sum("r").alias("n_rejected"), F.map_from_entries(F.collect_list(F.struct("c", F.struct("a", "r").alias("n")))).alias("followers")
    )


def score(addresses: DataFrame, contexts: DataFrame, size: int) -> DataFrame:
    """Rows (signs, score) for the distinct values of column signs; contexts of the given size as from ``train``."""
    rows = _places(addresses.select("signs").distinct(), "signs")
    broad = size <= BROADCAST_CONTEXTS
    accepted = rejected = F.lit(1.0 / (len(SIGNS) + 1))
    for k in range(ORDER + 1):
        own = contexts.filter(F.length("context") == k).select(F.col("context").alias(f"c{k}"), F.col("n_accepted").alias(f"a{k}"), F.col("n_rejected").alias(f"r{k}"), F.col("followers").alias(f"f{k}"))
        own = F.broadcast(own) if broad or k == 0 else own
        rows = rows.withColumn(f"k{k}", F.substring(F.col("g"), ORDER + 1 - k, k)).join(own, F.col(f"k{k}") == F.col(f"c{k}"), "left")
        seen = F.element_at(F.col(f"f{k}"), F.col("c"))
        accepted = (F.coalesce(seen.a, F.lit(0)) + F.lit(MU) * accepted) / (F.coalesce(F.col(f"a{k}"), F.lit(0)) + F.lit(MU))
        rejected = (F.coalesce(seen.r, F.lit(0)) + F.lit(MU) * rejected) / (F.coalesce(F.col(f"r{k}"), F.lit(0)) + F.lit(MU))
        rows = rows.select("signs", "g", "c", accepted.alias("pa"), rejected.alias("pr"))
        accepted, rejected = F.col("pa"), F.col("pr")
    return rows.groupBy("signs").agg(F.avg(F.ln("pr") - F.ln("pa")).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The step of the score at which the shares of accepted above and of rejected below are nearest; ties: the least. scored: score, rejected, copies. No row of either kind: 0."""
    step = F.greatest(F.lit(-REACH * STEPS), F.least(F.lit(REACH * STEPS), F.floor(F.col("score") * STEPS)))
    steps = scored.groupBy(step.alias("step")).agg(F.sum(F.when(F.col("rejected"), 0).otherwise(F.col("copies"))).alias("a"), F.sum(F.when(F.col("rejected"), F.col("copies")).otherwise(0)).alias("r"))
    rows = sorted((r.step, r.a, r.r) for r in steps.collect())  # a row for each step, of which there are 2 * REACH * STEPS + 1
    all_a, all_r = sum(a for _, a, _ in rows), sum(r for _, _, r in rows)
    if not all_a or not all_r:
        return 0.0
    best, below_a, below_r = None, 0, 0
    for at, a, r in [*rows, (rows[-1][0] + 1, 0, 0)]:  # threshold at: rejected if the step is at or above it
        gap = abs((all_a - below_a) / all_a - below_r / all_r)
        if best is None or gap < best[0]:
            best = (gap, at)
        below_a, below_r = below_a + a, below_r + r
    return best[1] / STEPS


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score), one per input row.

    The verdict is the longest fitting rule's, else block if the score is at
    or above the threshold. Every address that a rule decides teaches. A null
    address and one without :// have an empty host and path and are judged by
    their characters (none: the end alone). If the rules teach nothing of one
    kind, the threshold is 0. Repeated rows and null ids are kept; extra
    columns are left out; an empty table gives no rows.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    own = own.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit("")), "signs": signs(F.col("url"))})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"rule": rule, "says": says})
    distinct = stash(own.groupBy("signs", "says").agg(F.count(F.lit(1)).alias("copies")), "addresses")
    taught = distinct.filter("says is not null").withColumn("rejected", F.col("says") == "block")
    fold = F.pmod(F.crc32("signs"), F.lit(HELD_OUT)) == 0
    contexts = stash(train(taught.filter(~fold)), "contexts")
    scores = stash(score(distinct, contexts, contexts.count()), "scores")
    cut = threshold(taught.filter(fold).join(scores, "signs").select("score", "rejected", "copies"))
    block = F.floor(F.col("score") * STEPS) >= round(cut * STEPS)
    return own.join(scores, "signs").select("page_id", "host", "path", "rule", F.coalesce("says", F.when(block, "block").otherwise("allow")).alias("verdict"), "score")


def oracle() -> str:
    """The verdicts of ``pages`` by RULES in DuckDB SQL."""
    cap, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ordered = sorted(RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True)) + " END"
    says = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True)) + " END"
    joins, pa, pr = "", str(1.0 / (len(SIGNS) + 1)), str(1.0 / (len(SIGNS) + 1))
    for k in range(ORDER + 1):
        joins += f" LEFT JOIN ctx c{k} ON c{k}.k = {k} AND c{k}.context = right(g, {k}) LEFT JOIN gram g{k} ON g{k}.k = {k} AND g{k}.context = right(g, {k}) AND g{k}.c = p.c"
        pa = f"((coalesce(g{k}.a, 0) + {MU} * {pa}) / (coalesce(c{k}.a, 0) + {MU}))"
        pr = f"((coalesce(g{k}.r, 0) + {MU} * {pr}) / (coalesce(c{k}.r, 0) + {MU}))"
    return f"""
WITH base AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
                     translate(coalesce(url, ''), '{cap}123456789', '{low}000000000') AS lo FROM pages),
     split AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h0 FROM base),
     named AS (SELECT page_id, translate(h0, '{cap}', '{low}') AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path,
                      regexp_replace(CASE WHEN instr(lo, '://') > 0 THEN substr(lo, instr(lo, '://') + 3) ELSE lo END, '[^a-z0./_?=&#%:@-]', '*', 'g') AS signs FROM split),
     own AS (SELECT *, {rule} AS rule, {says} AS says FROM named),
     crc AS (SELECT signs, says, count(*) AS copies FROM own GROUP BY ALL),
     tab(i, v) AS (SELECT i, list_reduce([i] || range(8), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) FROM range(256) t(i)),
     tabs AS (SELECT list(v ORDER BY i) AS t FROM tab),
     folded AS (SELECT signs, says, copies, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(signs) + 1), lambda j: ord(substr(signs, j, 1))::BIGINT),
                       lambda x, b: xor(t[xor(x % 256, b) + 1], x // 256)), 4294967295) % {HELD_OUT} = 0 AS held FROM crc, tabs),
     place AS (SELECT signs, says, copies, held, substr(repeat('{START}', {ORDER}) || signs || '{END}', i + 1, {ORDER}) AS g, substr(repeat('{START}', {ORDER}) || signs || '{END}', i + 1 + {ORDER}, 1) AS c
               FROM (SELECT *, unnest(range(0, length(signs) + 1)) AS i FROM folded)),
     gram AS (SELECT k, right(g, k) AS context, c, sum(CASE WHEN says = 'allow' THEN copies ELSE 0 END) AS a, sum(CASE WHEN says = 'block' THEN copies ELSE 0 END) AS r
              FROM place, range(0, {ORDER + 1}) t(k) WHERE says IS NOT NULL AND NOT held GROUP BY ALL),
     ctx AS (SELECT k, context, sum(a) AS a, sum(r) AS r FROM gram GROUP BY ALL),
     p AS (SELECT DISTINCT signs, says, copies, held, g, c, row_number() OVER () AS n FROM place),
     scored AS (SELECT signs, avg(ln({pr}) - ln({pa})) AS score FROM (SELECT signs, g, c FROM p) p{joins} GROUP BY signs),
     step AS (SELECT greatest(-{REACH * STEPS}, least({REACH * STEPS}, floor(score * {STEPS})))::BIGINT AS step, sum(CASE WHEN says = 'allow' THEN copies ELSE 0 END) AS a, sum(CASE WHEN says = 'block' THEN copies ELSE 0 END) AS r
              FROM folded JOIN scored USING (signs) WHERE held AND says IS NOT NULL GROUP BY ALL),
     edge AS (SELECT step, a, r FROM step UNION ALL SELECT max(step) + 1, 0, 0 FROM step),
     gap AS (SELECT step, abs((sum(a) OVER () - coalesce(sum(a) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(a) OVER ()
                  - coalesce(sum(r) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(r) OVER ()) AS gap FROM edge),
     cut AS (SELECT coalesce(arg_min(step, (gap, step)), 0) AS cut FROM gap WHERE gap IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN floor(score * {STEPS}) >= cut THEN 'block' ELSE 'allow' END) AS verdict
FROM own JOIN scored USING (signs), cut"""
