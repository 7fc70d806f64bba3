"""Requests and responses as trees of JSON: personal data in their texts replaced by tokens of a vault, and put back.

A tree is a VARIANT. It is flattened to rows of leaves with their paths, several
levels in one pass; a leaf's scope follows from the steps that led to it, so only
texts that the protocol carries are touched. Texts that may hold what is sought
are rewritten by joins with the vault; then each tree is written from its leaves
in order, which takes one shuffle however deep trees are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import pii
from textloom.storage import stash

#: Types of blocks and the member of each that holds text. Fixed values.
BLOCK_TEXT = (("text", "text"), ("thinking", "text"), ("tool_result", "content"))
BLOCK_INPUT = ("tool_use", "input")

#: Levels that are opened in one pass; deeper trees take more passes.
LEVELS = 8


def request_scope(scope: Column, key: Column, kind: Column) -> Column:
    """The scope of a member (or, with a null key, an item) of a value: root, messages, message, content, block, any (all texts below), out."""
    text = F.lit(False)
    for t, member in BLOCK_TEXT:
        text = text | ((kind == t) & (key == member))
    return (
        F.when((scope == "root") & (key == "system"), "content").when((scope == "root") & (key == "messages"), "messages").when((scope == "messages") & key.isNull(), "message").when((scope == "message") & (key == "content"), "content")
        .when((scope == "content") & key.isNull(), "block").when((scope == "block") & text, "content").when((scope == "block") & (kind == BLOCK_INPUT[0]) & (key == BLOCK_INPUT[1]), "any").when(scope == "any", "any").otherwise("out")
    )


def response_scope(scope: Column, key: Column, kind: Column) -> Column:
    """The same for a response: its content, the text of any block, all texts of a block's input."""
    return (
        F.when((scope == "root") & (key == "content"), "content").when((scope == "content") & key.isNull(), "block").when((scope == "block") & (key == "text"), "content").when((scope == "block") & (key == BLOCK_INPUT[1]), "any")
        .when(scope == "any", "any").otherwise("out")
    )


def flatten(trees: DataFrame, scope_of: Callable[[Column, Column, Column], Column] = request_scope, tree_id: str = "id", tree: str = "tree") -> DataFrame:
    """Rows (id, path, text, json, scope), one for each leaf of the VARIANT trees: path from the root as structs (pos, key), key null for items of lists; text of a text leaf, json of any other.

    An empty object or list is a leaf. A null tree is one leaf of an empty path
    and null json. Ids name trees: rows of one id would be one tree.
    """
    now = trees.select(F.col(tree_id).alias("id"), F.array().cast("array<struct<pos:int,key:string>>").alias("path"), F.lit("root").alias("scope"), F.col(tree).alias("v"))
    found = None
    while True:
        for _ in range(LEVELS):
            now = _opened(now, scope_of)
        kind = F.schema_of_variant("v")
        inner = F.coalesce((kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~F.to_json("v").isin("{}", "[]"), F.lit(False))
        text = F.when(kind == "STRING", F.col("v").cast("string"))
        own = now.withColumn("inner", inner).select("id", "path", F.when(~F.col("inner"), text).alias("text"), F.when(~F.col("inner") & text.isNull(), F.to_json("v")).alias("json"), "scope", "inner", F.when(F.col("inner"), F.col("v")).alias("v"))
        now = stash(own, "trees")
        leaf = now.filter("not inner").select("id", "path", "text", "json", "scope")
        found = leaf if found is None else found.unionByName(leaf)
        now = now.filter("inner").select("id", "path", "scope", "v")
        if now.isEmpty():
            return found


def _opened(nodes: DataFrame, scope_of: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """nodes (id, path, scope, v) one level down: the members or items of each; what has none stays as it is."""
    parts = nodes.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).toDF("__pos", "__key", "__value")
    rows = nodes.withColumn("own", F.try_variant_get("v", "$.type", "string")).lateralJoin(parts)
    below = F.col("__pos").isNotNull()
    path = F.concat("path", F.array(F.struct(F.col("__pos").cast("int").alias("pos"), F.col("__key").alias("key"))))
    moved = {"path": path, "scope": scope_of(F.col("scope"), F.col("__key"), F.col("own")), "v": F.col("__value")}
    return rows.select("id", *(F.when(below, new).otherwise(F.col(c)).alias(c) for c, new in moved.items()))


def _quoted(text: Column) -> Column:
    """A text as JSON writes it."""
    whole = F.to_json(F.struct(text.alias("t")))  # {"t":"..."}
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def rebuild(leaves: DataFrame) -> DataFrame:
    """Rows (id, tree) from leaves (id, path, text, json): the VARIANT trees that they are of."""
    written = F.when(F.col("text").isNotNull(), _quoted(F.col("text"))).otherwise(F.coalesce("json", F.lit("null")))
    none = F.col("json").isNull() & F.col("text").isNull() & (F.size("path") == 0)
    rows = leaves.select("id", F.struct("path", written.alias("w")).alias("leaf"), none.alias("none"))
    trees = rows.groupBy("id").agg(F.array_sort(F.collect_list("leaf")).alias("x"), F.bool_or("none").alias("none"))

    def between(leaf: Column, i: Column) -> Column:
        """A leaf with the brackets, comma and names that stand between it and the leaf before."""
        last, path = F.when(i > 0, F.get("x", i - 1)["path"]), leaf["path"]
        fork = F.array_position(F.zip_with(last, path, lambda a, b: a["pos"].eqNullSafe(b["pos"])), False)
        fork = F.when(i == 0, 1).otherwise(F.when(fork > 0, fork).otherwise(F.size(path))).cast("int")
        start = lambda s, k: F.when((k == 0) & (i > 0), ",").otherwise(F.when(s["key"].isNull(), "[").otherwise("{"))
        opened = F.transform(_after(path, fork), lambda s, k: F.concat(start(s, k), F.when(s["key"].isNull(), "").otherwise(F.concat(_quoted(s["key"]), F.lit(":")))))
        return F.concat(F.when(i > 0, _closed(_after(last, fork + 1))).otherwise(""), F.array_join(opened, ""), leaf["w"])

    whole = F.concat(F.array_join(F.transform("x", between), ""), _closed(F.get("x", F.size("x") - 1)["path"]))
    return trees.select("id", F.when(~F.col("none"), F.parse_json(whole)).alias("tree"))


def _after(path: Column, k: Column) -> Column:
    """The steps of a path from the k-th on, counted from 1."""
    return F.slice(path, k, F.greatest(F.size(path) - k + 1, F.lit(0)))


def _closed(steps: Column) -> Column:
    """The brackets that end what the steps lead into, the innermost first."""
    return F.array_join(F.transform(F.reverse(steps), lambda s: F.when(s["key"].isNull(), "]").otherwise("}")), "")


def _pieces(texts: DataFrame, text: str) -> DataFrame:
    """texts with k, kind and piece: each text cut at the personal data that the patterns find, those pieces with their kind."""
    cut = F.array_sort("__s")

    def step(done: Column, s: Column) -> Column:
        gap = F.col(text).substr((done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int"))
        return F.struct(s["end"].alias("at"), F.concat(done["p"], F.array(F.struct(F.lit(None).cast("string").alias("kind"), gap.alias("piece")), F.struct(s["type"].alias("kind"), s["text"].alias("piece")))).alias("p"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,piece:string>>").alias("p"))
    rest = lambda done: F.concat(done["p"], F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col(text).substr((done["at"] + 1).cast("int"), F.length(text)).alias("piece"))))
    return texts.withColumn("__s", pii.scan(F.col(text))).withColumn("__p", F.aggregate(cut, begin, step, rest)).drop("__s").select("*", F.posexplode("__p").alias("k", "x")).drop("__p").select("*", "x.kind", "x.piece").drop("x")


def _joined(pieces: DataFrame, value: Column) -> DataFrame:
    return pieces.groupBy("id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]), "").alias("text"))


def _split(leaves: DataFrame, may: Column) -> tuple[DataFrame, DataFrame]:
    """(leaves whose text is in scope and may have to change, the others)."""
    changes = F.coalesce(F.col("scope").isin("content", "any") & may, F.lit(False))
    return leaves.filter(changes).select("id", "path", "text"), leaves.filter(~changes).select("id", "path", "text", "json")


def pseudonymise(requests: DataFrame, vault: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests (id, tree) with tokens for personal data in their texts, the vault with the new tokens).

    vault: type, text, token. Texts are system, the contents of messages, the text
    of text and thinking blocks, the content of tool results and every text in a
    tool's input; nothing else is touched. Equal values have one token everywhere.
    A text that looks like a token stays and is not put back as one unless the
    vault has it. Ids are unique and not null.
    """
    scoped, rest = _split(flatten(requests), pii.possible(F.col("text")))
    pieces = stash(_pieces(scoped, "text").drop("text"), "pieces")
    full = stash(pii.vault_tokens(pieces.filter("kind is not null"), vault, "kind", "piece"), "vault")
    met = pieces.join(full.select(F.col("type").alias("kind"), F.col("text").alias("piece"), "token"), ["kind", "piece"], "left")
    return rebuild(rest.unionByName(_joined(met, F.coalesce("token", "piece")), allowMissingColumns=True)), full


def restore(responses: DataFrame, vault: DataFrame, scope_of: Callable[[Column, Column, Column], Column] = response_scope) -> DataFrame:
    """responses (id, tree) with the vault's values for the tokens in their texts (of the scope: by default a response's); unknown tokens stay."""
    scoped, rest = _split(flatten(responses, scope_of), pii.tokens_possible(F.col("text")))
    back = pii.rehydrate(scoped.select(F.struct("id", "path").alias("leaf"), "text"), vault, "leaf", "text")
    return rebuild(rest.unionByName(back.select("leaf.id", "leaf.path", "text"), allowMissingColumns=True))
