"""Chat formatting (operator 2): reply trees, their best branches, and one formatted conversation for each.

Only DataFrame functions. Root-to-leaf paths come from iterative self-joins with doubling steps: jumps of 1,
2, 4, ... replies are joined from one another, then the paths are filled in from the longest jump down, so a
tree of depth d takes 2 log d joins and every (leaf, ancestor) pair appears once. Branches of a tree are
ranked by score in two steps (first within salted parts, then among the parts' best), so one large tree does
not meet in one task.

The template of a turn is <|im_start|>ROLE<|im_sep|>TEXT<|im_end|>. In roles and texts a backslash becomes
two, and every control string gets a backslash and a dot after its first character; unescape undoes both.
The loss mask is a list of (start, length) in code points of the formatted string: assistant texts.

Defined results: null text and null role are empty; turns are in the order of turn, then role, then text
(null first); equal rows are turns of their own; rows with a null conversation id form one conversation with
a null id; a parent that does not exist makes a root; a cycle has no leaf and gives nothing; empty tables
give empty results; columns that are not named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phaseframe.llm.common import materialize

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

#: Strings that chat templates give a meaning; none of them survives in an escaped text.
CONTROL = (START, SEPARATOR, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_SALTS = 64


def _pattern() -> str:
    """The first character of any control string, by what follows it."""
    escaped = ["".join("\\" + c if c in "|[]/<>" else c for c in s) for s in CONTROL]
    by_first: dict[str, list[str]] = {}
    for s, e in zip(CONTROL, escaped, strict=True):
        head = "\\" + s[0]
        by_first.setdefault(head, []).append(e[len(head) :])
    return "|".join(f"{head}(?={'|'.join(rest)})" for head, rest in by_first.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_pattern()), F.lit(r"$0\\."))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"\\(?:(\\)|\.)"), F.lit("$1"))


def paths(nodes: DataFrame) -> DataFrame:
    """leaf, node, up (replies between them) for nodes(node, parent): every root-to-leaf path."""
    edges = nodes.select("node", "parent")
    jump = materialize(edges.where("parent is not null").join(edges.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("to")))
    leaves = edges.join(jump.select(F.col("to").alias("node")).distinct(), "node", "left_anti")
    jumps, limit = [jump], edges.count()
    while not jumps[-1].isEmpty() and (1 << len(jumps)) <= 2 * limit:
        last = jumps[-1]
        jumps.append(materialize(last.join(last.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))))
    found = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        ahead = found.join(jumps[k], "node").select("leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = materialize(found.union(ahead))
    return found


def best_branches(scored: DataFrame, branches: int) -> DataFrame:
    """tree, leaf, place (from 1) of the best-scored branches of scored(tree, leaf, score)."""
    order = [F.desc_nulls_last("score"), F.asc("leaf")]
    parts = scored.withColumn("salt", F.pmod(F.xxhash64("leaf"), F.lit(_SALTS)))
    few = parts.withColumn("r", F.row_number().over(Window.partitionBy("tree", "salt").orderBy(*order))).where(F.col("r") <= branches)
    ranked = few.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy(*order)))
    return ranked.where(F.col("place") <= branches).select("tree", "leaf", "place")


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """tree, place, leaf, formatted, loss_spans for nodes(tree, node, parent, role, text, score).

    node is unique in the whole table. The score of a branch is the mean score of its turns (null counts as 0).
    """
    full = paths(nodes)
    scored = full.join(nodes.select("node", "tree", F.coalesce("score", F.lit(0.0)).alias("s")), "node").groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("s").alias("score"))
    chosen = full.join(best_branches(scored, branches), "leaf")
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    turns = nodes.select("node", role.alias("role"), text.alias("text"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    grouped = chosen.join(turns, "node").groupBy("tree", "place", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text", "learn"))).alias("turns"))
    lengths = F.transform("turns", lambda t: F.length(t["role"]) + F.length(t["text"]))
    fixed = len(START) + len(SEPARATOR) + len(END)
    # where each turn begins: lengths before it
    begins = F.aggregate(
        lengths,
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
        lambda s, n: F.struct((s["at"] + n + fixed).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        lambda s: s["all"],
    )
    spans = F.filter(
        F.zip_with("turns", F.col("begins"), lambda t, b: F.when(t["learn"], F.struct((b + len(START) + F.length(t["role"]) + len(SEPARATOR)).alias("start"), F.length(t["text"]).cast("long").alias("length")))),
        lambda x: x.isNotNull(),
    )
    written = F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEPARATOR), t["text"], F.lit(END))), "")
    return grouped.withColumn("begins", begins).select("tree", "place", "leaf", written.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: str) -> Column:
    """(role, text) of each turn of a formatted conversation."""
    parts = F.slice(F.split(formatted, r"<\|im_end\|>", -1), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>", -1)) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring(F.substring_index(p, SEPARATOR, 1), len(START) + 1, 1 << 30)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, SEPARATOR, 1)) + len(SEPARATOR) + 1, F.lit(1 << 30))).alias("text"),
        ),
    )


def masked_text(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), s["start"].cast("int"), s["length"].cast("int")))), "")


def nodes_of(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees: each turn answers the one before it."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = conversations.select("conv_id", "role", "text", F.row_number().over(by).alias("at"))
    key = F.struct(F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none"))
    return placed.select(
        F.col("conv_id").alias("tree"),
        F.struct(key.alias("conv"), F.col("at").alias("at")).alias("node"),
        F.when(F.col("at") > 1, F.struct(key.alias("conv"), (F.col("at") - 1).alias("at"))).alias("parent"),
        "role",
        "text",
        F.lit(None).cast("double").alias("score"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them alone."""
    read = formatted.withColumn("turns", read_turns("formatted")).withColumn("loss", masked_text("formatted", "loss_spans"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
