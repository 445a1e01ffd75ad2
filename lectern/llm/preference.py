"""Preference pairs from conversations: one prompt, two masked completions.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (equal
roles and texts) is rendered and tokenized once, as the prompt; each remainder is a completion,
whose loss mask is 1 on the tokens of assistant turns and 0 elsewhere. Turns are
`<|role|>\\n`, the text and `<|end|>\\n`; the header of a turn is never trained on, its end is.

Turns are ordered by number, then role and text; repeated rows count once. A null text is empty,
a null role is `user`, turns without a conversation are left out. A pair whose conversations are
equal has two empty completions. A conversation has to fit one task, as it is one training
sample; any number of conversations may open alike: their pairs are dealt by salt, which frequent openings get by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Conversations with one opening that meet the chosen one in one task, about.
SALT_ROWS = 128
TURN = "struct<role:string,text:string>"


def assembled(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's turns in order."""
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("user")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    rows = turns.select(F.col(f"`{conversation}`").alias("conv"), one.alias("x")).filter("conv is not null")
    ordered = F.sort_array(F.collect_set("x"))
    return rows.groupBy("conv").agg(F.transform(ordered, lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def opening_pairs(conversations: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected): of conversations that open with the same turn, the
    one with most assistant text (ties: least id) is chosen and every other one rejected against it.
    conversations should be a written table, as it is read several times.
    """
    said = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + F.when(x["role"] == "assistant", F.length(x["text"])).otherwise(0))
    rows = conversations.withColumn("opening", F.sha2(F.to_json(F.col("turns")[0]), 256)).withColumn("said", said)
    counts = rows.groupBy("opening").agg(F.min(F.struct((-F.col("said")).alias("s"), F.col("conv"))).alias("top"), F.count("*").alias("n"))
    top = counts.filter("n > 1").select("opening", F.col("top.conv").alias("chosen_id"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    # A frequent opening meets its chosen one in as many tasks as it has salts, and is salted before any shuffle.
    salted = common.hot_join(rows, top, "opening", common.hot_keys(rows, "opening", counts))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("conv"), "salts").cast("int"))
    leaders = salted.filter("conv = chosen_id").select("opening", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("turns").alias("chosen"))
    others = salted.filter("conv != chosen_id").select("opening", "salt", "chosen_id", F.col("conv").alias("rejected_id"), F.col("turns").alias("rejected"))
    return others.join(leaders, ["opening", "salt"]).select("chosen_id", "rejected_id", "chosen", "rejected")


def replay_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs within a conversation: as it stands up to its last assistant turn, and with that turn
    replaced by the first assistant turn, a reply to something else. Equal replies give no pair."""
    place = F.array_max(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)))
    rows = conversations.withColumn("last", place).filter("last is not null")
    replies = rows.withColumn("first", F.filter("turns", lambda x: x["role"] == "assistant")[0])
    differ = replies.filter(F.col("first.text") != F.element_at("turns", F.col("last") + 1)["text"])
    head = F.slice("turns", F.lit(1), F.col("last"))
    return differ.select(
        F.col("conv").alias("chosen_id"), F.col("conv").alias("rejected_id"), F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"),
        F.concat(head, F.array("first")).alias("rejected"),
    )


def rendered(turns: list) -> list[tuple[str, bool]]:
    """Pieces of the rendering, each with whether its tokens are trained on."""
    out = []
    for t in turns:
        out += [(f"<|{t['role']}|>\n", False), (f"{t['text']}<|end|>\n", t["role"] == "assistant")]
    return out


PAIR = (
    "common_turns int, prompt string, chosen_text string, rejected_text string, prompt_ids array<int>, chosen_ids array<int>, "
    "chosen_mask array<tinyint>, rejected_ids array<int>, rejected_mask array<tinyint>"
)


def format_pairs(pairs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """pairs (chosen, rejected: arrays of role and text) with the prompt, both completions, their ids and masks.

    Columns other than these keep their values.
    """
    path = tokenizer or common.tokenizer_path("byte_bpe_50k.json")
    common.bounded_batches(pairs.sparkSession)
    own = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True

        def ids(pieces: list[tuple[str, bool]]) -> tuple[np.ndarray, np.ndarray]:
            made = words.encode_batch_fast([p for p, _ in pieces], add_special_tokens=False) if pieces else []
            tokens = np.array([i for e in made for i in e.ids], np.int32)
            return tokens, np.repeat(np.array([m for _, m in pieces], np.int8), [len(e.ids) for e in made])

        for batch in batches:
            rows = []
            for c, r in zip(batch["chosen"], batch["rejected"], strict=True):
                c, r = list(c) if c is not None else [], list(r) if r is not None else []
                n = 0
                while n < min(len(c), len(r)) and c[n] == r[n]:
                    n += 1
                p, x, y = rendered(c[:n]), rendered(c[n:]), rendered(r[n:])
                text = ["".join(s for s, _ in z) for z in (p, x, y)]
                rows.append((n, *text, ids(p)[0], *ids(x), *ids(y)))
            made = pd.DataFrame(rows, columns=[x.split()[0] for x in PAIR.split(", ")], index=batch.index)
            yield pd.concat([batch[own], made], axis=1)

    return pairs.select(*own, "chosen", "rejected").mapInPandas(run, f"{kinds}, {PAIR}")



def op8_preference_formatting(spark, sf_dir: str) -> DataFrame:
    """Pairs of all conversations with a common opening, and of all with two different assistant replies."""
    conversations = common.cut(assembled(common.read(spark, sf_dir, "conversations")), "conversations")
    pairs = opening_pairs(conversations).withColumn("kind", F.lit("opening")).unionByName(replay_pairs(conversations).withColumn("kind", F.lit("replay")))
    done = format_pairs(pairs)
    masked = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + x)
    return done.select(
        "chosen_id", "rejected_id", "kind", "common_turns", "prompt", "chosen_text", "rejected_text",
        F.size("prompt_ids").alias("prompt_tokens"), F.size("chosen_ids").alias("chosen_tokens"), masked("chosen_mask").alias("chosen_trained"),
        F.size("rejected_ids").alias("rejected_tokens"), masked("rejected_mask").alias("rejected_trained"),
        "prompt_ids", "chosen_ids", "chosen_mask", "rejected_ids", "rejected_mask",
    )
