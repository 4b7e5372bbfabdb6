"""Packing texts into token packs of fixed capacity by vector bin packing (problem 7).

Each item has a demand vector: its tokens, one segment, and its loss-bearing tokens (those after the first line, which is
taken as the prompt; all of them in a text of one line). The dot-product heuristic fills one pack at a time with
the fitting item whose demand points most along the pack's free room.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splits text into letters, digits, other signs and blanks before byte pairs are merged.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens, loss): whole texts in tokens, and their loss-bearing tokens."""
    src = spread(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null and t != ''"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for x in batches:
            tokens, loss = [], []
            for t in x["t"]:
                head, line, rest = t.partition("\n")
                n = len(e.encode_ordinary(t))
                tokens.append(n)
                loss.append(max(0, n - len(e.encode_ordinary(head + line))) if rest.strip() else n)
            yield pd.DataFrame({"doc_id": x["d"], "tokens": np.array(tokens, "int32"), "loss": np.array(loss, "int32")})

    return src.mapInPandas(run, f"doc_id {dict(src.dtypes)['d']}, tokens int, loss int")


def pack(demand: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Pack number of each item. ``demand`` is items x dimensions, none above ``capacity``."""
    n = len(demand)
    where = np.full(n, -1, "int64")
    if not n:
        return where
    share = demand / capacity
    weight = share.mean(axis=0) / max(share.mean(axis=0).max(), 1e-12)
    order = np.lexsort((np.arange(n), -share[:, 0]))
    share, left, k = share[order], np.ones(n, bool), 0
    live = np.arange(n)
    while len(live):
        room = np.ones(share.shape[1])
        s = share[live]
        while True:
            fits = left[live] & (s <= room + 1e-9).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, s @ (weight * room), -1.0)
            best = int(score.argmax())
            left[live[best]] = False
            where[order[live[best]]] = k
            room = room - s[best]
        k += 1
        live = live[left[live]]
    return where


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, max_segments: int = 64, max_loss: int | None = None, tokenizer: str = TOKENIZER, group: int = 5000, full: float = 0.97) -> DataFrame:
    """(pack_id, doc_id, piece, first_token, last_token, tokens, loss, pack_tokens, pack_segments): each piece of a text and its pack.

    A text is cut only if it alone exceeds a pack: every ``capacity`` tokens, or where its loss-bearing tokens reach
    ``max_loss`` (by default the capacity), so that no piece exceeds any limit. Items are packed in groups of about
    ``group``, a bound on a task's memory that doesn't depend on the input; the items of packs filled to less than
    ``full`` go into a second round of such groups, so that groups leave no room unused at their ends. Null or empty
    texts have no tokens and come out in no pack. Repeated rows are items of their own.
    """
    loss_cap = capacity if max_loss is None else max_loss
    if min(capacity, max_segments, loss_cap) < 1 or loss_cap > capacity:
        raise ValueError("limits are at least 1, and that on loss-bearing tokens at most the capacity")
    whole = cut(sizes(docs, doc_id, text, tokenizer))
    # full pieces of the prompt, one with its rest and the first loss-bearing tokens, then pieces of loss-bearing tokens
    prompt, tokens, size = F.col("tokens") - F.col("loss"), F.col("tokens"), F.lit(capacity)
    whole = whole.withColumn("k", F.floor(prompt / size).cast("int")).withColumn("prompt", prompt)
    whole = whole.withColumn("e", F.least(tokens, F.col("prompt") + F.least(F.lit(loss_cap), size - (F.col("prompt") - F.col("k") * size))).cast("int"))
    rest = F.ceil((tokens - F.col("e")) / loss_cap).cast("int")
    count = F.col("k") + F.when(F.col("e") > F.col("k") * size, 1).otherwise(0) + rest
    start = F.when(F.col("piece") <= F.col("k"), F.col("piece") * size).otherwise(F.col("e") + (F.col("piece") - F.col("k") - 1) * loss_cap)
    end = F.when(F.col("piece") < F.col("k"), (F.col("piece") + 1) * size).when(F.col("piece") == F.col("k"), F.col("e")).otherwise(F.least(tokens, F.col("e") + (F.col("piece") - F.col("k")) * loss_cap))
    pieces = (
        whole.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
        .withColumn("first_token", start.cast("int")).withColumn("last_token", end.cast("int"))
        .select(
            "doc_id", "piece", "first_token", "last_token", (F.col("last_token") - F.col("first_token")).cast("int").alias("tokens"),
            F.greatest(F.lit(0), F.col("last_token") - F.greatest("first_token", "prompt")).cast("int").alias("loss"),
        )
    )
    schema = f"pack_id bigint, doc_id {dict(pieces.dtypes)['doc_id']}, piece int, first_token int, last_token int, tokens int, loss int, pack_tokens int, pack_segments int"
    cap = np.array([capacity, max_segments, loss_cap], "float64")

    def one(base: int):
        def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
            x = x.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            d = np.column_stack([x["tokens"], np.ones(len(x)), x["loss"]]).astype("float64")
            no = pack(d, cap)
            x["pack_id"] = base + (int(key[0]) << 20) + no
            x["pack_tokens"] = np.bincount(no, weights=x["tokens"])[no].astype("int32")
            x["pack_segments"] = np.bincount(no)[no].astype("int32")
            return x[[c.split()[0] for c in schema.split(", ")]]

        return run

    groups = max(1, math.ceil(whole.count() / group))
    spot = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    first = cut(pieces.withColumn("g", spot).repartition(groups, "g").groupBy("g").applyInPandas(one(0), schema))
    done = F.col("pack_tokens") >= int(full * capacity)
    loose = first.where(~done).select("doc_id", "piece", "first_token", "last_token", "tokens", "loss")
    again = max(1, math.ceil(loose.count() / group))
    spot2 = F.pmod(F.xxhash64("piece", "doc_id"), F.lit(again)).cast("int")
    return first.where(done).unionByName(loose.withColumn("g", spot2).repartition(again, "g").groupBy("g").applyInPandas(one(1 << 60), schema))
