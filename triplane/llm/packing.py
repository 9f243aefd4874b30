"""First-fit decreasing bin packing with a tournament tree, independently in randomised groups of documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.llm.tables import arrow_batches, materialize, release

CAPACITY, GROUP_DOCS = 2048, 4096
#: Tokens of a group at most on average where texts travel with it.
GROUP_TOKENS = 1 << 21
#: A token is a run of characters other than ASCII white space.
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, given in decreasing order: the first bin with room. A tournament tree over bins holds the
    most room below each inner node, so a bin is found in the logarithm of their number. Lengths are at most capacity."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)
    out = []
    for n in lengths:
        at = 1
        while at < size:
            at *= 2
            if room[at] < n:
                at += 1
        out.append(at - size)
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


BINS = "pack_group long, pack long, doc_ids array<long>, starts array<long>, lengths array<long>, n_tokens long"
_PIECE = re.compile(TOKEN)


def _bins(df: pd.DataFrame, capacity: int) -> list[list[tuple[int, int, int]]]:
    """The bins of a group's rows (id, none, h, n): (row, start, length) of their pieces, a document's row being its place in df."""
    df = df.sort_values(["n", "none", "id", "h"], ascending=[False, True, True, True])
    items = [(length, i, start) for i, (at, n) in enumerate(zip(df.index, df["n"], strict=True)) for start in range(0, int(n), capacity) for length in [min(capacity, int(n) - start)]]
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    at = df.index.to_numpy()
    bins: dict[int, list] = {}
    for b, (length, i, start) in zip(first_fit_decreasing([x[0] for x in items], capacity), items, strict=True):
        bins.setdefault(b, []).append((int(at[i]), start, length))
    return [bins[b] for b in sorted(bins)]


def _frame(group: int, df: pd.DataFrame, bins: list[list[tuple[int, int, int]]]) -> pd.DataFrame:
    ids = [None if none else int(x) for x, none in zip(df["id"], df["none"], strict=True)]
    rows = [(group, b, [ids[i] for i, _, _ in x], [s for _, s, _ in x], [n for _, _, n in x], sum(n for _, _, n in x)) for b, x in enumerate(bins)]
    return pd.DataFrame(rows, columns=["pack_group", "pack", "doc_ids", "starts", "lengths", "n_tokens"])


def _id(id_col: str) -> list[Column]:
    """The id, 0 for a null one, and whether it is null: pandas would read a column with nulls as floating point."""
    id_ = F.col(id_col).cast("long")
    return [F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("none")]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*_id(id_col), F.md5(text_col).alias("h"), token_count(F.col(text_col)).alias("n")).where("n > 0")


def pack(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack_group, pack, doc_ids, starts, lengths, n_tokens), a row for each bin.

    starts and lengths are token positions within the documents, in the order of doc_ids. A document over capacity gives
    pieces of capacity tokens, and what is left over is packed like any document. Rows without tokens (null, empty or
    blank texts) are in no bin. Null ids and repeated rows are packed like others; ids are whole numbers, or strings of them
    (others raise). Equal lengths go by id, then text, then start. Only ids and lengths are shuffled, so a group is small whatever
    its texts. No docs give no bins; other columns play no part.
    """
    rows = materialize(_rows(docs, id_col, text_col))
    groups = max(1, -(-rows.count() // group_docs))
    grouped = rows.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "id", "h"), F.lit(groups)))

    def packed(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.reset_index(drop=True)
        return _frame(int(key[0]), df, _bins(df, capacity))

    return grouped.groupBy("pack_group").applyInPandas(packed, BINS)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, group_tokens: int = GROUP_TOKENS, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``pack`` with ``texts``, the text of each piece in the order of doc_ids: a bin is a training sequence.

    A piece's text goes from its first token up to the one after its last, or to the document's end; white space before a
    document's first token belongs to its first piece. Whole texts are shuffled once, by group; groups are as many as keep them
    under ``group_docs`` rows and ``group_tokens`` tokens on average. All else is as in ``pack``.
    """
    arrow_batches(docs.sparkSession)
    sized = materialize(_rows(docs, id_col, text_col).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")))
    count, tokens = sized.first()
    release(sized)
    groups = max(1, -(-count // group_docs), -(-(tokens or 0) // group_tokens))
    rows = docs.select(*_id(id_col), F.md5(text_col).alias("h"), F.col(text_col).alias("text")).where(F.regexp_count("text", F.lit(TOKEN)) > 0)
    grouped = rows.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "id", "h"), F.lit(groups)))

    def packed(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.reset_index(drop=True)
        tokens = [[m.start() for m in _PIECE.finditer(t)] for t in df["text"]]
        df["n"] = [len(x) for x in tokens]
        bins = _bins(df, capacity)
        texts = df["text"].to_numpy()

        def piece(i: int, start: int, n: int) -> str:
            at = tokens[i]
            return texts[i][at[start] if start else 0 : at[start + n] if start + n < len(at) else None]

        return _frame(int(key[0]), df, bins).assign(texts=[[piece(*x) for x in b] for b in bins])

    return grouped.groupBy("pack_group").applyInPandas(packed, f"{BINS}, texts array<string>")
